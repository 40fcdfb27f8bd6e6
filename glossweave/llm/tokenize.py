"""Token ids by the tokenizers library, fast on whole columns.

Both vocabularies split a text into pieces before they merge. Where white space is dropped, the parts between white
space encode on their own; they are looked up by 64-bit hashes and compared with what is found on their bytes. Elsewhere no piece holds a space after another
character, so the parts between spaces (each with its leading space) do; a text in which white space stands before a
space is encoded whole, since there runs of white space could form one piece. Each part is looked up once and its ids
kept in a bounded table of the process. Texts that hold the content of an added token, in whatever case, and texts with a
part whose hash misled are encoded whole. Where white space is dropped, parts of nothing but small letters of ASCII and
Latin-1 are each one piece that normalizing leaves as it is, so the library is asked for them without its normalizer and
its regular expression. All ways give the library's ids for the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glossweave.llm import text as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Most parts, and bytes of parts, whose ids one process keeps; beyond either the table starts anew.
KEEP, KEEP_BYTES = 900_000, 1 << 25
#: Parts encoded in one call.
TOGETHER = 8192
#: ASCII bytes that are neither letters, digits nor white space.
_SIGN = ~T.ALNUM & T.SOLID
_SIGN[:0x21] = _SIGN[0x41:0x5B] = _SIGN[0x7F] = False
_TIP = np.zeros(256, bool)
_TIP[0x30:0x3A] = _TIP[0x41:0x5B] = _TIP[0x61:0x7B] = True
#: Bytes of small letters of ASCII and, after 0xC3, of Latin-1: no other valid UTF-8 is made of these alone.
_SMALL = np.zeros(256, bool)
_SMALL[0x61:0x7B] = _SMALL[0xC3] = _SMALL[0x9F:0xC0] = True
_SMALL[0xB7] = False  # the division sign
_open: dict[str, "Encoder"] = {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.plain = Tokenizer.from_file(path)
        self.marks = sorted({t.content for t in self.plain.get_added_tokens_decoder().values()})
        self.tokenizer = Tokenizer.from_file(path)  # for parts of texts without added tokens
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.drops_space = any(t.endswith("</w>") for t in vocab)
        if self.drops_space:  # for parts of small letters alone; the model is shared
            self.lean = Tokenizer(self.tokenizer.model)
            self.lean.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Of each id, the bytes that it stands for: one for each character but an end mark.
        self.bytes = np.zeros(max(vocab.values()) + 2, np.int64)
        for token, i in vocab.items():
            self.bytes[i] = len(token.removesuffix("</w>"))
        self.clear()

    def clear(self) -> None:
        #: Open addressing: the number of the part whose hash belongs there or before, and the hash of each part.
        self.slot, self.key = np.full(1 << 17, -1, np.int32), np.zeros(1 << 16, np.uint64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.known = self.used = 0
        #: The bytes of all known parts in a row, and where each begins.
        self.raw, self.raw_at = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the parts that have these hashes; -1 where there is none."""
        mask = np.uint64(len(self.slot) - 1)
        code = self.slot[h & mask]
        live = np.flatnonzero((self.key[code] != h) & (code >= 0))
        step = np.uint64(0)
        while len(live):
            step += np.uint64(1)
            code[live] = found = self.slot[(h[live] + step) & mask]
            live = live[(self.key[found] != h[live]) & (found >= 0)]
        return code

    def _place(self, h: np.ndarray, first: int) -> None:
        """Enters distinct hashes that are not there, numbered from ``first`` on."""
        mask = np.uint64(len(self.slot) - 1)
        code, at = np.arange(first, first + len(h), dtype=np.int32), h & mask
        while len(code):
            free = self.slot[at] < 0
            self.slot[at[free]] = code[free]
            late = self.slot[at] != code
            code, at = code[late], (at[late] + np.uint64(1)) & mask

    def _size(self, part: str) -> int:
        """Bytes of all tokens of a part."""
        if part.isascii():
            return len(part)
        if not is_normalized("NFC", part):
            part = self.tokenizer.normalizer.normalize_str(part)
        return len(part.encode())

    def _together(self, raw: np.ndarray, size: np.ndarray, late: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part) of parts encoded as one text, cut by the bytes that tokens stand for.

        ``raw`` has the bytes of the parts, which are all ``late`` or all not (see ``_late``). If a part's end is not a
        token's end there, each part is encoded for itself."""
        edge = np.concatenate([[0], np.cumsum(size)])
        parts = None
        if late or not self.drops_space:
            text = raw.tobytes()
            parts = [text[i:j].decode() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        if late or self.drops_space:
            if self.drops_space:
                spaced = np.full(len(raw) + len(size), 0x20, np.uint8)
                spaced[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
                ends = np.cumsum([self._size(p) for p in parts]) if late else edge[1:]
            else:
                spaced, ends = raw, edge[1:]
            tokenizer = self.lean if self.drops_space and not late else self.tokenizer
            ids = np.array(tokenizer.encode_batch_fast([spaced.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            reach = np.concatenate([[0], np.cumsum(self.bytes[ids])])
            at = np.searchsorted(reach, ends)
            if reach[-1] == ends[-1] and np.array_equal(reach[at], ends):
                return ids, np.diff(at, prepend=0)
        if parts is None:
            text = raw.tobytes()
            parts = [text[i:j].decode() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        each = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _late(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Which parts come after the others: where white space is dropped, those not of small letters alone; elsewhere, those that begin with a space."""
        if not self.drops_space:
            return data[s] == 0x20
        other = np.concatenate([[0], np.cumsum(~_SMALL[data], dtype=np.int32)])
        return other[e] != other[s]

    def _add(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> None:
        """Encodes new parts (of distinct hashes) and keeps their ids, bytes and hashes."""
        late = self._late(data, s, e)
        order = np.argsort(late, kind="stable")
        s, e, h = s[order], e[order], h[order]
        n_early, first, size = len(s) - int(late.sum()), self.known, e - s
        self._remember(data, s, size, h)
        for lo, hi, after in ((0, n_early, False), (n_early, len(s), True)):
            for i in range(lo, hi, TOGETHER):
                j = min(hi, i + TOGETHER)
                ids, n = self._together(self.raw[self.raw_at[first + i] : self.raw_at[first + j]], size[i:j], after)
                used = self.used
                self.used += len(ids)
                while len(self.ids) < self.used:  # doubling keeps this linear
                    self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
                self.ids[used : self.used] = ids
                self.start[first + i + 1 : first + j + 1] = used + np.cumsum(n)

    def _remember(self, data: np.ndarray, s: np.ndarray, size: np.ndarray, h: np.ndarray) -> None:
        """The bytes and hashes of new parts, which take the next numbers; room for where their ids begin."""
        first = self.known
        self.known += len(s)
        total = int(self.raw_at[first] + size.sum())
        while len(self.raw) < total:
            self.raw = np.concatenate([self.raw, np.zeros(len(self.raw), np.uint8)])
        while len(self.key) <= self.known:
            self.key, self.start, self.raw_at = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.key, self.start, self.raw_at))
        self.raw_at[first + 1 : self.known + 1] = self.raw_at[first] + np.cumsum(size)
        pos = np.repeat(s - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.raw[self.raw_at[first] : total] = data[pos]
        self.key[first : self.known] = h
        if len(self.slot) < 2 * len(self.key):
            self.slot = np.full(2 * len(self.key), -1, np.int32)
            self._place(self.key[: self.known], 0)
        else:
            self._place(h, first)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets) of an Arrow column of texts; null counts as empty."""
        if self.known > KEEP or self.raw_at[self.known] > KEEP_BYTES:
            self.clear()
        codes, counts, whole = self._by_hash(texts)
        start = self.start
        lengths = start[codes + 1] - start[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        src = np.repeat(start[codes] - ends[:-1], lengths) + np.arange(ends[-1])
        flat = self.ids[src]
        edge = np.concatenate([[0], np.cumsum(counts)])
        size = ends[edge[1:]] - ends[edge[:-1]]
        if not whole:
            return flat, np.concatenate([[0], np.cumsum(size)])
        pieces = np.split(flat, ends[edge[1:-1]])
        apart = self.plain.encode_batch_fast(list(whole.values()), add_special_tokens=False)
        for i, e in zip(whole, apart, strict=True):
            pieces[i] = np.array(e.ids, np.uint32)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def _by_hash(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
        """(numbers of all parts in a row, parts of each text, texts that are encoded whole)."""
        data, offs = T.utf8(texts)
        apart = [np.flatnonzero(pc.fill_null(pc.match_substring(texts, m, ignore_case=True), False)) for m in self.marks]
        if self.drops_space:
            data = T.LOWER[data]  # as the library's normalizer does; what is not ASCII is left to it
            s, e, first = T.words(data, offs, T.SOLID)
        else:
            s, e, first, runs = _spaced(data, offs)
            apart.append(runs)
        s, e, first = _without_tails(data, s, e, first)
        h = T.word_hashes(data, s, e)
        found = self._find(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            at = miss[np.unique(h[miss], return_index=True)[1]]
            self._add(data, s[at], e[at], h[at])
            found[miss] = self._find(h[miss])
        size = e - s
        misled = size != self.raw_at[found + 1] - self.raw_at[found]
        alike = np.flatnonzero(~misled)
        misled[alike] = ~T.same(data, s[alike], self.raw, self.raw_at[found[alike]], size[alike])
        if misled.any():
            apart.append(np.searchsorted(first, np.flatnonzero(misled), "right") - 1)
        whole = {int(i): texts[int(i)].as_py() for i in np.unique(np.concatenate(apart))} if apart else {}
        return found, np.diff(first), whole


def _spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first of each text, texts left out): parts that begin at each space or text; texts in which white space stands before a space are left out."""
    n = len(data)
    space = np.flatnonzero(data == 0x20)
    heads = offs[:-1][np.diff(offs) > 0]
    inner = space[~np.isin(space, heads)]
    before = data[inner - 1]
    bad = ~T.SOLID[before] | ((before >= 0x1C) & (before < 0x20))
    odd = np.flatnonzero(before >= 0x80)
    if len(odd):  # white space outside ASCII ends in these bytes
        k = inner[odd]
        one, two, three = data[k - 1], data[k - 2], data[np.maximum(k - 3, 0)]
        bad[odd] |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
    starts = np.sort(np.concatenate([heads, inner]))
    ends = np.append(starts[1:], n)[: len(starts)]
    out = np.unique(np.searchsorted(offs, inner[bad], "right") - 1)
    if len(out):
        keep = ~np.isin(np.searchsorted(offs, starts, "right") - 1, out)
        starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offs), out


def _without_tails(low: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts whose signs after a last ASCII letter or digit stand apart: a piece ends there, and signs alone are one piece."""
    signed, solid, cut = np.flatnonzero(_SIGN[low[e - 1]]), np.flatnonzero(~_SIGN[low]), e.copy()
    k = np.searchsorted(solid, e[signed])
    cut[signed] = np.append(solid, -1)[k - 1] + 1  # one past the last byte that is no sign
    apart = (cut > s) & (cut < e)
    apart[apart] = _TIP[low[cut[apart] - 1]]
    before = np.concatenate([[0], np.cumsum(apart)])
    n = len(s) + before[-1]
    at = np.arange(len(s)) + before[:-1]
    start, end = np.empty(n, np.int64), np.empty(n, np.int64)
    start[at], end[at] = s, np.where(apart, cut, e)
    start[at[apart] + 1], end[at[apart] + 1] = cut[apart], e[apart]
    return start, end, first + before[first]


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
