"""Operator 2: benchmark passages in documents, by an FM-index of each training shard.

A shard is some ``SHARD`` bytes of whole documents. Its words become symbols of the benchmark's vocabulary; any other word,
and every document's end, is one separator, and runs too short for the shortest test phrase are left out, which loses no
occurrence. The suffix array of these symbols is sorted by prefix doubling; its Burrows-Wheeler transform is kept as a
wavelet matrix, all test phrases are searched backward through its ranks together, and occurrences are located by
walking to sampled suffix positions. Hit words are compared with the phrase's on their bytes, and merge into removal spans.
The benchmark goes to the executors in blocks of bounded size, one after the other: what a block hits is written before the
next one is read, so the driver and a worker hold one block. Nothing is gathered over shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from glossweave.functions.session import importable, stored
from glossweave.llm import exchange as X
from glossweave.llm import text as T
from glossweave.llm.license_scan import find

#: Characters of benchmark text that go to the executors at once; windows take some 20 times as many bytes.
BLOCK_CHARS = 4 << 20
#: Bytes of a shard.
SHARD = 6 << 20


class FMIndex:
    """Backward search over a sequence of small non-negative symbols; 0 separates and is never searched."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, rate: int = 16):
        self.n, self.rate = len(symbols) + 1, rate
        text = np.append(symbols.astype(np.int64) + 1, 0)  # an end mark below all symbols
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.levels = max(1, int(n_symbols + 1).bit_length())
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << self.levels) + 1))])
        self.ones, self.zeros = [], []
        now = bwt
        for k in range(self.levels - 1, -1, -1):
            bit = (now >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.bwt = bwt
        kept = sa % rate == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.samples = sa[kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c (internal code) stands in the transform before i."""
        start, end = np.zeros_like(i), i
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (c >> (self.levels - 1 - level)) & 1
            a, b = ones[start], ones[end]
            start, end = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, end - b)
        return end - start

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, given as rows padded on the left."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((k < lengths) & (lo < hi))
            c = patterns[live, width - 1 - k] + 1
            lo[live] = self.below[c] + self.rank(c, lo[live])
            hi[live] = self.below[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the row of the preceding symbol until a sampled position."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1)
        todo = np.arange(len(rows))
        while len(todo):
            r = at[todo]
            hit = self.kept[r + 1] > self.kept[r]
            out[todo[hit]] = self.samples[self.kept[r[hit]]] + steps[todo[hit]]
            todo = todo[~hit]
            c = self.bwt[at[todo]]
            at[todo] = self.below[c] + self.rank(c, at[todo])
            steps[todo] += 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that still tie are sorted anew. ``text`` ends with a unique smallest symbol."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    group = np.cumsum(np.diff(text[sa], prepend=text[sa[0]]) != 0)
    rank = np.empty(n, np.int64)
    # a rank is the first row of its group, so it stays as other groups split
    rows = np.arange(n)
    head = rows[np.searchsorted(group, group)]
    rank[sa] = head
    tied = np.flatnonzero(np.bincount(head, minlength=n)[head] > 1)
    k = 1
    while len(tied):
        s = sa[tied]
        first = rank[s]
        second = rank[np.minimum(s + k, n - 1)]
        order = np.lexsort((second, first))
        s, first, second = s[order], first[order], second[order]
        sa[tied] = s
        new = np.ones(len(s), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads = tied[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        rank[s] = heads
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(s)))
        tied = tied[np.repeat(size, size) > 1]
        k *= 2
    return sa


class Phrases:
    """Test phrases of one block of items: distinct windows as symbols, and the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        data, offs = T.utf8(pa.array([t or "" for _, t in items], pa.large_string()))
        low = T.LOWER[data]
        s, e, first = T.words(low, offs, T.ALNUM)
        self.vocab, at, code = np.unique(T.word_hashes(low, s, e), return_index=True, return_inverse=True)
        code = code.ravel().astype(np.int32)
        #: The bytes of each word of the vocabulary.
        self.size = e[at] - s[at]
        self.begin = np.cumsum(self.size) - self.size
        self.raw = low[np.repeat(s[at] - self.begin, self.size) + np.arange(self.size.sum())]
        if not self.spelled(low, s, e - s, code).all():
            raise RuntimeError("two words of the benchmark share a hash under this session's key; run again")
        n = np.diff(first)
        many = np.where(n > 0, np.maximum(1, n - width + 1), 0)
        item = np.repeat(np.arange(len(items)), many)
        start = np.repeat(first[:-1] - np.cumsum(many) + many, many) + np.arange(many.sum())
        size = np.minimum(n[item], width)
        rows = np.zeros((len(start), width), np.int32)  # symbols, padded on the left; 0 is no word
        for k in range(width):
            live = size > k
            rows[live, width - 1 - k] = code[start[live] + size[live] - 1 - k] + 1
        _, heads, which = np.unique(rows.view(f"V{4 * width}").ravel(), return_index=True, return_inverse=True) if len(rows) else (None, item, item)
        self.ids = ["" if k is None else str(k) for k, _ in items]
        self.rows, self.lengths = rows[heads].astype(np.int64), size[heads]
        both = np.unique(which.ravel().astype(np.int64) * max(1, len(items)) + item)
        window, self.items = np.divmod(both, max(1, len(items)))
        self.first_item = np.searchsorted(window, np.arange(len(heads) + 1))

    def spelled(self, low: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether words have the bytes of the vocabulary's words of these numbers."""
        out = size == self.size[code]
        live = np.flatnonzero(out)
        out[live] = T.same(low, start[live], self.raw, self.begin[code[live]], size[live])
        return out


def occurrences(p: Phrases, h: np.ndarray, doc: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in a shard, from its words' hashes, documents and places in ``data``."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(p.lengths) or not len(h):
        return none
    symbol = find(h, p.vocab) + 1
    # runs of known words of one document
    breaks = np.ones(len(h), bool)
    breaks[1:] = (doc[1:] != doc[:-1]) | (symbol[1:] == 0) | (symbol[:-1] == 0)
    start = np.flatnonzero(breaks)
    size = np.diff(np.append(start, len(h)))
    keep = (symbol[start] > 0) & (size >= p.lengths.min())
    start, size = start[keep], size[keep]
    if not len(start):
        return none
    into = np.cumsum(size + 1) - size - 1  # a separator follows each run
    seq = np.zeros(int((size + 1).sum()), np.int64)
    word = np.full(len(seq), -1)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    where = np.repeat(into, size) + inner
    word[where] = np.repeat(start, size) + inner
    seq[where] = symbol[word[where]]
    index = FMIndex(seq, len(p.vocab))
    lo, hi = index.search(p.rows, p.lengths)
    n = hi - lo
    rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    which, at = np.repeat(np.arange(len(n)), n), word[index.locate(rows)]
    # by the bytes: a word that only shares a hash makes no occurrence
    size = p.lengths[which]
    owner = np.repeat(np.arange(len(which)), size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    code = p.rows[which[owner], p.rows.shape[1] - size[owner] + inner] - 1
    pairs, pair = np.unique((at[owner] + inner) * len(p.vocab) + code, return_inverse=True)
    w, code = np.divmod(pairs, len(p.vocab))
    length = e[w] - s[w]
    begin = np.cumsum(length) - length
    good = p.spelled(T.LOWER[data[np.repeat(s[w] - begin, length) + np.arange(length.sum())]], begin, length, code)
    bad = np.bincount(owner, weights=~good[pair.ravel()], minlength=len(which)) > 0
    return which[~bad], at[~bad]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, cleaned: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, spans, items of every document; with ``cleaned``, all columns of ``docs``, n_words, spans and items.

    spans are the merged runs of hit words: (first word, words, start byte, end byte); items the ids, as strings, of
    benchmark items with a window in the document, sorted as strings. With ``cleaned``, text is without the bytes of the
    spans (null stays null), and of columns that have the new ones' names the new ones come back. Null and empty texts have
    no words; null or empty items have no windows; a null item_id is the empty string; repeated rows give a row each; an
    empty table gives no rows or no hits. Other columns of either table are not looked at.
    """
    importable(docs.sparkSession)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_chars))
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items")] if cleaned else ["doc_id"]
    row = F.struct(*(F.col(f"`{c}`") for c in names if c != "text")) if [c for c in names if c != "text"] else F.struct(F.lit(0).alias("none"))
    out = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    if n_blocks > 1:
        out = out.withColumns({"hits": F.array().cast(_HITS), "found": F.array().cast("array<string>")})
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        phrases = Phrases([(r["item_id"], r["text"]) for r in block.collect()], width)
        last = k == n_blocks - 1
        out = _with_hits(out, phrases, last=last, first=n_blocks == 1, cleaned=cleaned)
        if not last:  # written, so that a block leaves the driver and the plan
            out = stored(out, "hits")
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names), "n_words", "spans", "items")


_HITS = "array<struct<first:long,n:long,start:long,end:long>>"


def _with_hits(docs: DataFrame, p: Phrases, first: bool, last: bool, cleaned: bool) -> DataFrame:
    """``docs``: row, text[, hits, found]. Gives the same again or, last, row[, text], n_words, spans, items."""
    names = docs.columns
    kept = ["row"] + ["text"] * (cleaned or not last)
    text_at = names.index("text")
    hit_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "n", "start", "end")]))

    def rows(batches):
        X.trim()
        for batch in (b.slice(i, j - i) for b in batches for i, j in T.slices(T.utf8(b.column(text_at))[1], SHARD)):
            data, offs = T.utf8(batch.column(text_at))
            n = len(offs) - 1
            parts = []
            for i, j in T.slices(offs):
                low = T.LOWER[data[offs[i] : offs[j]]]
                s, e, f = T.words(low, offs[i : j + 1] - offs[i], T.ALNUM)
                parts.append((T.word_hashes(low, s, e), s + offs[i], e + offs[i], np.diff(f)))
            h, s, e, n_words = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
            n_words = n_words.astype(np.int64)
            doc = np.repeat(np.arange(n), n_words)
            word0 = np.concatenate([[0], np.cumsum(n_words)])
            which, at = occurrences(p, h.astype(np.uint64), doc, data, s, e)
            change = np.zeros(len(h) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + p.lengths[which] if len(at) else at, -1)
            if not first:
                for d, old in enumerate(batch.column(names.index("hits")).to_pylist()):
                    for x in old:
                        change[word0[d] + x["first"]] += 1
                        change[word0[d] + x["first"] + x["n"]] -= 1
            hit = np.cumsum(change[:-1]) > 0
            begin = hit.copy()
            begin[1:] &= ~hit[:-1] | (doc[1:] != doc[:-1])
            stop = hit.copy()
            stop[:-1] &= ~hit[1:] | (doc[1:] != doc[:-1])
            a, z = np.flatnonzero(begin), np.flatnonzero(stop)
            per = np.bincount(doc[a], minlength=n)
            offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
            flat = pa.StructArray.from_arrays([pa.array(x) for x in (a - word0[doc[a]], z - a + 1, s[a] - offs[doc[a]], e[z] - offs[doc[a]])], ["first", "n", "start", "end"])
            spans = pa.ListArray.from_arrays(offsets, flat).cast(hit_type)
            own: list[set] = [set() for _ in range(n)]
            pairs = np.unique(which + doc[at] * len(p.lengths)) if len(at) else at
            for x in pairs.tolist():
                d, w = divmod(x, len(p.lengths))
                own[d].update(p.ids[i] for i in p.items[p.first_item[w] : p.first_item[w + 1]])
            if not first:
                for d, old in enumerate(batch.column(names.index("found")).to_pylist()):
                    own[d].update(old)
            found = pa.array([sorted(x) for x in own], pa.list_(pa.string()))
            cols = [batch.column(names.index(c)) for c in kept]
            if cleaned and last and len(a):
                drop = np.zeros(len(data) + 1, np.int64)
                drop[s[a]] += 1
                np.add.at(drop, e[z], -1)
                keep = np.cumsum(drop[:-1]) == 0
                size = np.concatenate([[0], np.cumsum(keep)])[offs]
                old = batch.column(text_at)
                new = pa.LargeStringArray.from_buffers(n, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[keep].tobytes())).cast(pa.string())
                cols[kept.index("text")] = pa.compute.if_else(old.is_null(), pa.scalar(None, pa.string()), new)
            if last:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words), spans, found], [*kept, "n_words", "spans", "items"])
            else:
                yield pa.RecordBatch.from_arrays([*cols, spans, found], [*kept, "hits", "found"])

    more = f"n_words long, spans {_HITS}, items array<string>" if last else f"hits {_HITS}, found array<string>"
    return docs.mapInArrow(rows, StructType([docs.schema[c] for c in kept] + DataType.fromDDL(more).fields))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``scan``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
