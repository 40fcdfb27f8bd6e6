"""Operator 4: bytes that an earlier document already has, by byte strings of a fixed length, found through sorted suffixes.

Every string of ``length`` bytes holds ``length - SEED + 1`` seeds; the one with the least hash (the leftmost of equals) is its
anchor, so equal strings have equal anchors at equal offsets wherever they stand. Seeds that only one text has are ruled
out first (see exchange.py). For the others a shard sends, once, each distinct context: the bytes of all strings that one
anchor stands for. Contexts of one seed meet in one task. There the suffixes from the anchor on are put in order by a
merge sort whose comparisons find common extensions by binary search over prefix polynomial hashes; neighbours' common
extensions, checked on the bytes themselves, and hashes of what stands left of the anchor tell which strings are equal,
and so the smallest document of each. The answers return to the shards, where documents strike out what is covered.

A seed of very many texts (more than ``HOT_TEXTS``) would bring as many contexts to one task. Such a seed is split by the
longest context there is, the strings themselves: a shard sends each distinct string once, with its smallest document, dealt
by the string's own hash, so one string is one entry a shard and no task has more than its range of them. They go through
the same sort.

Hashes only bring things together: wherever contexts or strings count as equal, in a shard or in a range, their bytes have
been compared. Contexts of one shard that share a hash but not their bytes, sent or not, are named anew by a keyed cryptographic hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossweave.functions.session import salt
from glossweave.llm import exchange as X
from glossweave.llm import text as T

SEED = 18
#: Bytes of text, and contexts, that a task works on at once.
SLICE, AT_ONCE = 1 << 18, 4000
#: Texts beyond which a seed's strings are dealt by themselves.
HOT_TEXTS = 20_000
#: The bits of a seed's hash that choose anchors.
ORDER = np.uint64(((1 << 64) - 1) ^ ((1 << 20) - 1))
NEVER = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(seed hash, position, first string, last string, text) of each anchor; strings are named by their first byte."""
    n, w = len(data), length - SEED + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, none
    p = T.prefix_hash(data)
    with np.errstate(over="ignore"):
        h = (p[SEED:] - p[:-SEED]) * T.powers(n, True)[: n - SEED + 1]
    at = None
    if n < 1 << 20:  # the place in the low bits, so one minimum finds the least hash and the leftmost of equals
        least = (h & ORDER) | np.arange(len(h), dtype=np.uint64)
    else:
        least, at = h & ORDER, np.arange(len(h))
    reach = 1
    while reach < w:  # minima over twice as many seeds
        step = min(reach, w - reach)
        if at is None:
            least = np.minimum(least[step:], least[:-step])
        else:
            right = least[step:] < least[:-step]
            least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        reach += step
    if at is None:
        at = (least & ~ORDER).view(np.int64)
    room = np.diff(offs) - length + 1
    many = np.maximum(0, room)
    full = np.flatnonzero(many)
    if not len(full):
        return none.astype(np.uint64), none, none, none, none
    # a string's anchor differs from the one before it, or the text begins; strings across texts are left out
    new = np.zeros(n - length + 2, bool)
    new[1:-1] = at[1:] != at[:-1]
    inside = np.zeros(n - length + 2, np.int8)
    inside[offs[full]] += 1
    inside[offs[full] + many[full]] -= 1
    valid = np.cumsum(inside, dtype=np.int8).view(bool)
    new[offs[full]] = True
    first = np.flatnonzero(new & valid)
    doc = np.searchsorted(offs, first, "right") - 1
    last = np.minimum(np.append(first[1:], n), offs[doc] + many[doc]) - 1
    a = at[first]
    return T.mix(~h[a]), a, first, last, doc  # anchors have small hashes; mixed, these fall evenly into ranges


def context_hash(p: np.ndarray, position: np.ndarray, first: np.ndarray, end: np.ndarray, bits: int = 64) -> np.ndarray:
    """Of the bytes of a context and the place of its anchor in it."""
    with np.errstate(over="ignore"):
        return _top(T.mix(T.mix(T.span_hash(p, first, end)) + ((position - first) * 256 + (end - first)).astype(np.uint64)), bits)


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return h & np.uint64(((1 << 64) - 1) ^ ((1 << (64 - bits)) - 1))


def other_names(data: np.ndarray, first: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Names of contexts whose hash has misled."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([l]) + data[i : i + n].tobytes(), digest_size=8, key=salt()).digest(), "little") for i, n, l in zip(first.tolist(), size.tolist(), left.tolist(), strict=True)], np.uint64)


def strings_of(p: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, anchor's number) of every string that anchors stand for."""
    n = last - first + 1
    s = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    return _top(T.mix(T.span_hash(p, s, s + length)), bits), s, np.repeat(np.arange(len(n)), n)


def distinct(v: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct string, which one each row is), in order of hashes and then of bytes; a row's string starts at ``at``."""
    order = np.argsort(v, kind="stable")
    new = _news(v[order])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    k = np.flatnonzero(~new)
    if T.same(data, at[order[k]], data, at[order[lead[k]]], np.full(len(k), length)).all():
        which = np.empty(len(v), np.int64)
        which[order] = np.cumsum(new) - 1
        return order[new], which
    rows = np.ascontiguousarray(np.concatenate([v.astype(">u8").view(np.uint8).reshape(-1, 8), _rows(data, at, length)], axis=1))
    _, first, which = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, which.ravel()


def _rows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings that start at these places, one a row."""
    return data[at[:, None] + np.arange(length)]


def _seeds(data: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """Distinct seed hashes of each text's anchors."""
    h, _, _, _, doc = anchors(data, offs, length)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new]


#: What a shard's rows hold: contexts, contexts named anew, strings of hot seeds; which seeds are hot; which hashes misled.
CONTEXTS, RENAMED, STRINGS, SEEDS, MISLED = range(5)


def _contexts(dealt: DataFrame, back: DataFrame, length: int, parts: list[int], hot_texts: int, bits: int) -> DataFrame:
    """(part, shard, kind, data, size, left, least, most): a shard's distinct contexts of shared seeds, with their documents'
    range; of hot seeds the strings with their smallest document; and notes of the shard to itself."""
    ends, string_ends = X.bounds(len(parts)), X.bounds(len(parts), 64)

    def one(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        known, many = X.together(blobs)
        hot_seeds = known[many > hot_texts]
        ids = docs["doc_id"].cast(pa.int64())
        named = ~ids.is_null().to_numpy()
        ids = ids.fill_null(0).to_numpy()
        got: list[list[np.ndarray]] = [[] for _ in range(6)]
        flat, starts = T.utf8(docs["text"])
        spare: list[np.ndarray] = []  # hashes of contexts that are not sent
        strings: list[tuple[np.ndarray, ...]] = []
        for i, j in T.slices(starts, SLICE):
            data, offs = flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
            h, position, first, last, doc = anchors(data, offs, length)
            if not len(h):
                continue
            p, seed = T.prefix_hash(data), X.upper(h)
            keep = (X.lookup(seed, known) >= 0) & named[i + doc]
            if len(hot_seeds) and keep.any():
                hot = np.flatnonzero(keep & (X.lookup(seed, hot_seeds) >= 0))
                keep[hot] = False
                if len(hot):
                    v, s, k = strings_of(p, first[hot], last[hot], length, bits)
                    strings.append(_least(v, data, s, length, ids[i + doc[hot]][k]))
            hashes = context_hash(p, position, first, last + length, bits)
            spare.append(hashes[~keep & named[i + doc]])
            k = np.flatnonzero(keep)
            for g, x in zip(got, (seed[k], hashes[k], last[k] + length - first[k], position[k] - first[k], ids[i + doc[k]], starts[i] + first[k]), strict=True):
                g.append(x)
        shard = docs["__shard"][0].as_py()
        out: dict[str, list] = {f.name: [] for f in _SENT}

        def put(part: int, kind: int, *blobs: bytes) -> None:
            for name, x in zip(out, (parts[part], shard, kind, *blobs), strict=True):
                out[name].append(x)

        if len(hot_seeds):
            put(0, SEEDS, X.pack(hot_seeds), b"", b"", b"", b"")
        if strings:
            v, text, least = (np.concatenate(x) for x in zip(*strings, strict=True))
            v, text, least = _least(v, text.ravel(), np.arange(len(v)) * length, length, least)
            cut = np.concatenate([[0], np.searchsorted(v, string_ends, "right")])
            for part in np.flatnonzero(np.diff(cut)).tolist():
                k = slice(cut[part], cut[part + 1])
                put(part, STRINGS, squeezed(text[k]), v[k].tobytes(), b"", squeezed(least[k]), b"")
        if not sum(map(len, got[0])):
            return pa.table(out, _SENT)
        seed, hashes, size, left, doc, begin = (np.concatenate(g) for g in got)
        order = np.argsort(hashes)
        new = _news(hashes[order])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        alike = _alike(flat, begin, size, left, order, lead)
        sent = hashes[order][new]
        misled = np.union1d(hashes[order][~alike], sent[X.lookup(sent, np.sort(np.concatenate(spare))) >= 0])
        kind = np.full(len(hashes), CONTEXTS)
        if len(misled):  # all contexts of these hashes get other names
            rows = np.flatnonzero(X.lookup(hashes, misled) >= 0)
            hashes[rows], kind[rows] = other_names(flat, begin[rows], size[rows], left[rows]), RENAMED
            put(0, MISLED, X.pack(misled), b"", b"", b"", b"")
        order = np.lexsort((hashes, kind, seed)) if len(misled) else np.lexsort((hashes, seed))
        head = np.flatnonzero(_news(seed[order], kind[order], hashes[order]))
        least, most = np.minimum.reduceat(doc[order], head), np.maximum.reduceat(doc[order], head)
        rows = order[head]
        cut = np.concatenate([[0], np.searchsorted(seed[rows], ends)])
        for part in np.flatnonzero(np.diff(cut)).tolist():
            for kinds in (CONTEXTS, RENAMED):
                k = np.arange(cut[part], cut[part + 1])
                k = k[kind[rows[k]] == kinds]
                if len(k):
                    r = rows[k]
                    n = size[r]
                    pos = np.repeat(begin[r] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    put(part, kinds, squeezed(flat[pos]), n.astype(np.uint8).tobytes(), left[r].astype(np.uint8).tobytes(), squeezed(least[k]), squeezed(most[k]))
        X.trim()
        return pa.table(out, _SENT)

    return dealt.groupBy("__shard").cogroup(back.groupBy("shard")).applyInArrow(one, "part int, shard int, kind int, data binary, size binary, left binary, least binary, most binary")


def _news(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before them."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def squeezed(values: np.ndarray) -> bytes:
    """Bytes of an array, compressed: a shuffle's own codec leaves texts a half larger."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def opened(blobs: pa.ChunkedArray) -> list[bytes]:
    """What ``squeezed`` was given, for each row."""
    sizes = [(b, int.from_bytes(b[:8], "little")) for b in blobs.to_pylist()]
    return [pa.decompress(b[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b"" for b, n in sizes]


def _alike(data: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, rows: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Whether the contexts ``rows`` have the bytes and the place of the anchor of ``leads``; only others than these themselves are compared."""
    out = (size[rows] == size[leads]) & (left[rows] == left[leads])
    k = np.flatnonzero(out & (rows != leads))
    out[k] = T.same(data, begin[rows[k]], data, begin[leads[k]], size[rows[k]])
    return out


_SENT = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("data", "size", "left", "least", "most"))])
_TOLD = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("hash", pa.binary()), ("runs", pa.binary()), ("doc", pa.binary())])


def _least(v: np.ndarray, data: np.ndarray, at: np.ndarray, length: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bytes, smallest document) of distinct strings, in the order of ``distinct``."""
    first, which = distinct(v, data, at, length)
    least = np.full(len(first), NEVER)
    np.minimum.at(least, which, doc)
    return v[first], _rows(data, at[first], length), least


def common(p: np.ndarray, inv: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths, up to ``most``, of the common beginnings of what starts at a and b, by binary search on prefix hashes."""
    lo, hi = np.zeros_like(most), most.copy()
    with np.errstate(over="ignore"):
        while (live := lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (p[a + mid] - p[a]) * inv[a] == (p[b + mid] - p[b]) * inv[b]
            lo, hi = np.where(live & same, mid, lo), np.where(live & ~same, mid - 1, hi)
    return lo


def suffix_sort(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes data[start:start+size] put in order inside their groups, and the bytes that each shares with the one before it (0 at a group's first).

    A bottom-up merge sort of all groups at once: each element finds its rank in the neighbouring run by binary search,
    comparing by the first byte after the common extension. Neighbours are checked on the bytes; if hashes ever misled,
    the bytes themselves are sorted."""
    n = len(start)
    p, inv = T.prefix_hash(data), T.powers(len(data) + 1, True)
    padded = np.append(data, np.zeros(1, np.uint8))

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether a comes before b; equals by ``ties``."""
        most = np.minimum(size[a], size[b])
        k = common(p, inv, start[a], start[b], most)
        x, y = padded[start[a] + np.minimum(k, size[a])], padded[start[b] + np.minimum(k, size[b])]
        ended = k == most
        return np.where(ended, np.where(size[a] == size[b], ties, size[a] < size[b]), x < y)

    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.searchsorted(g, g)
    many = np.searchsorted(g, g, "right") - first
    width = 1
    while (active := np.flatnonzero(many > width)).size:
        at = active - first[active]
        run = at // width
        left = run % 2 == 0
        lo = (run + np.where(left, 1, -1)) * width  # the neighbouring run
        hi = np.minimum(lo + width, many[active])
        a, z = np.minimum(lo, hi), hi.copy()
        base = first[active]
        me = order[active]
        while (live := np.flatnonzero(a < z)).size:
            mid = (a[live] + z[live]) // 2
            other = order[base[live] + mid]
            less = before(other, me[live], ~left[live])  # of equals the left run's come first
            a[live] = np.where(less, mid + 1, a[live])
            z[live] = np.where(less, z[live], mid)
        ahead = a - np.minimum(lo, hi)
        to = base + (run - run % 2) * width + at % width + ahead
        new = order.copy()
        new[to] = me
        order = new
        width *= 2
    limit = int(size.max()) if n else 0
    cell = np.minimum(start[order][:, None] + np.arange(limit), len(data) - 1) if n else np.zeros((0, 0), np.int64)
    rows = np.where(np.arange(limit) < size[order][:, None], data[cell].astype(np.int16), -1) if n else np.zeros((0, 0), np.int16)
    share = _share(rows, g)
    found = np.concatenate([[0], common(p, inv, start[order][1:], start[order][:-1], np.minimum(size[order][1:], size[order][:-1]))])[:n] if n > 1 else np.zeros(n, np.int64)
    found[first == np.arange(n)] = 0
    if (share != found).any():
        sort = np.lexsort([*rows.T[::-1], g])
        order, share = order[sort], _share(rows[sort], g)
    return order, share


def _share(rows: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in its group; -1 stands after a row's end."""
    n = len(rows)
    out = np.zeros(n, np.int64)
    if n > 1:
        same = (rows[1:] == rows[:-1]) & (rows[1:] >= 0)
        out[1:] = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
        out[1:][g[1:] != g[:-1]] = 0
    return out


def smallest(data: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, doc: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each context and each offset of a string before its anchor, the smallest document that has the string (NEVER where the context has none).

    Contexts of one group have the same seed."""
    w = length - SEED + 1
    right = np.minimum(size - left, length)
    order, share = suffix_sort(data, begin + left, right, group)
    g, at = group[order], (begin + left)[order]
    fits = (left[order][:, None] >= np.arange(w)) & (right[order][:, None] >= length - np.arange(w))
    found = np.where(fits, doc[order][:, None], NEVER)
    edge = _news(g)
    p = T.prefix_hash(data)
    room = (w + 6) // 8  # the bytes before the anchors, eight at a time
    padded = np.concatenate([np.zeros(8 * room, np.uint8), data, np.zeros(8, np.uint8)])
    ahead = [T.eight(padded, at + 8 * (room - 1 - j)) for j in range(room)]
    for o in range(w):
        # neighbours of one segment have the bytes from the anchor on in common; only what stands left of it is left to compare
        ok = np.flatnonzero(fits[:, o])
        segment = np.cumsum(edge | (share < length - o))[ok]
        near = segment[1:] == segment[:-1]
        several = np.append(near, False) | np.append(False, near) if len(ok) else np.zeros(0, bool)
        rows, s = ok[several], segment[several]
        if not len(rows):
            continue
        before = T.span_hash(p, at[rows] - o, at[rows])
        sort = np.lexsort((before, s))
        rows, s, b = rows[sort], s[sort], before[sort]
        new = _news(s, b)
        head = np.flatnonzero(new)
        lead = np.repeat(head, np.diff(np.append(head, len(rows))))
        k = np.flatnonzero(~new)
        odd = [(ahead[j][rows[k]] ^ ahead[j][rows[lead[k]]]) >> np.uint64(64 - min(64, 8 * (o - 8 * j))) for j in range((o + 7) // 8)]
        if any(x.any() for x in odd):  # a hash misled: by the bytes themselves
            strings = data[(at[rows] - o)[:, None] + np.arange(length)]
            kinds = np.unique(np.column_stack([g[rows].astype("<u8").view(np.uint8).reshape(-1, 8), strings]).view(f"V{8 + length}").ravel(), return_inverse=True)[1].ravel()
            least = np.full(kinds.max() + 1, NEVER)
            np.minimum.at(least, kinds, doc[order[rows]])
            found[rows, o] = least[kinds]
            continue
        found[rows, o] = np.minimum.reduceat(doc[order[rows]], head)[np.cumsum(new) - 1]
    out = np.empty_like(found)
    out[order] = found
    return out


def _answers(contexts: DataFrame, length: int, bits: int) -> DataFrame:
    """(shard, kind, part, hash, runs, doc): for contexts that have strings of smaller documents, runs of offsets and those
    documents; for each string of a hot seed, in the shard's order, its smallest document; and the shard's notes."""

    def one(rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        told = [pa.table({"shard": rows["shard"], "kind": rows["kind"], "part": rows["part"], "hash": rows["data"], "runs": rows["size"], "doc": rows["least"]}, _TOLD).filter(pa.array(kind > STRINGS))]
        if (kind == STRINGS).any():
            told.append(_strings_told(rows.filter(pa.array(kind == STRINGS)), length))
        if (kind < STRINGS).any():
            told.append(_contexts_told(rows.filter(pa.array(kind < STRINGS)), length, bits))
        X.trim()
        return pa.concat_tables(told)

    return contexts.groupBy("part").applyInArrow(one, "shard int, kind int, part int, hash binary, runs binary, doc binary")


def _strings_told(rows: pa.Table, length: int) -> pa.Table:
    """The strings of all shards, sorted as suffixes among those of one hash; equals get the smallest document of all."""
    least = opened(rows["least"])
    sizes = [len(b) // 8 for b in least]
    v = np.frombuffer(b"".join(rows["size"].to_pylist()), np.uint64)
    doc = np.frombuffer(b"".join(least), np.int64)
    data = np.frombuffer(b"".join(opened(rows["data"])), np.uint8)
    least = doc.copy()
    order = np.argsort(v, kind="stable")
    near = ~_news(v[order])
    order = order[near | np.append(near[1:], False)]  # a hash that one shard alone has sent once has its answer
    edges = np.append(np.flatnonzero(_news(v[order])), len(order)) if len(order) else np.zeros(0, np.int64)
    a = 0
    while a < len(order):  # hashes by hashes
        z = edges[max(np.searchsorted(edges, a + AT_ONCE, "right") - 1, np.searchsorted(edges, a, "right"))]
        own = order[a:z]
        sort, share = suffix_sort(data, own * length, np.full(len(own), length), np.cumsum(_news(v[own])))
        head = np.flatnonzero(share < length)
        least[own[sort]] = np.repeat(np.minimum.reduceat(doc[own[sort]], head), np.diff(np.append(head, len(own))))
        a = z
    cut = np.cumsum([0, *sizes])
    none = pa.array([b""] * len(sizes), pa.binary())
    return pa.table({"shard": rows["shard"], "kind": rows["kind"], "part": rows["part"], "hash": none, "runs": none, "doc": pa.array([least[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())}, _TOLD)


def _near(p: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, length: int, first: int) -> list[np.ndarray]:
    """Two hashes of each context, of ``half`` bytes before the seed with it, and of the seed with what follows: every string holds
    the one or the other. What a context is too short for is its own number, from ``first`` on."""
    half, at = (length - SEED + 1) // 2, begin + left
    out = []
    for a, z, there in ((at - half, at + SEED, left >= half), (at, at + length - half, size - left >= length - half)):
        key = np.arange(first, first + len(begin)).astype(np.uint64)
        key[there] = T.mix(T.span_hash(p, a[there], z[there]))
        out.append(key)
    return out


def _related(keys: list[np.ndarray]) -> np.ndarray:
    """Which contexts share a hash of ``_near`` with another; others share no string, while a hash may relate too many."""
    out = np.zeros(len(keys[0]), bool)
    for key in keys:
        order = np.argsort(key)
        near = ~_news(key[order])
        out[order[near | np.append(near[1:], False)]] = True
    return out


def _contexts_told(rows: pa.Table, length: int, bits: int) -> pa.Table:
    size, left, least, most, hashes, same_as, seed, before, after, total = [], [], [], [], [], [], [], [], [], 0
    kinds = rows["kind"].to_pylist()
    texts = opened(rows["data"])
    for i, (text, n, k, lo, hi) in enumerate(zip(texts, rows["size"].to_pylist(), rows["left"].to_pylist(), opened(rows["least"]), opened(rows["most"]), strict=True)):
        own, n, k = np.frombuffer(text, np.uint8), np.frombuffer(n, np.uint8).astype(np.int64), np.frombuffer(k, np.uint8).astype(np.int64)
        at, p = np.cumsum(n) - n, T.prefix_hash(own)
        size.append(n), left.append(k), least.append(np.frombuffer(lo, np.int64)), most.append(np.frombuffer(hi, np.int64))
        same_as.append(context_hash(p, at + k, at, at + n, bits))
        hashes.append(other_names(own, at, n, k) if kinds[i] == RENAMED else same_as[-1])
        seed.append(T.span_hash(p, at + k, at + k + SEED))
        for x, y in zip((before, after), _near(p, at, n, k, length, total), strict=True):
            x.append(y)
        total += len(n)
    shard, renamed = (np.repeat(np.array(x), [len(y) for y in size]) for x in (rows["shard"].to_numpy(), np.array(kinds) == RENAMED))
    size, left, least, most, hashes, same_as, seed, before, after = (np.concatenate(x) for x in (size, left, least, most, hashes, same_as, seed, before, after))
    data = np.frombuffer(b"".join(texts), np.uint8)
    texts.clear()
    begin = np.cumsum(size) - size
    # equal contexts of several shards are one
    order = np.lexsort((same_as, seed))
    new = _news(same_as[order], seed[order])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    alike = _alike(data, begin, size, left, order, lead)
    if not alike.all():  # a hash misled: by the bytes themselves
        wide = np.zeros((len(size), 2 * length + 1), np.uint8)
        wide[:, 0] = left
        within = np.arange(size.sum()) - np.repeat(begin, size)
        wide[np.repeat(np.arange(len(size)), size), 1 + within] = data
        same_as = np.unique(np.column_stack([size.astype(np.uint8), wide]).view(f"V{2 * length + 2}").ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((same_as, seed))
        new = _news(same_as[order], seed[order])
    head = np.append(np.flatnonzero(new), len(order))
    r, one_doc = order[head[:-1]], np.minimum.reduceat(least[order], head[:-1])
    group = np.cumsum(np.diff(seed[r], prepend=seed[r[0]]) != 0)
    related = _related([before[r], after[r]])
    offsets = np.arange(length - SEED + 1)
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(r))
    a = 0
    while a < len(r):  # seeds by seeds, about AT_ONCE contexts at a time
        z = edges[max(np.searchsorted(edges, a + AT_ONCE, "right") - 1, np.searchsorted(edges, a, "right"))]
        k = np.arange(a, z)
        fits = (left[r[k]][:, None] >= offsets) & ((size - left)[r[k]][:, None] >= length - offsets)
        table = np.where(fits, one_doc[k][:, None], NEVER)
        some = k[related[k]]
        if len(some):
            n = size[r[some]]
            near = data[np.repeat(begin[r[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            table[related[k]] = smallest(near, np.cumsum(n) - n, n, left[r[some]], one_doc[some], group[some], length)
        # contexts for which some document of the shard is later than a string's smallest
        member = order[head[a] : head[z]]
        kind = np.repeat(k - a, np.diff(head[a : z + 1]))
        keep = table.min(axis=1)[kind] < most[member]
        member, m = member[keep], table[kind[keep]]
        change = np.ones(m.shape, bool)
        change[:, 1:] = m[:, 1:] != m[:, :-1]
        row, col = np.nonzero(change)
        end = np.append(col[1:], m.shape[1])
        end[np.append(row[1:] != row[:-1], True)] = m.shape[1]
        value = m[row, col]
        use = value < most[member][row]
        for x, y in zip(found, (shard[member[row]], hashes[member[row]], col, end, value, renamed[member[row]]), strict=True):
            x.append(y[use])
        a = z
    s, h, col, end, value, other = (np.concatenate(x) for x in found)
    by = np.lexsort((other, s))
    s, h, value, other, runs = s[by], h[by], value[by], other[by], np.column_stack([col[by], end[by]]).astype(np.uint8)
    cut = np.append(np.flatnonzero(_news(s, other)) if len(s) else [], len(s)).astype(np.int64)
    out_shard, out_kind, out_hash, out_runs, out_doc = [], [], [], [], []
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        out_shard.append(int(s[a]))
        out_kind.append(RENAMED if other[a] else CONTEXTS)
        out_hash.append(h[a:z].tobytes())
        out_runs.append(runs[a:z].tobytes())
        out_doc.append(value[a:z].tobytes())
    n = len(out_shard)
    return pa.table({"shard": out_shard, "kind": out_kind, "part": [0] * n, "hash": out_hash, "runs": out_runs, "doc": out_doc}, _TOLD)


class HotStrings:
    """A shard's strings of hot seeds in the order in which it sent them, with the smallest document of each."""

    def __init__(self, told: pa.Table, parts: list[int], length: int, bits: int):
        kind = told["kind"].to_numpy() if told.num_rows else np.zeros(0, np.int64)
        self.parts, self.length, self.bits = parts, length, bits
        self.told = told.filter(pa.array(kind == STRINGS))
        seeds = [X.unpack(told["hash"][int(k)].as_py())[0] for k in np.flatnonzero(kind == SEEDS)]
        self.seeds = np.unique(np.concatenate(seeds)) if seeds else np.zeros(0, np.uint64)
        self.distinct: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: list[tuple[np.ndarray, ...]] = []

    def note(self, data: np.ndarray, p: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, named: np.ndarray, base: int, text: int) -> None:
        """Holds a slice's distinct strings, and which of these its hot anchors stand for."""
        hot = np.flatnonzero((X.lookup(X.upper(h), self.seeds) >= 0) & named[doc]) if len(self.seeds) else ()
        if not len(hot):
            return
        v, s, _ = strings_of(p, first[hot], last[hot], self.length, self.bits)
        at, which = distinct(v, data, s, self.length)
        self.distinct.append((v[at], _rows(data, s[at], self.length)))
        self.held.append((base + first[hot], base + last[hot], text + doc[hot], which.astype(np.int32)))

    def struck(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(begins, ends, texts) of the bytes in strings that a smaller document has, slice by slice."""
        if not self.held:
            return
        sizes = [len(v) for v, _ in self.distinct]
        v, raw = (np.concatenate(x) for x in zip(*self.distinct, strict=True))
        self.distinct.clear()
        first, number = distinct(v, raw.ravel(), np.arange(len(v)) * self.length, self.length)
        least = np.full(len(first), NEVER)
        cut = np.concatenate([[0], np.searchsorted(v[first], X.bounds(len(self.parts), 64), "right")])
        place = {name: k for k, name in enumerate(self.parts)}
        for part, doc in zip(self.told["part"].to_pylist(), self.told["doc"].to_pylist(), strict=True):
            least[cut[place[part]] : cut[place[part] + 1]] = np.frombuffer(doc, np.int64)
        end = np.cumsum(sizes)
        for (first, last, text, which), a, z in zip(self.held, end - sizes, end, strict=True):
            n = last - first + 1
            s = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            text = np.repeat(text, n)
            gone = least[number[a:z][which]] < ids[text]
            s, text = s[gone], text[gone]
            head = np.flatnonzero(np.append(True, (s[1:] != s[:-1] + 1) | (text[1:] != text[:-1]))[: len(s)])  # runs of strings
            yield s[head], s[np.append(head[1:], len(s)) - 1] + self.length if len(head) else s, text[head]


def _by_name(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, run of offsets, smallest document) of answers, sorted by name."""
    key = np.frombuffer(b"".join(found["hash"].to_pylist()), np.uint64)
    runs = np.frombuffer(b"".join(found["runs"].to_pylist()), np.uint8).reshape(-1, 2).astype(np.int64)
    least = np.frombuffer(b"".join(found["doc"].to_pylist()), np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], runs[order], least[order]


def _spans(begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, texts) of the maximal runs that these stretches cover; a run stays in its text."""
    order = np.argsort(begin)
    begin, text, end = begin[order], text[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > end[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return begin[head], end[np.append(head[1:], len(begin)) - 1] if len(head) else end, text[head]


def dedup(docs: DataFrame, length: int = 50, cleaned: bool = False, hot_texts: int = HOT_TEXTS, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with ``cleaned``, all columns of ``docs`` with what is kept as text.

    ``docs`` has doc_id (an integer) and text. Null counts as empty text (with ``cleaned`` it stays null); texts shorter than
    ``length`` bytes keep all; rows of one doc_id do not strike out each other; a null doc_id strikes out nothing and keeps
    all; no rows give no rows. Of a character that is cut in two, ``cleaned`` drops the rest. ``bits`` of the hashes of
    contexts and strings are used; fewer bring more work and the same rows.
    """
    if not SEED <= length <= 64:
        raise ValueError(f"strings of {SEED} to 64 bytes can be sought, not of {length}")
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if cleaned else []
    parts = X.shard_labels(docs)
    dealt = X.sharded(docs, *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")] if others else []))
    back = X.shared(X.sent(dealt, lambda d, o: _seeds(d, o, length), parts, SLICE))
    answers = _answers(_contexts(dealt, back, length, parts, hot_texts, bits), length, bits)
    kept = [f for f in dealt.schema.fields if f.name != "__shard"] if cleaned else []

    def one(own: pa.Table, found: pa.Table) -> pa.Table:
        ids = own["doc_id"].cast(pa.int64())
        named = ~ids.is_null().to_numpy()
        ids = ids.fill_null(0).to_numpy()
        kind = found["kind"].to_numpy() if found.num_rows else np.zeros(0, np.int64)
        strings = HotStrings(found.filter(pa.array((kind == STRINGS) | (kind == SEEDS))), parts, length, bits)
        misled = [X.unpack(found["hash"][int(k)].as_py())[0] for k in np.flatnonzero(kind == MISLED)]
        misled = np.unique(np.concatenate(misled)) if misled else np.zeros(0, np.uint64)
        answers_of = {k: _by_name(found.filter(pa.array(kind == k))) for k in (CONTEXTS, RENAMED)}
        flat, starts = T.utf8(own["text"])
        covers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        for i, j in T.slices(starts, SLICE) if any(len(x[0]) for x in answers_of.values()) or len(strings.seeds) else ():
            data, offs = flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
            seed, position, first, last, doc = anchors(data, offs, length)
            if not len(seed):
                continue
            p = T.prefix_hash(data)
            strings.note(data, p, seed, first, last, doc, named[i:], starts[i], i)
            h = context_hash(p, position, first, last + length, bits)
            other = X.lookup(h, misled) >= 0
            h[other] = other_names(data, first[other], last[other] + length - first[other], position[other] - first[other])
            for kinds, (key, runs, least) in answers_of.items():
                a = np.searchsorted(key, h)
                row = np.flatnonzero((other == (kinds == RENAMED)) & (key[np.minimum(a, len(key) - 1)] == h)) if len(key) else np.zeros(0, np.int64)
                n = np.searchsorted(key, h[row], "right") - a[row]
                k = np.repeat(a[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
                row = np.repeat(row, n)
                use = (least[k] < ids[i + doc[row]]) & named[i + doc[row]]
                k, row = k[use], row[use]
                at = starts[i] + position[row]
                covers.append((at - (runs[k, 1] - 1), at - runs[k, 0] + length, i + doc[row]))
        covers.extend(strings.struck(ids))
        begin, end, text = _spans(*(np.concatenate(x) for x in zip(*covers, strict=True)))
        n_spans = np.bincount(text, minlength=len(ids))
        n_removed = np.zeros(len(ids), np.int64)
        np.add.at(n_removed, text, end - begin)
        sha, kept_text = [], []
        view, at, cut, begin, end = memoryview(flat), starts.tolist(), np.concatenate([[0], np.cumsum(n_spans)]).tolist(), begin.tolist(), end.tolist()
        for d in range(len(ids)):
            a, z = cut[d], cut[d + 1]
            kept_bytes = [view[x:y] for x, y in zip([at[d], *end[a:z]], [*begin[a:z], at[d + 1]], strict=True)]
            if cleaned:
                kept_text.append(b"".join(kept_bytes).decode("utf-8", "ignore"))
            else:
                digest = hashlib.sha256()
                for x in kept_bytes:
                    digest.update(x)
                sha.append(digest.hexdigest())
        X.trim()
        if cleaned:
            new = pa.array(kept_text, pa.string(), mask=own["text"].is_null().to_numpy())
            return pa.table([new if f.name == "text" else own[f.name] for f in kept], names=[f.name for f in kept])
        return pa.table({"doc_id": own["doc_id"], "n_bytes": np.diff(starts), "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": pa.array(sha, pa.string())})

    schema = StructType(kept) if cleaned else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = dealt.groupBy("__shard").cogroup(answers.groupBy("shard")).applyInArrow(one, schema)
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`") for c in docs.columns)) if cleaned else found
