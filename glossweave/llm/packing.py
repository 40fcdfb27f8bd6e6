"""Operator 1: documents packed into sequences of a fixed number of tokens, shortest pack first over the length histogram.

Each document's ids, closed by an end id, are cut into full pieces and a remainder. Only the histogram of piece lengths
(at most ``size`` numbers) goes to the driver, which places lengths longest first, each into the shortest pack that it
still fits, as counts of packing patterns. Pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.session import stored
from glossweave.llm import text as T
from glossweave.llm.tokenize import encoder

#: Bytes of texts encoded at a time.
AT_ONCE = 1 << 21


def encoded(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) by groups of texts; each text's ids end with ``end_id``; null counts as empty."""
    for i, j in T.slices(T.utf8(texts)[1], AT_ONCE):
        ids, offs = encoder(path).encode(texts.slice(i, j - i))
        size = np.diff(offs) + 1
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.full(at[-1], end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(j - i), size - 1)] = ids
        yield i, j, out, at


def crcs(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.fromiter((zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))


def pieces(docs: DataFrame, path: str, end_id: int, size: int, with_ids: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)  # pieces of each length so far in this task
        for batch in batches:
            doc, texts = batch.column(0), batch.column(1)
            for i, j, ids, at in encoded(texts, path, end_id):
                total = np.diff(at)
                n = -(-total // size)
                which = np.repeat(np.arange(j - i), n)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, total[which] - start)
                s = at[which] + start
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                first = np.searchsorted(sorted_, sorted_)
                rank = np.empty(len(length), np.int64)
                rank[order] = seen[sorted_] + np.arange(len(length)) - first
                seen += np.bincount(length, minlength=size + 1)
                cols = [doc.slice(i, j - i).take(pa.array(which)), pa.array(start), pa.array(length), pa.array(crcs(ids, s, s + length)), pa.array(total[which]), pa.array(np.full(len(which), task, np.int64)), pa.array(rank)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
                if with_ids:  # pieces of a text follow each other without a gap
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(s, at[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of packs, by shortest-pack-first over a histogram of lengths, longest first.

    Every step uses up a length or a pattern, so there are at most about twice as many patterns as lengths."""
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in by_room if r >= length), default=None)
            if room is None:
                take, pack = left, []
                room = size
            else:
                count, pack = by_room[room].pop()
                take = min(count, left)
                if take < count:
                    by_room[room].append((count - take, pack))
                if not by_room[room]:
                    del by_room[room]
            by_room.setdefault(room - length, []).append((take, [*pack, length]))
            left -= take
    return [p for room in sorted(by_room) for p in by_room[room]]


def places(packs: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """For every slot of every pattern: length, first rank there, first sequence, offset; by length and rank."""
    rows, used, base = [], {}, 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Each piece of each document and its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_pad[, ids].

    ``docs`` has doc_id and text; other columns are left out. A null or empty text is its end id alone; a repeated row is
    packed as often as it stands; no rows give no rows. Equal lengths are placed in the order in which tasks met them.
    n_pad is what fills the sequence up to ``size``; a sequence that ends at a power of two is left as it is (0).
    """
    found = stored(pieces(docs, path, end_id, size, with_ids), "pieces")
    counts = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packs = patterns(histogram, size)
    by_length, first_rank, base, offset = places(packs)
    key = (by_length << 44) + first_rank if len(by_length) else np.zeros(0, np.int64)
    bases = np.cumsum([0, *(c for c, _ in packs)])
    filled = np.array([sum(lengths) for _, lengths in packs], np.int64)
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            k = np.searchsorted(key, (length << 44) + rank, "right") - 1
            seq = base[k] + rank - first_rank[k]
            full = filled[np.searchsorted(bases, seq, "right") - 1]
            pad = np.where(full & (full - 1), size - full, 0)
            kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            cols = [b.column(c) for c in kept] + [pa.array(seq), pa.array(offset[k]), pa.array(pad)] + ([b.column("ids")] if with_ids else [])
            yield pa.RecordBatch.from_arrays(cols, kept + ["sequence_id", "offset", "n_pad"] + ["ids"] * with_ids)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_pad long" + ", ids array<int>" * with_ids
    return found.join(before, ["task", "length"]).mapInArrow(place, schema)
