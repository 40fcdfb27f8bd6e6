"""Which hashes stand in more than one text: sorted hashes, packed, dealt by ranges of their value and counted there.

A task holds the distinct hashes of a shard of whole texts, cuts them at fixed range bounds and sends each range as one
row of packed differences, a few bytes a hash; so no row a hash passes through a shuffle, and a hash found everywhere is
one entry a shard. The range's counter returns to each shard what it needs, in the same form.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.session import shards

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None

#: Hashes are exchanged by their upper 48 bits. What shares them counts as shared; a chance match makes work, not errors.
BITS = 48


def pack(values: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted distinct values as byte-aligned differences, and their counts: a byte each, or only those that are not 1."""
    n = len(values)
    d = np.diff(values, prepend=np.uint64(0))
    base = int(d[0]) if n else 0
    if n:
        d[0] = 0
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if n else 1
    body = d.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes()
    counts = np.ones(n, np.int64) if counts is None else counts
    dense = np.count_nonzero(counts != 1) > n // 8
    usual = np.minimum(counts, 255) if dense else np.ones(n, np.int64)
    odd = np.flatnonzero(counts != usual).astype("<u4")
    return np.array([n, width, base, len(odd), dense], "<u8").tobytes() + odd.tobytes() + counts[odd].astype("<u8").tobytes() + body + (usual.astype(np.uint8).tobytes() if dense else b"")


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts)."""
    n, width, base, k, dense = np.frombuffer(blob, "<u8", 5).tolist()
    odd, more = np.frombuffer(blob, "<u4", k, 40), np.frombuffer(blob, "<u8", k, 40 + 4 * k)
    d = np.zeros((n, 8), np.uint8)
    d[:, :width] = np.frombuffer(blob, np.uint8, n * width, 40 + 12 * k).reshape(n, width)
    d = d.view("<u8").ravel()
    if n:
        d[0] = base
    counts = np.frombuffer(blob, np.uint8, n, 40 + 12 * k + n * width).astype(np.int64) if dense else np.ones(n, np.int64)
    counts[odd] = more
    return np.cumsum(d, dtype=np.uint64), counts


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in an order that the reader knows, a byte each, compressed, and the large ones apart."""
    odd = np.flatnonzero(counts >= 255).astype("<u4")
    usual = pa.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), codec="zstd", asbytes=True) if len(counts) else b""
    return np.array([len(counts), len(odd)], "<u8").tobytes() + odd.tobytes() + counts[odd].astype("<u8").tobytes() + usual


def unpack_counts(blob: bytes) -> np.ndarray:
    n, k = np.frombuffer(blob, "<u8", 2).tolist()
    if not n:
        return np.zeros(0, np.int64)
    out = np.frombuffer(pa.decompress(blob[16 + 12 * k :], decompressed_size=n, codec="zstd", asbytes=True), np.uint8).astype(np.int64)
    out[np.frombuffer(blob, "<u4", k, 16)] = np.frombuffer(blob, "<u8", k, 16 + 4 * k)
    return out


def upper(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BITS)


def labels(n: int) -> list[int]:
    """n numbers of which each is dealt to another of n partitions, in the partitions' order: Spark deals by Murmur3."""
    found = np.full(n, -1, np.int64)
    at = 0
    while (found < 0).any():
        k = np.arange(at, at + 8 * n + 64, dtype=np.uint32)
        part = (_murmur3(k).view(np.int32).astype(np.int64)) % n
        values, first = np.unique(part, return_index=True)
        new = found[values] < 0
        found[values[new]] = k[first[new]]
        at += len(k)
    return found.tolist()


def _murmur3(k: np.ndarray) -> np.ndarray:
    """Spark's hash of 32-bit integers: MurmurHash3 of four bytes, with the seed 42."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    with np.errstate(over="ignore"):
        h = turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(np.uint32(42) ^ h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for r, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(r))) * np.uint32(m)
        return h ^ (h >> np.uint32(16))


def shard_labels(docs: DataFrame) -> list[int]:
    """One shard a partition."""
    return labels(shards(docs.sparkSession))


def sharded(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """doc_id, text and more, dealt by a hash of doc_id; ``__shard`` says to which shard each row belongs."""
    names = shard_labels(docs)
    label = F.element_at(F.lit(names), (F.pmod(F.xxhash64("doc_id"), F.lit(len(names))) + 1).cast("int")).cast("int")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *columns, label.alias("__shard")).repartition(len(names), "__shard")


def bounds(n: int, bits: int = BITS) -> np.ndarray:
    """Ends of n equal ranges of values: first values beyond them or, of 64 bits, last values (which end a run of 2**32)."""
    if bits == 64:
        return np.array([((((k + 1) << 32) // n) << 32) - 1 for k in range(n)], np.uint64)
    return np.array([((k + 1) << bits) // n for k in range(n)], np.uint64)


def sent(dealt: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], parts: list[int], at_once: int = 1 << 21) -> DataFrame:
    """(part, shard, blob): the distinct hashes of each shard, with the number of texts that have each.

    ``hashes`` takes (bytes, offsets) of about ``at_once`` bytes of texts and gives the hashes of each text's distinct
    features, all texts in a row."""
    ends, names = bounds(len(parts)), np.array(parts, np.int32)
    at_text, at_shard = dealt.columns.index("text"), dealt.columns.index("__shard")

    def send(batches: Iterator[pa.RecordBatch]):
        from glossweave.llm import text as T

        trim()
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            own = b.column(at_shard).to_numpy()
            for shard in np.unique(own).tolist():
                for _, _, data, offs in T.texts(b.column(at_text).filter(pa.array(own == shard)), at_once):
                    held.setdefault(shard, []).append(upper(hashes(data, offs)))
        for shard in list(held):
            v, c = np.unique(np.concatenate(held.pop(shard)), return_counts=True)
            cut = np.concatenate([[0], np.searchsorted(v, ends)])
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(names[full]), pa.array(np.full(len(full), shard, np.int32)), pa.array([pack(v[cut[p] : cut[p + 1]], c[cut[p] : cut[p + 1]]) for p in full], pa.binary())], ["part", "shard", "blob"])
        trim()

    return dealt.mapInArrow(send, "part int, shard int, blob binary")


def trim() -> None:
    """Gives memory that a group's arrays took, and token tables of another operator, back to the system, as a worker goes on with others."""
    if tokenize := sys.modules.get("glossweave.llm.tokenize"):
        tokenize._open.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def shared(rows: DataFrame) -> DataFrame:
    """(shard, blob): of each shard's hashes those that at least two texts have, with their number of texts."""

    def count(group: pa.Table) -> pa.Table:
        shard = group["shard"].to_pylist()
        parts = [unpack(b) for b in group["blob"].to_pylist()]
        v = np.concatenate([x for x, _ in parts])
        order = np.argsort(v, kind="stable")
        s = v[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        start = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate([c for _, c in parts])[order], start)
        each = np.empty(len(s), np.int64)
        each[order] = np.repeat(total, np.diff(np.append(start, len(s))))
        out, k = [], 0
        for x, _ in parts:
            n = each[k : k + len(x)]
            k += len(x)
            out.append(pack(x[n > 1], n[n > 1]) if (n > 1).any() else None)
        keep = [i for i, b in enumerate(out) if b]
        trim()
        return pa.table({"shard": pa.array([shard[i] for i in keep], pa.int32()), "blob": pa.array([out[i] for i in keep], pa.binary())})

    return rows.groupBy("part").applyInArrow(count, "shard int, blob binary")


def together(blobs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of one shard's returned ranges, sorted."""
    parts = sorted((unpack(b) for b in blobs["blob"].to_pylist()), key=lambda x: int(x[0][0]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in parts]), np.concatenate([c for _, c in parts])


def lookup(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)
