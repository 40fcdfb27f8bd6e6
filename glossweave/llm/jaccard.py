"""Operator 9: all documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, as groups.

Of two linked sets, each holds at least threshold * size of the other's members, so both have a common n-gram among
their first ``size - ceil(threshold * size) + 1`` in any order that holds for all. The order is by the number of documents that
have the n-gram, counted over all documents; a set whose first n-grams are all its own links with nothing, and most sets end
there. Equal sets are one from there on. Sets that share a first n-gram form families (found without listing pairs), and
inside a family links are sought in tiles: bands of sizes that can link, cut into blocks of bounded size. In a tile,
set sizes and hashed bitmaps bound the overlap from above, and what passes is counted exactly on sorted arrays. A tile
returns a forest of links, which keeps every connection but not every pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.session import checkpoint, stored
from glossweave.llm import exchange as X
from glossweave.llm import text as T
from glossweave.operators.components import connected_components

#: Words of a bitmap, of 64 bits each.
WORDS = 16
#: Sets of a tile's block at most.
BLOCK = 1024


def shingles(data: np.ndarray, offs: np.ndarray, n: int, inside: np.ndarray = T.SOLID) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each text in a row, offsets); a text of fewer words is one n-gram, of none has none."""
    low = T.LOWER[data]
    s, e, first = T.words(low, offs, inside)
    h = T.word_hashes(low, s, e)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    g = T.ngrams(h, n)
    own = np.flatnonzero(doc[: len(g)] == doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
    values, owner = g[own], doc[own]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        values = np.concatenate([values, [T.ngrams(h[first[i] : first[i + 1]], int(count[i]))[0] for i in short]]).astype(np.uint64)
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(n * percent / 100)."""
    return (percent * n + 99) // 100


def _first(dealt: DataFrame, back: DataFrame, n: int, percent: int) -> DataFrame:
    """Of each document the size of its set, and of those that may link: a fingerprint, its set, and its shared first n-grams."""
    kind = dealt.schema["doc_id"].dataType

    def one(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        known, many = X.together(blobs)
        size, f1, f2, prefix, sets = [], [], [], [], []
        for i, j, data, offs in T.texts(docs["text"]):
            values, at = shingles(data, offs, n)
            where = X.lookup(X.upper(values), known)
            df = np.where(where >= 0, many[where] if len(many) else 1, 1)
            total = np.diff(at)
            alone = np.concatenate([[0], np.cumsum(df == 1)])
            alone = alone[at[1:]] - alone[at[:-1]]
            room = total - need(total, percent) + 1
            size.append(total)
            may = (total > 0) & (alone < room)
            for k in range(j - i):
                if not may[k]:
                    f1.append(None), f2.append(None), prefix.append(None), sets.append(None)
                    continue
                v, d = values[at[k] : at[k + 1]], df[at[k] : at[k + 1]]
                with np.errstate(over="ignore"):
                    f1.append(int(T.mix(v).sum().view(np.int64)))
                    f2.append(int(T.mix(v ^ np.uint64(T.BASE)).sum().view(np.int64)))
                shared = d > 1
                order = np.lexsort((v[shared], d[shared]))[: room[k] - alone[k]]
                # sets of so few that even one more member breaks the link are linked with equal sets only
                prefix.append(v[shared][order].view(np.int64).tolist() if total[k] * (100 - percent) >= percent else [])
                sets.append(v.tobytes())
        X.trim()
        return pa.table({"doc_id": docs["doc_id"], "n_shingles": np.concatenate(size) if size else np.zeros(0, np.int64), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "members": pa.array(sets, pa.binary())})

    schema = f"doc_id {kind.simpleString()}, n_shingles long, f1 long, f2 long, prefix array<long>, members binary"
    return dealt.groupBy("__shard").cogroup(back.groupBy("shard")).applyInArrow(one, schema)


def forest(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join all linked sets, each to one found before; with ``side``, only links between the two sides.

    A set is compared with sets that are not joined yet and whose size fits; bitmaps drop most, sorted arrays decide."""
    size = np.array([len(s) for s in sets])
    maps = np.zeros((len(sets), WORDS * 64), bool)
    for k, s in enumerate(sets):
        maps[k, s % np.uint64(WORDS * 64)] = True
    bits = np.packbits(maps, axis=1).view(np.uint64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    start = np.concatenate([[0], np.cumsum(size)])
    open_ = np.argsort(size, kind="stable")
    links = []
    while len(open_):
        wave, open_ = [int(open_[0])], open_[1:]
        while wave and len(open_):
            a = wave.pop()
            lo, hi = need(size[a], percent), size[a] * 100 // percent
            i, j = np.searchsorted(size[open_], [lo, hi + 1])
            near = open_[i:j]
            if side is not None:
                near = near[side[near] != side[a]]
            apart = np.bitwise_count(bits[near] ^ bits[a]).sum(axis=1)
            # overlap <= (|a| + |b| - differing bits) / 2, and a link needs 100 * overlap >= percent * (|a| + |b| - overlap)
            both = size[a] + size[near]
            near = near[(both - apart) * (100 + percent) >= 2 * percent * both]
            if not len(near):
                continue
            n = size[near]
            pos = np.repeat(start[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
            inside = X.lookup(flat[pos], sets[a]) >= 0
            overlap = np.add.reduceat(inside.astype(np.int64), np.cumsum(n) - n)
            near = near[overlap * (100 + percent) >= percent * (size[a] + n)]
            links += [(a, int(b)) for b in near]
            wave += near.tolist()
            open_ = open_[~np.isin(open_, near)]
    return links


#: A key with more than this share of a table's rows is joined apart; there are at most as many as its inverse.
HOT_SHARE = 1 / 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with a table that has each key once and, as ``copies``, how many rows have it.

    Keys with more than ``HOT_SHARE`` of all rows, at most 1 / HOT_SHARE of them, are broadcast, so their rows stay where
    they are; the others are joined as usual."""
    hot = F.broadcast(counted.where(F.col("copies") > max(1.0, total * HOT_SHARE)))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(counted, keys)
    return rows.join(hot, keys).unionByName(rest)


def _tiles(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): links between the sets of each family. ``members``: family, id, n, members."""
    kind = members.schema["id"].dataType.simpleString()
    ratio = math.log(100 / percent) * 1.01  # a little more than the threshold, so rounding parts no linked sizes
    size = checkpoint(members.groupBy("family").agg(F.count("*").alias("copies")))
    total = size.agg(F.sum("copies")).first()[0] or 0
    sized = join_counted(members, size, ["family"], total).withColumnRenamed("copies", "all").withColumn("band", F.when(F.col("all") > block, F.floor(F.log("n") / ratio)).otherwise(0).cast("int"))
    cells = checkpoint(sized.groupBy("family", "band").agg(F.count("*").alias("copies"))).withColumn("k", F.ceil(F.col("copies") / F.lit(block)).cast("int"))
    up = cells.select("family", (F.col("band") - 1).alias("band"), F.col("k").alias("k_up"))
    down = cells.select("family", (F.col("band") + 1).alias("band"), F.col("k").alias("k_down"))
    cells = cells.join(up, ["family", "band"], "left").join(down, ["family", "band"], "left")
    row = join_counted(sized, cells, ["family", "band"], total).withColumn("i", F.pmod(F.xxhash64("id", "f1"), F.col("k")).cast("int"))

    def tile(other_band: str, i: str, j: str, side: int) -> str:
        return f"named_struct('band', {other_band}, 'i', {i}, 'j', {j}, 'side', {side})"

    # a block meets itself and the others of its band, and all blocks of the bands beside it
    own = f"transform(sequence(0, k - 1), x -> {tile('2 * band', 'least(i, x)', 'greatest(i, x)', 'int(i > x)')})"
    above = f"if(k_up is null, array(), transform(sequence(0, coalesce(k_up, 1) - 1), x -> {tile('2 * band + 1', 'i', 'x', '0')}))"
    below = f"if(k_down is null, array(), transform(sequence(0, coalesce(k_down, 1) - 1), x -> {tile('2 * band - 1', 'x', 'i', '1')}))"
    dealt = row.select("family", "id", "members", F.explode(F.expr(f"concat({own}, {above}, {below})")).alias("t")).select("family", "t.*", "id", "members")

    def links(group: pa.Table) -> pa.Table:
        ids = group["id"]
        sets = [np.frombuffer(b, np.uint64) for b in group["members"].to_pylist()]
        side = group["side"].to_numpy()
        whole = group["band"][0].as_py() % 2 == 0 and group["i"][0].as_py() == group["j"][0].as_py()
        found = forest(sets, None if whole else side, percent)
        return pa.table({"a": ids.take(pa.array([x for x, _ in found], pa.int64())), "b": ids.take(pa.array([y for _, y in found], pa.int64()))})

    return dealt.groupBy("family", "band", "i", "j").applyInArrow(links, f"a {kind}, b {kind}")


def groups(docs: DataFrame, words: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the size of its set and the smallest id that links reach.

    ``docs`` has doc_id and text; other columns are left out. A null or empty text, or one without words, has no
    n-grams and no links; fewer words than ``words`` are one n-gram. Rows that repeat a doc_id give a row each and are one
    node; a null doc_id links with nothing and has a null component. No rows give no rows.
    """
    key = ["f1", "f2", "n_shingles"]
    names = X.shard_labels(docs)
    dealt = X.sharded(docs)
    back = X.shared(X.sent(dealt, lambda d, o: shingles(d, o, words)[0], names))
    found = stored(_first(dealt, back, words, percent), "sets")
    may = found.where("f1 is not null and doc_id is not null")
    # equal sets are one, named by the smallest document
    equal = checkpoint(may.groupBy(*key).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    total = equal.agg(F.sum("copies")).first()[0] or 0
    reps = may.join(equal.select(*key, F.col("id").alias("doc_id")), [*key, "doc_id"]).dropDuplicates(["doc_id", "f1", "f2"])
    reps = reps.select(F.col("doc_id").alias("id"), "f1", F.col("n_shingles").alias("n"), "prefix", "members")
    first = reps.select("id", F.explode("prefix").alias("gram"))
    least = first.groupBy("gram").agg(F.min("id").alias("m"), F.max("id").alias("z"), F.count("*").alias("copies")).where("m <> z")
    least = checkpoint(least.select("gram", "m", "copies"))
    grams = least.agg(F.sum("copies")).first()[0] or 0
    family = connected_components(join_counted(first, least, ["gram"], grams).select(F.col("id").alias("a"), F.col("m").alias("b")))
    members = stored(reps.join(family.withColumnRenamed("root", "family"), "id").select("family", "id", "f1", "n", "members"), "members")
    # rows of one doc_id with different texts are one node
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    twice = checkpoint(twice)
    same = may.join(twice, "doc_id", "left_semi").select("doc_id", *key).join(equal, key).select("doc_id", "id")
    root = connected_components(_tiles(members, percent, block).union(same))
    known = equal.join(root, "id", "left").select(*key, F.coalesce("root", "id").alias("component_id"), "copies")
    rest = found.where("f1 is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = join_counted(may.select("doc_id", *key), known, key, total).select("doc_id", "n_shingles", "component_id").union(rest)
    fixed = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("__least"))
    return out.join(fixed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("__least", "component_id").alias("component_id"))
