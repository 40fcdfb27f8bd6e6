"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.session import checkpoint


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(id, root): every vertex of an edge between two different vertices, with the smallest vertex that it reaches.

    Alternating large-star and small-star rounds: each vertex hangs its larger neighbours, then its smaller ones, on the
    smallest vertex it sees, until every component is a star. Only minima are aggregated (with map-side combining), no
    neighbour list is gathered, and joins on a hub's key can be split by AQE. Each round is checkpointed, so neither the
    plan nor the loss of an executor grows with the number of rounds. Edges with a null end and loops are left out.
    """
    e = (
        edges.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    e, before = checkpoint(e), None
    for _ in range(max_rounds):
        both = e.select(F.col("big").alias("u"), F.col("small").alias("v")).union(e.select("small", "big"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
        low = large.groupBy("big").agg(F.min("small").alias("m"))
        e = checkpoint(
            large.join(low, "big")
            .select(F.explode(F.array(F.struct("big", F.col("m").alias("small")), F.struct(F.col("small").alias("big"), F.col("m").alias("small")))).alias("e"))
            .select("e.*")
            .where("big <> small")
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = e.select(F.col("big").alias("id"), F.col("small").alias("root"))
    return root.union(root.select(F.col("root").alias("id"), "root").distinct())
