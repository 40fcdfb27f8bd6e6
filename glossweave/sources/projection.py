"""A link graph projected from the star-schema tables, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from glossweave.functions.session import table

_EIGHT = "(SELECT 0 AS m UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7)"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


#: Each part may name those before it.
PARTS = {
    "hot": "SELECT l_partkey, l_returnflag, o_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50",
    "segments": "SELECT DISTINCT c_mktsegment AS lang FROM customer",
    "types": "SELECT DISTINCT p_type AS lang FROM part",
    "pages": f"""
        SELECT 'c:' || {_s("c_custkey")} AS key, c_mktsegment AS lang, 0 AS namespace, c_name AS title, CAST(NULL AS STRING) AS redirect_id FROM customer
        UNION ALL SELECT 'p:' || {_s("p_partkey")}, p_type, 0, 'Part#' || {_s("p_partkey")}, NULL FROM part
        UNION ALL SELECT DISTINCT 'o:' || {_s("o_orderkey")}, c_mktsegment, 0, 'Order#' || {_s("o_orderkey")}, 'c:' || {_s("o_custkey")} FROM hot JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT 'k:' || lang || ':' || {_s("m")}, lang, 14, 'Cat' || {_s("m")}, NULL FROM (SELECT lang FROM segments UNION SELECT lang FROM types) CROSS JOIN {_EIGHT}""",
    "langlinks": f"""
        SELECT 'p:' || {_s("l_partkey")} AS src_id, 'o:' || {_s("o_orderkey")} AS dst_id FROM hot
        UNION ALL SELECT 'c:' || {_s("o_custkey")}, 'p:' || {_s("l_partkey")} FROM hot WHERE l_returnflag = 'R'
        UNION ALL SELECT 'k:' || s.lang || ':' || {_s("m")}, 'k:' || t.lang || ':' || {_s("m")} FROM segments s CROSS JOIN types t CROSS JOIN {_EIGHT}""",
    "categorylinks": f"""
        SELECT 'c:' || {_s("c_custkey")} AS page_id, 'k:' || c_mktsegment || ':' || {_s("c_nationkey % 5")} AS category_id FROM customer
        UNION ALL SELECT 'c:' || {_s("c_custkey")}, 'k:' || c_mktsegment || ':' || {_s("5 + c_custkey % 3")} FROM customer
        UNION ALL SELECT 'p:' || {_s("p_partkey")}, 'k:' || p_type || ':' || {_s("CAST(replace(p_brand, 'Brand#', '') AS INT) % 5")} FROM part
        UNION ALL SELECT 'p:' || {_s("p_partkey")}, 'k:' || p_type || ':' || {_s("5 + p_size % 3")} FROM part""",
    "pagelinks": "SELECT page_id AS src_id, category_id AS dst_id FROM categorylinks",
}
_BASE = ("customer", "part", "orders", "lineitem")


def ctes(*names: str) -> str:
    """The parts up to those named, as the list after WITH."""
    keys = list(PARTS)
    last = max(keys.index(n) for n in names)
    return ",\n".join(f"{k} AS ({PARTS[k]})" for k in keys[: last + 1])


def files(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """(path, time, length) of the files of the tables that the graph is made from."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{sf_dir}/{t}.parquet" for t in _BASE])
    return sorted(tuple(r) for r in found.select("path", "modificationTime", "length").collect())


def over_views(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query whose tables are named plainly, over these DataFrames: each stands as a temporary view while the query is resolved."""
    tag = uuid.uuid4().hex
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{name}_{tag}")
    try:
        return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(tables) + r")\b", rf"\1 \2_{tag}", text)) if tables else spark.sql(text)
    finally:
        for name in tables:
            spark.catalog.dropTempView(f"{name}_{tag}")


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the projected graph; only what it names is read."""
    return over_views(spark, f"WITH {ctes(name)} SELECT * FROM {name}", {t: table(spark, sf_dir, t) for t in _BASE})
