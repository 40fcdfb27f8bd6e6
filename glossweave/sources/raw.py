"""Dump-like records made from the star-schema tables, in SQL for Spark and DuckDB alike, with rows that import must turn away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossweave.functions.session import table
from glossweave.sources.projection import over_views

_FAR = 1000000000

PARTS = {
    "raw_hot": "SELECT l_partkey, l_returnflag, o_orderkey, o_custkey, c_mktsegment, c_name, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50",
    "raw_ms": "SELECT 0 AS m UNION ALL SELECT 1 UNION ALL SELECT 2",
    "raw_langs": "SELECT c_mktsegment AS lang FROM customer UNION SELECT p_type FROM part",
    # pages of several namespaces
    "raw_page": """
        SELECT c_mktsegment AS lang, 'c' || CAST(c_custkey AS STRING) AS page_id, CAST(CASE WHEN c_nationkey % 9 = 8 THEN 2 ELSE 0 END AS STRING) AS namespace, c_name AS title FROM customer
        UNION ALL SELECT p_type, 'p' || CAST(p_partkey AS STRING), CAST(CASE WHEN p_size % 7 = 6 THEN 14 ELSE 0 END AS STRING), 'Part#' || CAST(p_partkey AS STRING) FROM part
        UNION ALL SELECT DISTINCT c_mktsegment, 'o' || CAST(o_orderkey AS STRING), '0', 'Order#' || CAST(o_orderkey AS STRING) FROM raw_hot
        UNION ALL SELECT lang, 'k' || CAST(m AS STRING), '14', 'Cat' || CAST(m AS STRING) FROM raw_langs CROSS JOIN raw_ms""",
    # all parts in one language, so that halves of their numbers make chains
    "chain_page": "SELECT 'xx' AS lang, CAST(p_partkey AS STRING) AS page_id, CAST(CASE WHEN p_partkey % 11 = 10 THEN 14 ELSE 0 END AS STRING) AS namespace, 'Part#' || CAST(p_partkey AS STRING) AS title FROM part",
    "chain_redirect": f"""
        SELECT 'xx' AS lang, CAST(p_partkey AS STRING) AS from_id, '0' AS namespace, 'Part#' || CAST(CAST(floor(p_partkey / 2.0) AS BIGINT) AS STRING) AS title FROM part WHERE p_size <= 10 AND p_partkey > 1
        UNION ALL SELECT 'xx', CAST(p_partkey + {_FAR} AS STRING), '0', 'Part#1' FROM part WHERE p_size = 11
        UNION ALL SELECT 'xx', CAST(p_partkey AS STRING), '14', 'Part#1' FROM part WHERE p_size = 12
        UNION ALL SELECT 'xx', CAST(p_partkey AS STRING), '4', 'Part#1' FROM part WHERE p_size = 13
        UNION ALL SELECT 'xx', CAST(p_partkey AS STRING), '0', 'Part#' || CAST(p_partkey + {_FAR} AS STRING) FROM part WHERE p_size = 14""",
    "raw_redirect": "SELECT DISTINCT c_mktsegment AS lang, 'o' || CAST(o_orderkey AS STRING) AS from_id, '0' AS namespace, c_name AS title FROM raw_hot",
    "raw_langlinks": f"""
        SELECT c_mktsegment AS lang, 'c' || CAST(o_custkey AS STRING) AS from_id, p_type AS to_lang, 'Part#' || CAST(l_partkey AS STRING) AS title FROM raw_hot
        UNION ALL SELECT p_type, 'p' || CAST(l_partkey AS STRING), c_mktsegment, 'Order#' || CAST(o_orderkey AS STRING) FROM raw_hot
        UNION ALL SELECT c_mktsegment, 'c' || CAST(o_custkey AS STRING), c_mktsegment, c_name FROM raw_hot WHERE l_returnflag = 'R'
        UNION ALL SELECT c_mktsegment, 'c' || CAST(o_custkey AS STRING), p_type, 'Part#' || CAST(l_partkey + {_FAR} AS STRING) FROM raw_hot WHERE l_returnflag = 'A'
        UNION ALL SELECT c_mktsegment, 'o' || CAST(o_orderkey AS STRING), p_type, 'Part#' || CAST(l_partkey AS STRING) FROM raw_hot WHERE l_returnflag = 'A'
        UNION ALL SELECT c_mktsegment, 'none' || CAST(o_custkey AS STRING), p_type, 'Part#' || CAST(l_partkey AS STRING) FROM raw_hot
        UNION ALL SELECT a.lang, 'k' || CAST(m AS STRING), b.lang, CASE WHEN m = 2 THEN 'Cat2' ELSE 'Category:Cat' || CAST(m AS STRING) END FROM raw_langs a CROSS JOIN raw_langs b CROSS JOIN raw_ms""",
    "raw_pagelinks": f"""
        SELECT c_mktsegment AS lang, 'c' || CAST(o_custkey AS STRING) AS from_id, '0' AS namespace, 'Order#' || CAST(o_orderkey AS STRING) AS title FROM raw_hot
        UNION ALL SELECT c_mktsegment, 'c' || CAST(o_custkey AS STRING), '14', 'Cat1' FROM raw_hot WHERE l_returnflag = 'N'
        UNION ALL SELECT c_mktsegment, 'none', '0', c_name FROM raw_hot WHERE l_returnflag = 'R'
        UNION ALL SELECT c_mktsegment, 'c' || CAST(o_custkey AS STRING), '0', 'Order#' || CAST(o_orderkey + {_FAR} AS STRING) FROM raw_hot WHERE l_returnflag = 'A'""",
    "raw_categorylinks": """
        SELECT c_mktsegment AS lang, 'c' || CAST(c_custkey AS STRING) AS from_id, 'Cat' || CAST(c_nationkey % 4 AS STRING) AS title FROM customer
        UNION ALL SELECT p_type, 'p' || CAST(p_partkey AS STRING), 'Cat' || CAST(p_size % 3 AS STRING) FROM part""",
}
_BASE = ("customer", "part", "orders", "lineitem")


def ctes(*names: str) -> str:
    keys = list(PARTS)
    last = max(keys.index(n) for n in names)
    return ",\n".join(f"{k} AS ({PARTS[k]})" for k in keys[: last + 1])


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Records of one kind."""
    return over_views(spark, f"WITH {ctes(name)} SELECT * FROM {name}", {t: table(spark, sf_dir, t) for t in _BASE})
