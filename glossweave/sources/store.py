"""Stored tables: whole tables, replaced parts, and readers of other layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A whole table written anew; a second run replaces the first."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Parts of a stored table replaced by rows of ``df``, which names them by the columns ``by``; other parts stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replaced(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The table after such a replacement."""
    return old.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def read_jdbc(spark: SparkSession, url: str, name: str, user: str | None = None, password: str | None = None, **options: str) -> DataFrame:
    """A table of a database that is running elsewhere; the driver's jar must be on Spark's class path."""
    given = {"url": url, "dbtable": name, "user": user, "password": password, **options}
    return spark.read.format("jdbc").options(**{k: v for k, v in given.items() if v is not None}).load()


def read_legacy(spark: SparkSession, base: str, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, pages, langlinks) of a store with tables ``{prefix}comp``, ``{prefix}node`` and ``{prefix}link``: no redirects, all articles."""
    comp, node, link = (spark.read.parquet(f"{base}/{prefix}{t}") for t in ("comp", "node", "link"))
    return (
        comp.withColumn("namespace", F.lit(0)),
        node.withColumn("namespace", F.lit(0)).withColumn("redirect_id", F.lit(None).cast("string")),
        link,
    )
