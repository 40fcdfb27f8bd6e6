"""Operator 10: token ids as ORC files in ascending document order, and their reading.

Documents are dealt by ranges of doc_id, sorted and encoded; Spark's ORC writer stores ids with run-length encoding,
row indexes and a Bloom filter on doc_id, so a reader skips files, stripes and row groups by document id and takes the
stripes of one file in parallel. Each row carries its place in its file; where a document starts in the whole stream
follows from the sizes read back.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.functions.session import shared_dir, shards, stored
from glossweave.llm.packing import crcs, encoded


def write(docs: DataFrame, out: str, path: str, end_id: int = 2) -> None:
    """ORC files under ``out``: row, doc_id, ids. Null texts are their end id alone; null ids come first."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        row = 0
        for b in batches:
            for i, j, ids, at in encoded(b.column(1), path, end_id):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + j - i)), b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["row", "doc_id", "ids"])
                row += j - i

    dealt = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(shards(spark), "doc_id").sortWithinPartitions("doc_id")
    (
        dealt.mapInArrow(encode, f"row long, doc_id {kind}, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.compress", "SNAPPY")
        .orc(out)
    )


def read(spark: SparkSession, out: str) -> DataFrame:
    """The rows of ``write``'s files with the name of their file."""
    return spark.read.orc(out).select("row", "doc_id", "ids", F.col("_metadata.file_name").alias("file"))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row read; starts count over files in the order of their names."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sizes(batches):
        for b in batches:
            ids = b.column("ids")
            at = ids.offsets.to_numpy().astype(np.int64)
            values = ids.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("row"), b.column("doc_id"), pa.array(np.diff(at)), pa.array(crcs(values, at[:-1], at[1:]))], ["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    per = rows.select("file", "row", "doc_id", "ids").mapInArrow(sizes, f"file string, row long, doc_id {kind}, n_tokens long, ids_crc32 long")
    per = stored(per, "sizes").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")))
    files = per.groupBy("file").agg(F.max("upto").alias("n"))  # one row a file
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return per.join(files, "file").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """``docs`` (doc_id, text; other columns are left out) written as ORC and described from the files.

    Repeated rows are written as often as they stand; no rows give no rows; ties of doc_id keep any order."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, out, path, end_id)
    if docs.isEmpty():
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    return digest(read(spark, out))
