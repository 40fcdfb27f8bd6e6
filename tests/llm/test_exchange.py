import numpy as np
from pyspark.sql import functions as F

from glossweave.llm import exchange as X


def test_labels_fall_to_partitions_one_each(spark):
    for n in (1, 2, 7, 51):
        names = X.labels(n)
        df = spark.createDataFrame([(k,) for k in names], "k int").repartition(n, "k").select("k", F.spark_partition_id().alias("p"))
        assert sorted((r["p"], r["k"]) for r in df.collect()) == list(enumerate(names))


def test_counts_survive_packing():
    for c in (np.zeros(0, np.int64), np.array([0, 1, 254, 255, 256, 10**12])):
        assert X.unpack_counts(X.pack_counts(c)).tolist() == c.tolist()
