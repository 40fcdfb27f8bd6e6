"""Reading tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import secrets
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: The variable by which Python workers learn the driver's random key.
_SALT = "GLOSSWEAVE_SALT"


def salt() -> bytes:
    """A key that the driver draws at random, the same in all workers of its session."""
    if _SALT not in os.environ:
        if TaskContext.get() is not None:
            raise RuntimeError("this worker has no key: call glossweave.functions.session.importable(spark) before the query")
        os.environ[_SALT] = secrets.token_hex(16)
    return bytes.fromhex(os.environ[_SALT])


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it lies here, whatever folder they start in, and know the driver's key."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, env.get("PYTHONPATH", "")) if p)
    env[_SALT] = salt().hex()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, through Spark's reader alone, so any store that Spark reads will do."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (local tests), one of our own."""
    global _own_dir
    importable(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="glossweave-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        where = f"file://{_own_dir}"
    if spark._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint; an executor's loss does not lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: compressed and column-pruned, for wide tables.

    The files stay until the folder is cleared; results read them lazily."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shards(spark: SparkSession) -> int:
    """Into how many parts whole-table steps are dealt: the session's number of shuffle partitions, which is to follow the input's size."""
    importable(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def local_session(app: str = "glossweave", cores: str | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cpus = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
