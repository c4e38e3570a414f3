"""Session helpers: a local session for tests/bench and a shared scratch folder.

On a cluster the session comes from the caller; nothing here overrides its
settings except where a setting is missing.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cores}]")
         .appName("corpuslab")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def is_single_process(master: str) -> bool:
    """True for ``local`` and ``local[...]``: driver and tasks share one machine's folders."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
    it is read from the session and never replaced. Where it is missing, a
    single-process session (``local[...]``, as in tests) gets a fresh temporary
    folder; any other master raises, as executors would not share one.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not is_single_process(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="corpuslab-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written stage tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _STAGE_TABLES.append(path)
    return path


#: Folders of the stage tables that this driver has written, until ``drop_stage_tables``.
_STAGE_TABLES: list[str] = []


def drop_stage_tables(spark: SparkSession) -> int:
    """Delete the stage tables written so far (through the file system that holds them); how many went.

    For the end of a job: DataFrames that still read them can't be used any more.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _STAGE_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(_STAGE_TABLES.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the table instead of recomputing
    feature extraction) and computes the plan exactly once — an eager
    ``checkpoint()`` of an uncached plan computes it twice (count, then write).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Estimates from here on are no sizes of inputs (a join's estimate is a product, an unknown one the largest long).
UNKNOWN_BYTES = 1 << 46


def tasks_for(df, task_bytes: int = 4 << 20) -> int | None:
    """How many tasks give each about ``task_bytes`` of ``df`` by Spark's estimate, at least one a core; None where the size isn't known.

    For steps that make many rows of a few bytes (texts to tokens): the adaptive planner sizes tasks by the bytes
    that go in, so what comes out would not fit a task's memory, and few large tasks keep some cores idle.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >= UNKNOWN_BYTES else max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))


@lru_cache(maxsize=None)
def once_per_worker(factory: Callable):
    """What ``factory`` returns, made at its first use in this process (e.g. a model in a Python worker)."""
    return factory()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpuslab`` importable in Python workers (Arrow UDFs, mapInPandas hooks).

    Functions defined in this package are pickled by reference, so executors must
    be able to import it. The package is zipped once on the driver and added with
    ``SparkContext.addPyFile`` (Spark distributes it to every executor); repeated
    calls for the same context are no-ops.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="corpuslab-pyfiles-")
    archive = shutil.make_archive(os.path.join(out_dir, "corpuslab"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(key)
