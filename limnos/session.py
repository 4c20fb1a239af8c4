"""Spark session settings shared by jobs, tests and the bench.

Jobs never create their own session on a cluster: they take the one they are
given.  ``get_session`` is for local runs and tests only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every job relies on: wall-clock timestamps in UTC, ANSI casts
# (errors are explicit; lenient parsing goes through try_* functions),
# adaptive execution with skew-join splitting and partition coalescing.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Folders of many files are listed by this many tasks at most, not by one task a
    # folder (10,000 by default)
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # HotSpot does not JIT-compile methods over 8000 bytes of bytecode; a
    # wider whole-stage function would run interpreted.  At this limit Spark
    # splits such stages instead (the value its docs suggest for HotSpot).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "limnos", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("LIMNOS_DRIVER_MEMORY", "8g"))
               .config("spark.limnos.scanPartitions", str(shuffle_partitions)))
    for k, v in {**JOB_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_job_conf(spark)
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    for k, v in JOB_CONF.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system).  Only when it is unset (local tests) do we create one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="limnos-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder on a mounted file system, None elsewhere (an object store)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


# Folders that ``materialize`` has written, by application
_WRITTEN: dict[str, list[str]] = {}


def intermediate_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, on record for ``release``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df, name: str = "limnos"):
    """Write ``df`` once, as Parquet in the shared checkpoint folder, and continue from
    that table: survives executor loss, cuts the lineage, and a later reader takes
    only the columns it needs.  For tables a job reads more than once.

    With ``spark.limnos.materialize`` = false nothing is written and the plan stays whole,
    as plan tests and plan dumps want it.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.limnos.materialize", "true") == "false":
        return df
    path = intermediate_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession):
    """Gives a ``materialize`` whose tables are deleted when the block ends: for tables that
    only other tables written within the block are made of."""
    paths = []

    def keep(df, name: str = "passing"):
        if spark.conf.get("spark.limnos.materialize", "true") == "false":
            return df
        path = intermediate_path(spark, name)
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    yield keep
    for path in paths:
        _delete(spark, path)


# Spark's setting by which a finished execution deletes its shuffle files
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Writes made within this block delete their shuffle files when they end; otherwise
    these stay until the driver's next garbage collection.  For a job's intermediate tables,
    which are written once: a frame executed anew has to shuffle anew.  Enter it outside
    ``side_by_side``, since the setting holds for the whole session."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def side_by_side(spark: SparkSession, *jobs) -> list:
    """Run independent jobs (functions without arguments) at the same time and
    return their results in order: one job's planning and its last tasks overlap
    with the others' work.  Spark schedules the tasks of all of them."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; returns their number.
    For the end of a job: results read from them must have been written."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def assert_utc(spark: SparkSession) -> None:
    """Timestamps are wall-clock UTC; fail fast on another session zone."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    if tz not in ("UTC", "Etc/UTC", "GMT", "Z"):
        raise ValueError(f"session time zone must be UTC, found {tz}")
