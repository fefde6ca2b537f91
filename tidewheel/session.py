"""Session settings the jobs are written for."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
import warnings
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    master: str | None = None,
    app: str = "tidewheel",
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """A session for tests, benchmarks and spark-submit alike.

    Size limits that matter at scale: joins are broadcast only when Spark's own
    measured size is below ``autoBroadcastJoinThreshold``; larger sides take the
    sort-merge path, where AQE splits skewed partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16384")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's own below the cluster's shared checkpoint folder.

    It is removed when the Python process ends.  A local temporary folder is used only where
    the setting is absent and the master is local, i.e. in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if not folder and not local:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if folder and not local and urlsplit(folder).scheme in ("", "file"):
        _warn_once(folder)
    return _own_folder(spark, spark.sparkContext.applicationId, folder)


@functools.lru_cache(maxsize=None)
def _warn_once(folder: str) -> None:
    warnings.warn(f"spark.checkpoint.dir is {folder}: it must be a mount that all executors share", stacklevel=3)


_FOLDERS: dict[str, str] = {}


def _own_folder(spark: SparkSession, application_id: str, folder: str | None) -> str:
    if application_id not in _FOLDERS:
        root = folder.rstrip("/") if folder else tempfile.mkdtemp(prefix="tidewheel-")
        own = f"{root}/tidewheel-{application_id}-{uuid.uuid4().hex[:8]}"
        _FOLDERS[application_id] = own
        atexit.register(_remove, spark, own)
    return _FOLDERS[application_id]


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete what this application wrote for itself."""
    try:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception as error:  # the JVM may be gone; the folder is named, so it can be cleared
        warnings.warn(f"{folder} was not removed: {error}", stacklevel=1)


def cut_lineage(df):
    """Write ``df`` as a table in the shared folder and go on from there.

    Use it where a costly input is read by several jobs.  The table outlives lost
    executors and goes when the application ends; what its making shuffled goes at once.
    """
    path = f"{shared_folder(df.sparkSession)}/tidewheel-{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries run inside go when a query ends, instead of whenever the
    driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
