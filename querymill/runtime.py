"""Session defaults and written intermediate tables.

Intermediate results that are read more than once are written as Parquet tables in the shared
folder the cluster names in ``spark.checkpoint.dir``, so they survive the loss of executors and
cut the lineage.  Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "querymill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; keyword names use ``_`` for ``.``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # rows that are few but dear, such as queries to be exploded to prefixes, are not merged into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or for a local master our own."""
    context = spark.sparkContext
    set_dir = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="querymill-")
    context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/querymill-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, in a folder for each value of ``partition_by`` if given, and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_path(uri: str) -> str:
    """The path of a ``file:`` URI, for code that needs a mounted file system."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri} is not a mounted folder")
    return uri


def clear_written() -> None:
    """Delete every table written so far; frames that read them are unusable afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the session has ended
            pass


atexit.register(clear_written)
