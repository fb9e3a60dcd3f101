"""Shared-folder tables: how operators cut lineage so that a lost executor costs a re-read, not a re-run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset: a folder of our own in local mode (tests), else an error,
    for executors don't see each other's disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="occasio-")
    return _own_root[app]


BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame, with the session's Arrow batches held to 8 MB (unless they already are smaller), so that what a
    Python worker gets at once does not grow with the length of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    try:
        now = int(conf.get(name, str(BATCH_BYTES + 1)))
    except ValueError:
        now = BATCH_BYTES + 1
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back. Returns the frame and its path."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/occasio-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by :func:`materialize` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
