"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# What the jobs rely on. All but the time zone are Spark's own defaults; they
# are listed so that a cluster which turned them off sees what to turn on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app: str = "townsquare", **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder for one run's tables, below ``spark.checkpoint.dir`` or the
    folder given to ``SparkContext.setCheckpointDir``.

    There is no default: executors can be lost and do not share their disks, so
    the tables between two steps belong into a folder that all machines see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{base.rstrip('/')}/townsquare-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table and read it back: short lineage, exact sizes."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of this run. PySpark has no call of its own for that on
    any file system, so this goes through the JVM's."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm_path.getFileSystem(conf).delete(jvm_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scratch folder that is gone when the block ends, however it ends. What
    is to outlive it goes through :func:`kept`."""
    folder = scratch_folder(spark)
    try:
        yield folder
    finally:
        discard(spark, folder)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint, which outlives the tables it was made
    from. Spark removes it with the last reference, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()
