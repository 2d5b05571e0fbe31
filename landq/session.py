"""Session settings the operators rely on, the shared work folder, and the one way lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings: UTC timestamps, and skewed join keys split at run time.

    Partition counts stay with the cluster; adaptive execution coalesces them.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below `spark.checkpoint.dir`, else below the warehouse."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from the files."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as compressed Parquet in the shared folder, read again: smaller than a checkpoint, above all where values repeat."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.dictionary.page.size", 8 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def transient_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the write or action that needed them has ended, for work that reads written tables in between."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
