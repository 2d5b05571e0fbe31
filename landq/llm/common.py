"""What the operators of this folder share: reading tables, cutting lineage, batch sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landq.session import shared_folder


def small_batches(spark: SparkSession, size: str = "8m") -> SparkSession:
    """Arrow batches by bytes, so that very long texts don't meet in one batch of thousands of rows.

    Also lets shuffle files go when the write that needed them has ended; steps read tables, not each other's shuffles.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A dictionary of up to this many bytes replaces repeated values in a column of a spool.
DICTIONARY = 8 << 20


def spool(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written to the shared folder and read again: later steps don't compute it anew, also after a lost executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).option("parquet.dictionary.page.size", DICTIONARY).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_spools(*spools: DataFrame | None) -> None:
    """Delete the files of spools that nothing reads any more, once what was computed from them is itself written."""
    for df in spools:
        if df is not None:
            context = df.sparkSession.sparkContext
            for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pick_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores behind it until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
