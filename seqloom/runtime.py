"""Session helpers: session factory, table loading and lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: An execution's shuffle files go when it ends; Arrow batches are bounded in bytes, not in rows alone; Parquet is read 512 rows at
#: a time, since long texts make batches of thousands of rows large.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def settle(spark: SparkSession) -> None:
    """Puts the session settings that the engine's memory and disk bounds rest on."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        global _own
        _own = _own or tempfile.mkdtemp(prefix="seqloom-checkpoint-")
        named = _own
    return named


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fewer(df: DataFrame, each: int) -> DataFrame:
    """``df`` in at most ``each`` partitions for every core of the job, which take its own one after another: as many files
    are written, and no row is moved. Tables that stay small have few files that way."""
    return df.coalesce(each * df.sparkSession.sparkContext.defaultParallelism)


def cut(df: DataFrame, each: int = 8) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    Never a local checkpoint: rows outlive the executor that made them.
    """
    spark = df.sparkSession
    settle(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return fewer(df, each).checkpoint(eager=True)


class Kept:
    """``df`` written as Parquet to the shared folder: a compressed lineage cut that is dropped by hand."""

    def __init__(self, df: DataFrame, each: int = 8, **options: str):
        self.spark = df.sparkSession
        settle(self.spark)
        options = {"compression": "zstd", "parquet.block.size": str(16 << 20)} | options  # small row groups: writers hold one each
        self.path = f"{shared_folder(self.spark)}/kept-{uuid.uuid4().hex}"
        try:
            fewer(df, each).write.options(**options).parquet(self.path)
        except BaseException:
            self.drop()
            raise
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; nothing computed from ``df`` later can be read any more."""
        delete(self.spark, self.path)


class Scratch:
    """Tables kept for the length of a job: ``with Scratch() as keep: a = keep(df)``. All go at its end, failed or not."""

    def __init__(self):
        self.held: dict[int, Kept] = {}

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, each: int = 8, **options: str) -> DataFrame:
        kept = Kept(df, each, **options)
        self.held[id(kept.df)] = kept
        return kept.df

    def drop(self, *tables: DataFrame) -> None:
        """These are done with before the job is."""
        for table in tables:
            self.held.pop(id(table)).drop()

    def __exit__(self, *_) -> None:
        for kept in self.held.values():
            kept.drop()
        self.held.clear()


def release(spark: SparkSession) -> None:
    """Nothing to do any more: an execution's shuffle files go when it ends."""
    settle(spark)
