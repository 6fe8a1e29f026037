"""File sources and sinks: scans with explicit schemas, writers that can be run again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.runtime import delete, shared_folder


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A new folder among the shared ones, gone at the end."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _files(spark, path)
    return system.exists(where)


# ---- scans --------------------------------------------------------------------------------------


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file that is one JSON object."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def source_specs(spark: SparkSession, path: str, value: str, number: str, scope: list[int]) -> DataFrame:
    """The entries of a JSON map that are not comments (keys in _) and whose ``number`` is in scope, in its order."""
    return json_map(spark, path, value).where(~F.startswith("key", F.lit("_")) & F.col(f"value.{number}").isin(scope)).select("key", "value.*").orderBy(number)


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of lines 'token id', split at the last space. The blank must be token 0."""
    rows = spark.read.text(path).where("value <> ''").select(F.regexp_extract("value", r"^(.*) (\d+)$", 1).alias("token"), F.regexp_extract("value", r"^(.*) (\d+)$", 2).cast("int").alias("id"))
    first = rows.where("id = 0").select("token").collect()  # one row of a table of tens
    if [r["token"] for r in first] != ["<blank>"]:
        raise ValueError(f"token 0 must be <blank>, not {first}")
    return rows


def shards(spark: SparkSession, root: str, names: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the Parquet shards among ``names`` that exist, in ``root`` or nested below it."""
    there = [f"{root}/{n}" for n in names if exists(spark, f"{root}/{n}")]
    if not there:
        raise FileNotFoundError(f"none of {len(names)} shards in {root}")
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*there).select(*columns)


def sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """What ``sql`` says of every SQLite file at ``path``, opened from its bytes where they were read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import sqlite3

        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                with sqlite3.connect(":memory:") as base:
                    base.deserialize(content)
                    rows = base.execute(sql).fetchall()
                columns = list(zip(*rows)) or [()] * len(kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file from the driver."""
    system, where = _files(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


# ---- sinks --------------------------------------------------------------------------------------


def overwrite_csv(df: DataFrame, path: str) -> None:
    """Written beside the old files first, then put in their place: a failed write leaves the old ones."""
    spark = df.sparkSession
    new = f"{path}.{uuid.uuid4().hex}"
    df.write.option("header", True).csv(new)
    system, where = _files(spark, path)
    system.delete(where, True)
    if not system.rename(_files(spark, new)[1], where):
        raise OSError(f"could not move {new}")


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str, schema: str) -> None:
    """Rows whose key is not there yet are appended, so the same call can be made again."""
    spark = df.sparkSession
    fresh = df.join(csv(spark, path, schema).select(key).distinct(), key, "left_anti").select(*df.columns) if exists(spark, path) else df
    append_csv(fresh, path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").json(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    df.write.partitionBy(by).parquet(path)


def snapshot(*columns: str):
    """A JSON object with all its fields, in order, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of a Markdown table of ``df``, one row a line."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("line"))


def stream_into(df: DataFrame, write, state: str) -> None:
    """Runs a stream over all that is there now, ``write(batch, number)`` getting every micro-batch."""
    df.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
