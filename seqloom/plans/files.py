"""File sources and sinks over the test tables: what is written is read again."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from seqloom.operators import curation, windows
from seqloom.plans.registry import query
from seqloom.runtime import cut, table
from seqloom.sources import files

NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, d):
    """A CSV is written, overwritten by a swap and read with its schema."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    with files.folder(spark) as path:
        files.overwrite_csv(n.limit(3), f"{path}/nation")
        files.overwrite_csv(n, f"{path}/nation")
        return cut(files.csv(spark, f"{path}/nation", NATION))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_append_once(spark, d):
    """K2, K3: appends with a header, of which the second and third add only what is new."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    with files.folder(spark) as path:
        for rows in (n.where("n_nationkey < 10"), n, n):
            files.append_new(rows, f"{path}/nation", "n_nationkey", NATION)
        return cut(files.csv(spark, f"{path}/nation", NATION))


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_roundtrip(spark, d):
    """Compressed JSON lines."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    with files.folder(spark) as path:
        files.write_jsonl(c, f"{path}/c")
        return cut(files.jsonl(spark, f"{path}/c", "conv_id bigint, turn bigint, role string, text string"))


@query("SELECT n_name AS key, n_nationkey AS number, n_regionkey AS region FROM nation WHERE n_nationkey BETWEEN 5 AND 14")
def spec_map(spark, d):
    """One JSON object; its comments and what is out of scope go."""
    n = table(spark, d, "nation").select("n_name", F.struct(F.col("n_nationkey").alias("number"), F.col("n_regionkey").alias("region")).alias("v"))
    extra = n.limit(1).select(F.lit("_meta").alias("n_name"), "v")
    whole = n.unionByName(extra).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "v")))).alias("value"))  # a dimension of 25 rows
    with files.folder(spark) as path:
        whole.coalesce(1).write.text(f"{path}/spec")
        return cut(files.source_specs(spark, f"{path}/spec/*.txt", "struct<number:int,region:int>", "number", list(range(5, 15))))


@query("SELECT token, CAST(row_number() OVER (ORDER BY token <> '<blank>', token) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT event_type AS token FROM events UNION ALL SELECT '<blank>')")
def token_ids(spark, d):
    """A text table of tokens and ids."""
    kinds = table(spark, d, "events").select(F.col("event_type").alias("token")).distinct()
    ids = kinds.withColumn("id", F.row_number().over(Window.orderBy("token"))).unionByName(spark.createDataFrame([("<blank>", 0)], "token string, id int"))  # a handful of types
    with files.folder(spark) as path:
        ids.select(F.concat_ws(" ", "token", "id")).write.text(f"{path}/tokens")
        return cut(files.token_table(spark, f"{path}/tokens"))


@query("SELECT source, doc_id, n_chars, octet_length(encode(text)) AS bytes FROM documents WHERE source IN ('src1', 'src2', 'src5')")
def shard_scan(spark, d):
    """Shards of which some are absent, flat or nested, two columns and one left as bytes."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.col("text").cast("binary").alias("raw"))
    with files.folder(spark) as path:
        docs.where("source = 'src1'").write.parquet(f"{path}/src1")
        docs.where("source in ('src2', 'src5')").withColumn("part", F.col("source")).write.partitionBy("part").parquet(f"{path}/nested")
        found = files.shards(spark, path, ["src0", "src1", "nested", "src9"], ["source", "doc_id", "n_chars", "raw"])
        return cut(found.select("source", "doc_id", "n_chars", F.octet_length("raw").cast("bigint").alias("bytes")))


@query("WITH r AS (SELECT source, row_number() OVER (ORDER BY source DESC) AS r FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, source FROM documents JOIN r USING (source) WHERE r <= 3")
def split_writer(spark, d):
    """K6: one writer for all splits; a reader of one split reads its files only."""
    s = windows.ranked_split(table(spark, d, "documents").select("doc_id", "source"), "source")
    with files.folder(spark) as path:
        files.write_split(s, f"{path}/s", "split")
        return cut(spark.read.parquet(f"{path}/s").where("split = 'test'").select("doc_id", "source"))


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","pending":' || CASE WHEN doc_id % 3 = 0 THEN '{"source":"' || source || '","reason":null}' ELSE 'null' END || '}' AS snapshot, CASE WHEN doc_id % 3 = 0 THEN source END AS source FROM documents""")
def snapshots(spark, d):
    """Nested state as JSON with its nulls, parsed again."""
    pending = F.when(F.col("doc_id") % 3 == 0, F.struct("source", F.lit(None).cast("string").alias("reason")))
    t = table(spark, d, "documents").select("doc_id", "lang", pending.alias("pending"))
    t = t.select("doc_id", files.snapshot("doc_id", "lang", "pending").alias("snapshot"))
    return t.select("doc_id", "snapshot", F.from_json("snapshot", "doc_id bigint, lang string, pending struct<source:string,reason:string>")["pending"]["source"].alias("source"))


@query("WITH r AS (SELECT n_regionkey AS first, min(n_nationkey) AS lo, max(n_nationkey) AS hi FROM nation GROUP BY n_regionkey) SELECT first, unnest(generate_series(lo, hi)) AS second FROM r UNION ALL SELECT first + 100, hi FROM r")
def truth_ranges(spark, d):
    """S19: '0:1-4 100:7' becomes a row for each key."""
    r = table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("lo"), F.max("n_nationkey").alias("hi"))
    text = F.format_string("%d:%d-%d  %d:%d", "n_regionkey", "lo", "hi", F.col("n_regionkey") + 100, "hi")
    return curation.parse_ranges(r.select(text.alias("truth")), "truth").select("first", "second")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def cached_scan(spark, d):
    """An intermediate table is written once and read by what follows."""
    with files.folder(spark) as path:
        table(spark, d, "documents").select("doc_id", "lang").write.parquet(f"{path}/cache")
        again = spark.read.parquet(f"{path}/cache")
        return cut(again.groupBy("lang").agg(F.count("*").alias("n")))


@query("SELECT '| ' || source || ' | ' || count(*) || ' | ' || sum(n_chars) || ' |' AS line FROM documents GROUP BY source")
def markdown_report(spark, d):
    """K9: an aggregate as lines of a Markdown table."""
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return files.markdown(g, ["source", "n", "chars"])


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_sink(spark, d):
    """A bounded run of a stream whose micro-batches are handed to a writer."""
    schema = table(spark, d, "events").schema
    with files.folder(spark) as path:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(d)
        files.stream_into(stream.select("event_type", "value"), lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}"), f"{path}/state")
        rows = spark.read.schema("event_type string, value double").parquet(f"{path}/out")
        return cut(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 3")
def sqlite_scan(spark, d):
    """A query inside an SQLite file."""
    import sqlite3

    with sqlite3.connect(":memory:") as base:
        for name, columns in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"])):
            base.execute(f"CREATE TABLE {name} ({', '.join(columns)})")
            rows = [tuple(r) for r in table(spark, d, name).select(*columns).collect()]  # dimensions of 25 and 5 rows
            base.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)
        base.commit()
        content = base.serialize()
    with files.folder(spark) as path:
        files.put(spark, f"{path}/base.sqlite", content)
        return cut(files.sqlite(spark, f"{path}/base.sqlite", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 3", "n_name string, r_name string"))
