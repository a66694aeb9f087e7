"""Streaming queries: files are streamed to the end into a table, which is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import places
from ..streaming import live
from .base import Tables, query, r6


def _streamed(out: DataFrame, idle_batches: bool = True) -> DataFrame:
    """Run a stream over all that its source has now, into Parquet, and read it.

    Without ``idle_batches`` no batch runs after the data: state with a timeout by the clock would ask for them for ever."""
    spark = out.sparkSession
    root = places.shared_folder(spark, "stream")
    name, kept = "spark.sql.streaming.noDataMicroBatches.enabled", spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set(name, str(idle_batches).lower())
    try:
        q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, kept)
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _written(d: DataFrame, parts: int = 3) -> str:
    """A folder of Parquet files, so a stream has several micro-batches to read."""
    path = places.shared_folder(d.sparkSession, "source")
    d.repartition(parts).write.parquet(path)
    return path


@query("SELECT md5(text) AS line_md5, COUNT(*) AS n FROM (SELECT regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text FROM conversations) GROUP BY 1")
def streamed_lines(t: Tables) -> DataFrame:
    """Lines of arriving files with the time at which they were read; the stamps are checked, then left out."""
    path = places.shared_folder(t.spark, "lines")
    t("conversations").select(F.regexp_replace("text", r"[\r\n]", " ").alias("value")).write.text(path)
    d = _streamed(live.stamped_lines(t.spark, path))
    return d.where("ts > TIMESTAMP '2020-01-01'").groupBy(F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, COUNT(*) AS n, avg(value) AS mean FROM events GROUP BY 1), m AS (SELECT MAX(ts) - INTERVAL '5 minutes' AS mark FROM events)
SELECT start, n, round(mean, 6) AS mean FROM w, m WHERE start + INTERVAL '1 hour' <= mark""")
def streamed_samples(t: Tables) -> DataFrame:
    """Means of windows of an hour that the watermark has passed."""
    path = _written(t("events").select("ts", "value"), 1)
    s = t.spark.readStream.schema("ts TIMESTAMP, value DOUBLE").parquet(path)
    return _streamed(live.sampled(s, "ts", "value", "5 minutes", "1 hour")).select("start", "n", r6("mean").alias("mean"))


@query("""WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM a),
r AS (SELECT user_id, island, MIN(event_type) AS kind, COUNT(*) AS n, string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) || ' ' AS text FROM b GROUP BY ALL)
SELECT user_id::VARCHAR AS file, kind, text, n FROM r QUALIFY island < MAX(island) OVER (PARTITION BY user_id)""")
def streamed_deltas(t: Tables) -> DataFrame:
    """Consecutive events of one type of a user joined by a stateful stream; the last run of each stays open."""
    e = t("events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("at"), F.col("event_type").alias("kind"), F.concat(F.col("event_id").cast("string"), F.lit(" ")).alias("text"))
    path = places.shared_folder(t.spark, "deltas")
    # Two batches, the earlier events first, each in a file order of its own.
    for i, part in enumerate((e.where("at < 5000"), e.where("at >= 5000"))):
        part.repartition(2).write.parquet(f"{path}/batch={i}")
    s = t.spark.readStream.schema("file STRING, at LONG, kind STRING, text STRING").option("maxFilesPerTrigger", 1000).parquet(path)
    return _streamed(live.merged_deltas(s, at="at"), idle_batches=False)


@query("""SELECT p.event_id, p.user_id, c.event_id AS call_id FROM events p LEFT JOIN events c ON c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL '10 minutes' WHERE p.event_type = 'purchase' AND (c.event_id IS NOT NULL OR p.ts < (SELECT MAX(ts) FROM events) - INTERVAL '1 day')""")
def streamed_pairs(t: Tables) -> DataFrame:
    """Results met with calls of the ten minutes before, stream to stream; results without one come out once the watermark is past."""
    path = _written(t("events").select("event_id", "user_id", "event_type", "ts"), 1)
    # A late end mark of each type moves the watermark on; it is left out again.
    last = t("events").agg(F.max("ts").alias("ts"))
    mark = last.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.explode(F.array(F.lit("click"), F.lit("purchase"))).alias("event_type"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    mark.coalesce(1).write.mode("append").parquet(path)
    read = lambda kind: t.spark.readStream.schema("event_id LONG, user_id LONG, event_type STRING, ts TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(path).where(F.col("event_type") == kind)
    calls = read("click").select("user_id", "ts", F.col("event_id").alias("name"))
    out = _streamed(live.paired_results(calls, read("purchase").select("event_id", "user_id", "ts"), "user_id", "10 minutes"))
    end = t("events").agg(F.max("ts").alias("end"))
    d = out.where("event_id >= 0").crossJoin(F.broadcast(end)).where(F.col("name").isNotNull() | (F.col("ts") < F.col("end") - F.expr("INTERVAL 1 DAY")))
    return d.select("event_id", "user_id", F.col("name").alias("call_id"))
