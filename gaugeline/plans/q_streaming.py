"""Queries on streams: each runs a stream over files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.plans import views
from gaugeline.plans.q_catalogue import events, manifests
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import sql
from gaugeline.session import fresh_path
from gaugeline.streaming import streams


def status_stream(spark, sf):
    path = fresh_path(spark, "status-in")
    rows = events(spark, sf).select(F.col("user_id").cast("string").alias("run_id"), "status", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    rows.write.parquet(path)
    return spark.readStream.schema("run_id string, status string, ts timestamp, seq bigint").parquet(path)


@query("s1_stream_runs", sql("v_runs_log", "SELECT run_id, status FROM v_runs_log"))
def stream_runs(spark, sf):
    source, out = fresh_path(spark, "manifests-in"), fresh_path(spark, "runs")
    rows = manifests(spark, sf)
    rows.unionByName(rows.filter(F.col("status") == "processed")).write.json(source)
    runs = streams.stream_runs(streams.read_json_stream(spark, source, streams.MANIFEST_STREAM)).select("run_id", "status")
    streams.append_files(runs, out, fresh_path(spark, "cp"))
    return spark.read.schema("run_id string, status string").parquet(out)


@query("s2_stream_run_status", sql("v_runs_log", """
SELECT user_id::VARCHAR AS run_id, arg_max(status, {'ts': ts, 'e': event_id}) AS status, count(*) AS changes FROM v_runs_log GROUP BY 1"""))
def stream_run_status(spark, sf):
    out = fresh_path(spark, "status")
    streams.update_files(streams.stream_run_status(status_stream(spark, sf)), out, fresh_path(spark, "cp"))
    log = spark.read.schema("run_id string, status string, changed_at timestamp, changes bigint, batch_id int").option("recursiveFileLookup", "true").parquet(out)
    return streams.latest_rows(log, "run_id").select("run_id", "status", "changes")


@query("s3_stream_hourly", sql("v_runs_log", """
SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, captures, failures FROM (
  SELECT date_trunc('hour', ts) AS hour, count(*) AS captures, count(*) FILTER (WHERE status LIKE '%failed') AS failures FROM v_runs_log GROUP BY 1)
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""))
def stream_hourly(spark, sf):
    out = fresh_path(spark, "hourly")
    streams.append_files(streams.stream_hourly(status_stream(spark, sf)), out, fresh_path(spark, "cp"))
    rows = spark.read.schema("hour timestamp, captures bigint, failures bigint").parquet(out)
    return rows.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("s4_stream_cadence", """
WITH w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events),
g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 9 HOUR THEN 0 ELSE 1 END AS o, lead(ts) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, after, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
b AS (SELECT user_id, min(ts) AS first, max(ts) AS last, max(coalesce(after, TIMESTAMP '9999-01-01')) AS after, count(*) AS captures FROM s GROUP BY user_id, k),
r AS (SELECT user_id, 'session' AS kind, first AS started, last AS ended, captures FROM b, w WHERE last + INTERVAL 9 HOUR <= mark
  UNION ALL SELECT user_id, 'outage', last, NULL, NULL FROM b, w WHERE last + INTERVAL 9 HOUR <= mark UNION ALL SELECT user_id, 'outage', last, after, NULL FROM b, w WHERE after <= mark)
SELECT user_id::VARCHAR AS source, kind, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended, captures FROM r""")
def stream_cadence(spark, sf):
    """Sessions and outages of every user, with six hours as the expected interval."""
    out = fresh_path(spark, "cadence")
    rows = status_stream(spark, sf).withColumnRenamed("run_id", "source")
    streams.append_files(streams.stream_outages(rows, 360), out, fresh_path(spark, "cp"))
    stored = spark.read.schema(streams.CADENCE).parquet(out)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return stored.select("source", "kind", shown("started"), shown("ended"), "captures")


@query("s5_stream_match", sql("v_rows", """
SELECT run_id, tube_number, match_status, id_151, id_152, round(measurement_151, 6) AS measurement_151, round(measurement_152, 6) AS measurement_152, strategy FROM v_rows
WHERE run_id IN (SELECT run_id FROM v_items GROUP BY 1 HAVING count(DISTINCT side) = 2)"""))
def stream_match(spark, sf):
    source, out = (fresh_path(spark, n) for n in ("sets-in", "matches"))
    items = views.items(spark, sf)
    fields = [c for c in items.columns if c not in ("run_id", "side")]
    sets = items.groupBy("run_id", "side").agg(F.collect_list(F.struct(*fields)).alias("items")).join(views.datasets(spark, sf), ["run_id", "side"])
    # the sides arrive one after the other, the even runs' left side twice
    left, right = sets.filter("side = '151'"), sets.filter("side = '152'")
    checkpoint = fresh_path(spark, "cp")
    body = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.schema.fields if f.name != "run_id")
    for hour, part in enumerate((left, left.filter(views.run_number() % 2 == 0), right)):
        part.withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour))).write.mode("append").parquet(source)
        # what has come since the last start is one batch, read by as many tasks as it has files
        rows = spark.readStream.schema(f"run_id string, arrived timestamp, {body}").parquet(source)
        writer = streams.stream_pairs(rows).writeStream.foreachBatch(streams.match_pairs(out, body)).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    stored = streams.latest_matches(spark, out)
    return stored.select(
        "run_id", "tube_number", "match_status", "id_151", "id_152", r6("measurement_151").alias("measurement_151"), r6("measurement_152").alias("measurement_152"), "strategy"
    )
