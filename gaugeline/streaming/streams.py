"""Runs, status events and finished pairs as streams.

State is kept per run, hour or session and bounded by watermarks where the result allows
it.  Sinks are files keyed by the batch, so a batch that is replayed replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeline.functions import scalars as S
from gaugeline.operators import matching
from gaugeline.sources.scans import MANIFEST


def read_json_stream(spark: SparkSession, root: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.json(root)


def stream_runs(manifests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per run id as manifests appear; repeats within the delay are dropped."""
    rows = manifests.filter(F.col("run_id").isNotNull()).withColumn("captured_ts", S.parse_iso_utc(F.col("captured_at")))
    return rows.withWatermark("captured_ts", delay).dropDuplicatesWithinWatermark(["run_id"])


def stream_run_status(events: DataFrame) -> DataFrame:
    """Current status per run; no watermark, so use update or complete mode."""
    return events.groupBy("run_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("changed_at"), F.count(F.lit(1)).alias("changes")
    )


def stream_hourly(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Captures and failures per hour, emitted when the hour can no longer change."""
    hour = F.window("ts", "1 hour")
    counted = events.withWatermark("ts", delay).groupBy(hour).agg(
        F.count(F.lit(1)).alias("captures"), F.count_if(F.col("status").endswith("failed")).alias("failures")
    )
    return counted.select(F.col("window.start").alias("hour"), "captures", "failures")


def stream_cadence(events: DataFrame, interval_minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Unbroken capture sessions per source; a pause of 1.5 intervals ends a session."""
    gap = f"{int(interval_minutes * 90)} seconds"
    sessions = events.withWatermark("ts", delay).groupBy("source", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("captures"))
    return sessions.select("source", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ends"), "captures")


CADENCE = "source string, kind string, started timestamp, ended timestamp, captures long"


def stream_outages(events: DataFrame, interval_minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Sessions and outages per source, by timers on event time.

    Captures wait until the watermark has passed them, and are taken in order. When none has come for 1.5 intervals, the session
    is emitted and an outage begins (`ended` null); the capture that ends it emits the outage once more, with its end. The state of
    a source is its open session and the captures that still wait.
    """
    gap = int(interval_minutes * 90_000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, captures, waiting = state.get if state.exists else (None, None, 0, [])
        waiting = sorted([*waiting, *(int(t.value // 1_000_000) for rows in batches for t in rows["ts"])])
        now, out = state.getCurrentWatermarkMs(), []
        # a session without captures means that an outage is on since `last`
        while waiting and waiting[0] <= now:
            at = waiting.pop(0)
            if last is not None and captures and at - last >= gap:
                out += [("session", first, last, captures), ("outage", last, None, None)]
                captures = 0
            if last is not None and not captures:
                out.append(("outage", last, at, None))
            first, last, captures = (at if not captures else first), at, captures + 1
        if captures and last + gap <= now:
            out += [("session", first, last, captures), ("outage", last, None, None)]
            captures = 0
        state.update((first, last, captures, waiting))
        due = [t for t in (waiting[0] if waiting else None, last + gap if captures else None) if t is not None]
        if due:
            state.setTimeoutTimestamp(max(min(due), now + 1))
        time = lambda ms: None if ms is None else pd.Timestamp(ms, unit="ms")
        yield pd.DataFrame(
            [(key[0], kind, time(a), time(b), n) for kind, a, b, n in out], columns=["source", "kind", "started", "ended", "captures"]
        ).astype({"started": "datetime64[ns]", "ended": "datetime64[ns]", "captures": "Int64"})

    watched = events.withWatermark("ts", delay).select("source", "ts").groupBy("source")
    return watched.applyInPandasWithState(follow, CADENCE, "first long, last long, captures long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


PAIRED = "run_id string, left string, right string, expired boolean"
WAITING = "runs array<string>, sides array<string>, bodies array<string>, since array<long>, due array<long>"
#: Keys of the state of waiting sides. A call per key costs about two milliseconds whatever it does, so a key holds several runs.
CELLS = 1 << 14


def stream_pairs(sets: DataFrame, wait: str = "30 days", delay: str = "10 minutes", cells: int = CELLS) -> DataFrame:
    """Both sides of a run once they have come, from data sets (run_id, side, arrived, ...) as JSON texts `left` and `right`.

    A side waits in the state of its run; one that comes again replaces the waiting one. A complete pair is emitted once and its
    state goes. A side that has waited for `wait` without the other is emitted alone, marked `expired`. Runs share the state of
    a cell, one of `cells` by their hash: of the waiting sides a batch reads and writes those in the cells of its runs, no others.
    The number of cells belongs to a checkpoint; it must not change between starts.
    """
    longest = int(pd.Timedelta(wait).total_seconds() * 1000)
    cell = F.pmod(F.hash("run_id"), F.lit(cells))
    whole = sets.select(
        cell.alias("cell"), "run_id", "side", "arrived", F.to_json(F.struct(*[c for c in sets.columns if c not in ("run_id", "arrived")])).alias("body")
    )

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {run: one for run, *one in zip(*state.get)} if state.exists else {}
        now, out, touched = state.getCurrentWatermarkMs(), [], set()
        # lists, as a frame per step costs more than all the rest
        rows = [] if state.hasTimedOut else [row for b in batches for row in zip(b["arrived"], b["run_id"], b["side"], b["body"])]
        for arrived, run, side, body in sorted(rows, key=lambda row: row[0]):
            touched.add(run)
            side = "151" if side == "151" else "152"
            have, held, since, _ = waiting.pop(run, (side, None, 0, 0))
            if have != side:
                out.append((run, held, body, False) if have == "151" else (run, body, held, False))
            else:
                since = max(since, int(arrived.value // 1_000_000))
                waiting[run] = (side, body, since, max(since + longest, now + 1))
        for run in [run for run, (*_, due) in waiting.items() if due < now and run not in touched]:
            side, body, *_ = waiting.pop(run)
            out.append((run, *((body, None) if side == "151" else (None, body)), True))
        if waiting:
            sides, bodies, since, due = (list(column) for column in zip(*waiting.values()))
            state.update((list(waiting), sides, bodies, since, due))
            state.setTimeoutTimestamp(min(due))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["run_id", "left", "right", "expired"])

    return whole.withWatermark("arrived", delay).groupBy("cell").applyInPandasWithState(pair, PAIRED, WAITING, "append", GroupStateTimeout.EventTimeTimeout)


def match_pairs(result_root: str, schema: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over `stream_pairs`: matches the pairs of a batch. `schema` is that of a side's JSON text.

    Result files belong to a batch, so one that is replayed replaces itself. ``latest_matches`` takes the newest result of a run.
    A batch is computed once, as its items travel with the header of their set. Streams plan without measured sizes; the match,
    which begins with an exchange, is planned with them, so that a batch without pairs has no work.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sides = batch.where("NOT expired").select("run_id", F.explode(F.array("left", "right")).alias("body"))
        sets = sides.select("run_id", F.inline(F.array(F.from_json("body", schema))))
        header = [c for c in matching.HEADER if c in sets.columns]
        items = sets.select("run_id", "side", *header, F.explode("items").alias("i")).select("run_id", "side", *header, "i.*")
        conf, name = batch.sparkSession.conf, "spark.sql.adaptive.enabled"
        before = conf.get(name)
        conf.set(name, "true")
        try:
            matched, _ = matching.match_runs(items)
            matched.write.mode("overwrite").parquet(f"{result_root}/batch={batch_id}")
        finally:
            conf.set(name, before)

    return run


def latest_matches(spark: SparkSession, result_root: str) -> DataFrame:
    """Match rows of the newest batch that matched each run."""
    rows = spark.read.parquet(result_root)
    newest = rows.groupBy("run_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["run_id", "batch"]).drop("batch")


def append_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there now, in append mode, into parquet files."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def update_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream in update mode; each batch writes its changed rows under its number."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def latest_rows(updates: DataFrame, key: str) -> DataFrame:
    """The last version of every key of an update log."""
    columns = [c for c in updates.columns if c not in (key, "batch_id", "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), "batch_id").alias("r")).select(key, "r.*")


MANIFEST_STREAM = MANIFEST.rsplit(",", 1)[0]
