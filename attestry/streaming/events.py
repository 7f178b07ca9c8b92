"""Streams over event and job facts: windows with watermarks, deduplication, and the job queue as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import dates


def with_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp; watermarks don't take one without a zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by type in fixed windows; with late, rows further behind are dropped and state is freed."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """A user's events no further than gap apart."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def claimable(jobs: DataFrame, now, most: int | None = None) -> DataFrame:
    """turn: the order in which a stage's jobs are claimed, runnable ones or those with a lapsed lease, oldest first; with most, only so many a stage.

    A stage may hold most of the jobs: its jobs are numbered within the hours they were made in, and hours are counted on.
    """
    runnable = ((F.col("state") == "queued") & (F.col("run_after") <= now)) | ((F.col("state") == "leased") & (F.col("lease_until") < now))
    rows = jobs.filter(runnable & (F.col("attempts") < F.col("max_attempts"))).withColumn("_hour", F.date_trunc("hour", "created_at"))
    if most is not None:
        out = rows.withColumn("turn", F.row_number().over(Window.partitionBy("stage").orderBy("created_at", "id")))
        return out.filter(F.col("turn") <= most).drop("_hour")
    hours = rows.groupBy("stage", "_hour").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("stage").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = hours.select("stage", "_hour", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("stage", "_hour").orderBy("created_at", "id"))
    return rows.withColumn("_own", own).join(before, ["stage", "_hour"]).withColumn("turn", F.col("_own") + F.col("_before")).drop("_hour", "_own", "_before")


def dead(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("attempts") >= F.col("max_attempts")) & (F.col("state") != "done"))


def retried(jobs: DataFrame, now) -> DataFrame:
    """Failed jobs back in the queue, later with each attempt; those out of attempts are dead."""
    over = F.col("attempts") >= F.col("max_attempts")
    return jobs.withColumn("state", F.when(over, "dead").otherwise("queued")).withColumn("run_after", F.when(over, F.col("run_after")).otherwise(dates.backoff(now, F.col("attempts"))))


JOB_STATE = "state string, attempts int, lease_until double, owner string, run_after double"
JOB_OUT = "document_id string, stage string, state string, attempts int, owner string, run_after double"


def _advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One job's life: enqueue is idempotent while it lives; a claim counts, once its time has come; only the owner's heartbeat
    extends, only the owner completes or fails; a failure re-queues for later, or kills."""
    job = dict(zip(("kind", "attempts", "until", "owner", "after"), state.get if state.exists else ("", 0, 0.0, "", 0.0), strict=True))
    out = lambda: pd.DataFrame({"document_id": [key[0]], "stage": [key[1]], "state": [job["kind"]], "attempts": [job["attempts"]], "owner": [job["owner"]], "run_after": [job["after"]]})
    if state.hasTimedOut:
        if job["kind"] == "leased":  # the lease ran out: reap
            job |= {"kind": "queued", "owner": "", "until": 0.0}
        state.update(tuple(job.values()))
        yield out()
        return
    rows = pd.concat(list(batches)).sort_values("at")
    for row in rows.itertuples():
        mine = job["kind"] == "leased" and job["owner"] == row.owner
        if row.action == "enqueue" and job["kind"] in ("", "done", "dead"):
            job |= {"kind": "queued", "attempts": 0, "owner": "", "after": row.at}
        elif row.action == "claim" and job["kind"] == "queued" and row.at >= job["after"]:
            job |= {"kind": "leased", "attempts": job["attempts"] + 1, "until": row.at + row.lease_s, "owner": row.owner}
        elif row.action == "heartbeat" and mine:
            job["until"] = row.at + row.lease_s
        elif row.action == "complete" and mine:
            job |= {"kind": "done", "owner": ""}
        elif row.action == "fail" and mine:
            job |= {"kind": "dead" if job["attempts"] >= row.max_attempts else "queued", "owner": "", "after": row.at + dates.backoff_seconds(job["attempts"])}
    state.update(tuple(job.values()))
    if job["kind"] == "leased":
        state.setTimeoutDuration(max(1000, int(1000 * (job["until"] - row.at))))
    yield out()


def queue(actions: DataFrame) -> DataFrame:
    """The state of each (document_id, stage) after a stream of actions (at in seconds, action, owner, lease_s, max_attempts)."""
    return actions.groupBy("document_id", "stage").applyInPandasWithState(_advance, JOB_OUT, JOB_STATE, "update", "ProcessingTimeTimeout")


def chained(done: DataFrame, stages: tuple[str, ...] = ("parse", "chunk", "embed")) -> DataFrame:
    """The next stage's job of each finished one."""
    order = F.array(*map(F.lit, stages))
    at = F.array_position(order, F.col("stage")).cast("int")
    return done.filter(at < len(stages)).select("document_id", F.element_at(order, at + 1).alias("stage"), F.lit("queued").alias("state"))
