"""Streaks and states over logs of events: gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_runs(events: DataFrame, who: str, order: list[str], failed: Column, neutral: Column) -> DataFrame:
    """events that count, with streak: how many failures in a row end there; neutral events are left out, others reset."""
    rows = events.where(~neutral).withColumn("_ok", (~failed).cast("int"))
    upto = Window.partitionBy(who).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("_island", F.sum("_ok").over(upto))
    streak = F.sum(1 - F.col("_ok")).over(Window.partitionBy(who, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return island.withColumn("streak", streak).drop("_ok", "_island")


def tripped(runs: DataFrame, who: str, limit: int) -> DataFrame:
    """(who, longest): those whose failures in a row have reached the limit."""
    return runs.groupBy(who).agg(F.max("streak").alias("longest")).where(F.col("longest") >= limit)


def run_state(runs: DataFrame, now: Column, timeout_minutes: int = 90) -> DataFrame:
    """runs (run_id, started_at, heartbeat, outcome) with state: the outcome, else interrupted where the last heartbeat is older than the timeout or than the newest start of any run, else running."""
    beat = F.coalesce("heartbeat", F.lit("0001-01-01").cast("timestamp"))
    stale = (F.unix_timestamp(now) - F.unix_timestamp(beat)) > timeout_minutes * 60
    newest = runs.agg(F.max("started_at").alias("_newest"))  # one row
    state = F.when(F.coalesce("outcome", F.lit("")) != "", F.col("outcome")).when(stale | (beat < F.col("_newest")), "interrupted").otherwise("running")
    return runs.join(F.broadcast(newest), F.lit(True), "left").withColumn("state", state).drop("_newest")


def ledger(events: DataFrame) -> DataFrame:
    """(run_id, started_at, heartbeat, phase, outcome, detail) of runs from what was written about them: events (run_id, at, kind, value) of the kinds start, beat, phase and finish; values are kept to 500 characters."""
    of = lambda kind, value: F.max_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.struct("at", "value")))
    cut = F.substring(F.coalesce("value", F.lit("")), 1, 500)
    return events.groupBy("run_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started_at"),
        F.max("at").alias("heartbeat"),
        of("phase", cut).alias("phase"),
        of("finish", F.split_part(cut, F.lit(":"), F.lit(1))).alias("outcome"),
        of("finish", F.trim(F.regexp_replace(cut, "^[^:]*:?", ""))).alias("detail"),
    )


def lost_days(runs: DataFrame, today: Column) -> DataFrame:
    """One row (days): days since the last successful run ended, by date; without one, those since the first start and one more; 0 where nothing ever ran."""
    end = F.to_date(F.coalesce("finished_at", "started_at"))
    one = runs.agg(F.max(F.when(F.col("outcome") == "done", end)).alias("ok"), F.min(F.to_date("started_at")).alias("first"))
    return one.select(F.when(F.col("ok").isNotNull(), F.greatest(F.lit(0), F.datediff(today, "ok"))).when(F.col("first").isNotNull(), F.greatest(F.lit(0), F.datediff(today, "first") + 1)).otherwise(0).alias("days"))


def empty_streaks(crawls: DataFrame, order: list[str], declined: Column, limit: int = 3) -> DataFrame:
    """(host, streak, dead): empty crawls in a row at the end of each host's log (host, items); any item resets the count, crawls that the supplier declined don't count either way."""
    told = crawls.where(~declined)
    last_full = F.max(F.when(F.col("items") > 0, F.struct(*order))).over(Window.partitionBy("host"))
    after = told.withColumn("_full", last_full).withColumn("_after", F.col("_full").isNull() | (F.struct(*order) > F.col("_full")))
    hosts = crawls.select("host").distinct()
    n = after.where("_after").groupBy("host").agg(F.count(F.lit(1)).alias("streak"))
    return hosts.join(n, "host", "left").select("host", F.coalesce("streak", F.lit(0)).alias("streak")).withColumn("dead", F.col("streak") >= limit)
