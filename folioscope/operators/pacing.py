"""Batch forms of the rules about time between requests and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scale import with_position, with_running
from ..settings import DEFAULTS


def cooldowns(requests: DataFrame, cooldown: float = DEFAULTS.cooldown_s, spacing: float = DEFAULTS.spacing_s) -> DataFrame:
    """Requests (`source`, `request_id`, `at_s`, `limited`): made while the source was cooling
    down after a 429, or too soon after the one before. The last time of each kind is carried
    along each source by a running maximum."""
    run = with_running(requests, ["source"], ["at_s", "request_id"], {
        "last_limited": ("max", F.when(F.col("limited"), F.col("at_s"))), "last": ("max", F.col("at_s"))}, inclusive=False)
    return run.withColumns({"cooling": F.coalesce(F.col("at_s") - F.col("last_limited") < cooldown, F.lit(False)),
                            "too_soon": F.coalesce(F.col("at_s") - F.col("last") < spacing, F.lit(False))}).drop("last_limited", "last")


def turn_deadlines(turns: DataFrame, minutes: int = DEFAULTS.reply_minutes_default) -> DataFrame:
    """Each opened turn (`run_id`, `ts`, `event_id`, `kind`): answered by the next record of
    its run within the limit, or passed over. Neighbours meet by number."""
    n = with_position(turns, ["run_id"], ["ts", "event_id"], "n")
    after = n.select("run_id", (F.col("n") - 1).alias("n"), F.col("kind").alias("next_kind"), F.col("ts").alias("next_ts"))
    j = n.filter("kind = 'opened'").join(after, ["run_id", "n"], "left")
    in_time = (F.col("next_kind") == "replied") & (F.timestamp_diff("SECOND", F.col("ts"), F.col("next_ts")) <= minutes * 60)
    return j.withColumn("outcome", F.when(in_time, "answered").otherwise("passed over")).drop("next_kind", "next_ts", "n")


def past_limit(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Events of runs that came after their time limit (`run_id`, `limit_minutes`): where the
    run had to stop."""
    began = events.groupBy("run_id").agg(F.min("ts").alias("began"))
    j = events.join(began.join(runs, "run_id"), "run_id")
    return j.filter(F.timestamp_diff("SECOND", F.col("began"), F.col("ts")) > F.col("limit_minutes") * 60)
