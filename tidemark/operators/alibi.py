"""Cross-check of silences against secondary logs: how many of their events fall inside each gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import time as t
from tidemark.operators import timeline
from tidemark.settings import Settings
from tidemark.workspace import Workspace


def count_inside(
    gaps_df: DataFrame, secondary: DataFrame, settings: Settings, within: list[str] | None = None, workspace: Workspace | None = None
) -> DataFrame:
    """Add ``alibi_evidence_count``: secondary events strictly between each gap's two ends.

    Both tables are put on one time line. The count is the number of events before the end minus the number up to the
    start, each read off a running total, so the cost grows with the rows and not with the pairs. Events with the same
    stamp, and gap ends with the same stamp, are merged before they move; only the instants travel along the line, and
    the gaps read their two totals by instant, those of one instant in many tasks. ``within`` names columns of both
    tables that must agree.
    """
    keys = list(within or [])
    space = workspace or Workspace(gaps_df.sparkSession)
    # At one instant: an end reads the total first, then events add to it, then a start reads it.
    events = (
        secondary.groupBy(*keys, F.col("ts").alias("_ts"))
        .agg(F.count(F.lit(1)).alias("_weight"))
        .select(*keys, t.epoch_micros(F.col("_ts")).alias("_at"), "_weight", F.lit(1).alias("_turn"))
    )
    gaps = gaps_df.withColumns(
        {"_start": t.epoch_micros(F.col("start_time")), "_end": t.epoch_micros(F.col("end_time"))}
    )
    ends = F.array(
        F.struct(F.col("_end").alias("_at"), F.lit(0).alias("_turn")),
        F.struct(F.col("_start").alias("_at"), F.lit(2).alias("_turn")),
    )
    instants = gaps.select(*keys, F.inline(ends)).distinct().withColumn("_weight", F.lit(0).cast("bigint"))
    line = events.unionByName(instants).filter(F.col("_at").isNotNull())
    totals = timeline.running(line, keys, ["_at", "_turn"], "_weight", "_total", "sum", settings, space)
    counted = gaps
    for turn, at, name in ((0, "_end", "_below"), (2, "_start", "_upto")):
        read = totals.filter(F.col("_turn") == turn).select(
            *[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("_at").alias(f"_{name}_at"), F.col("_total").alias(name)
        )
        on = {k: f"_{name}_{k}" for k in keys} | {at: f"_{name}_at"}
        counted = timeline.read_off(counted, on, read, ["source", "end_line"])
    # A gap of no length would count the events at its instant negatively.
    evidence = F.greatest(F.col("_below") - F.col("_upto"), F.lit(0).cast("bigint"))
    return counted.select(*gaps_df.columns, evidence.alias("alibi_evidence_count"))


def cross_check(
    gaps_df: DataFrame, secondary_logs: list[DataFrame], settings: Settings, workspace: Workspace | None = None
) -> DataFrame:
    """Evidence summed over all secondary logs; a log given twice counts twice."""
    if not secondary_logs:
        return gaps_df.withColumn("alibi_evidence_count", F.lit(0).cast("bigint"))
    together = secondary_logs[0].select("ts")
    for log in secondary_logs[1:]:
        together = together.unionByName(log.select("ts"))
    return count_inside(gaps_df, together, settings, workspace=workspace)
