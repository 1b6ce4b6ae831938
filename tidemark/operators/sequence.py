"""What the step from one event to the next gives away: silences, backwards time and unrealistic jumps.

The order is the line order, never the time order: a stamp that runs backwards is a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import time as t
from tidemark.operators import blocks, timeline
from tidemark.settings import Settings
from tidemark.workspace import Workspace

MICROS = t.MICROS


def steps(events: DataFrame, settings: Settings, initial: DataFrame | None = None) -> DataFrame:
    """Each event but a log's first, with the event before it and the microseconds in between.

    ``initial`` (source, line_number, ts) gives the last event already seen of each log.
    """
    narrow = events.select("source", "line_number", "ts")
    return (
        blocks.previous_values(narrow, ["source"], "line_number", ["ts"], settings.block_lines, initial)
        .filter(F.col("prev_line_number").isNotNull())
        .select(
            "source",
            "line_number",
            "ts",
            F.col("prev_line_number").alias("prev_line"),
            "prev_ts",
            t.micros_between(F.col("prev_ts"), F.col("ts")).alias("delta_us"),
        )
    )


def is_causality(delta: Column) -> Column:
    return delta < 0


def is_max_gap(delta: Column, settings: Settings) -> Column:
    return delta > settings.max_reasonable_gap * MICROS


def is_silence(delta: Column, settings: Settings) -> Column:
    """Both ends of the range count as a gap. A backward step never does, whatever the threshold."""
    low, high = settings.min_gap_threshold * MICROS, settings.max_reasonable_gap * MICROS
    return (delta >= 0) & (delta >= low) & (delta <= high)


def notable(steps_df: DataFrame, settings: Settings) -> DataFrame:
    """The steps that any of the findings below can come from: a small part of a healthy log."""
    delta = F.col("delta_us")
    return steps_df.filter(is_causality(delta) | is_max_gap(delta, settings) | is_silence(delta, settings))


def gaps(steps_df: DataFrame, settings: Settings) -> DataFrame:
    """Silences between the thresholds, outside the safe intervals, with their severity."""
    start, end, delta = F.col("prev_ts"), F.col("ts"), F.col("delta_us")
    wanted = is_silence(delta, settings)
    if settings.safe_intervals:
        wanted = wanted & ~t.inside_any(start, end, settings.safe_intervals)
    level = t.severity(delta)
    if settings.business_hours is not None:
        level = F.when(t.outside_business_hours(start, end, settings.business_hours), "LOW").otherwise(level)
    return steps_df.filter(wanted).select(
        "source",
        start.alias("start_time"),
        end.alias("end_time"),
        delta.alias("duration_us"),
        t.seconds(delta).alias("duration_seconds"),
        level.alias("severity"),
        F.col("prev_line").alias("start_line"),
        F.col("line_number").alias("end_line"),
    )


def causality_violations(steps_df: DataFrame) -> DataFrame:
    return steps_df.filter(is_causality(F.col("delta_us"))).select(
        "source",
        F.col("prev_ts").alias("timestamp_before"),
        F.col("ts").alias("timestamp_after"),
        "line_number",
    )


def max_gap_violations(steps_df: DataFrame, settings: Settings) -> DataFrame:
    return steps_df.filter(is_max_gap(F.col("delta_us"), settings)).select(
        "source",
        "line_number",
        F.col("prev_ts").alias("timestamp_before"),
        F.col("ts").alias("timestamp_after"),
        t.seconds(F.col("delta_us")).alias("delta_seconds"),
    )


def number_gaps(gaps_df: DataFrame, settings: Settings) -> DataFrame:
    """Number a log's gaps 1, 2, … in the order they were found."""
    return blocks.numbered(gaps_df, ["source"], ["end_line"], settings.block_lines, "gap_number").withColumn(
        "gap_id",
        F.concat(
            F.lit("GAP-"),
            F.when(F.col("gap_number") < 10, F.concat(F.lit("0"), F.col("gap_number").cast("string"))).otherwise(
                F.col("gap_number").cast("string")
            ),
        ),
    )


def log_extent(events: DataFrame) -> DataFrame:
    """First and last stamp of each log in line order; the span may be zero or negative."""
    return events.groupBy("source").agg(
        F.min_by("ts", "line_number").alias("file_start"),
        F.max_by("ts", "line_number").alias("file_end"),
        F.max("line_number").alias("last_line"),
    ).withColumn("span_us", t.micros_between(F.col("file_start"), F.col("file_end")))


def without_safe_spans(
    gaps_df: DataFrame, safe: DataFrame, settings: Settings, workspace: Workspace | None = None
) -> DataFrame:
    """Drop the gaps that lie within one of the intervals of the table ``safe`` (safe_start, safe_end).

    A gap is covered exactly when the latest end among the intervals that start no later than it reaches its own end.
    That is a running maximum along time, so neither table is broadcast and no pairs are formed.
    """
    space = workspace or Workspace(gaps_df.sparkSession)
    spans = safe.groupBy(t.epoch_micros(F.col("safe_start")).alias("_at")).agg(
        F.max(t.epoch_micros(F.col("safe_end"))).alias("_safe_end")
    ).select("_at", "_safe_end", F.lit(0).alias("_turn")).filter(F.col("_at").isNotNull())
    # Gaps that start at one instant are asked for once, and read the answer by the instant.
    gaps = gaps_df.withColumn("_start", t.epoch_micros(F.col("start_time")))
    asked = gaps.select(F.col("_start").alias("_at"), F.lit(1).alias("_turn")).distinct()
    line = spans.unionByName(asked, allowMissingColumns=True)
    reach = timeline.running(line, [], ["_at", "_turn"], "_safe_end", "_reach", "max", settings, space)
    reach = reach.filter(F.col("_turn") == 1).select(F.col("_at").alias("_asked"), "_reach")
    covered = F.coalesce(F.col("_reach") >= t.epoch_micros(F.col("end_time")), F.lit(False))
    read = timeline.read_off(gaps, {"_start": "_asked"}, reach, ["source", "end_line"])
    return read.filter(~covered).select(*gaps_df.columns)
