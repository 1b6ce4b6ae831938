"""Exact medians per log, found by counting instead of by sorting a whole log in one place.

Values are counted by their leading bits, then, only where the middle lies, by more bits, down to single values. A step
orders no more than ``2 ** BITS`` counts of one log, however many gaps it has and however close together they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import time as t
from tidemark.operators import blocks
from tidemark.settings import Settings

#: Bits that one step tells apart.
BITS = 13


def middle_values(df: DataFrame, value: str, highest: int) -> DataFrame:
    """The two middle values (equal for an odd count) of a whole number from 0 to ``highest``, and the count, per source.

    Equal values are merged with their count first.
    """
    counts = [df.groupBy("source", F.col(value).alias("at")).agg(F.count(F.lit(1)).alias("total"))]
    for _ in range((max(highest, 1).bit_length() - 1) // BITS):
        finer = counts[-1].select("source", F.shiftright("at", BITS).alias("at"), "total")
        counts.append(finer.groupBy("source", "at").agg(F.sum("total").alias("total")))
    rank_low, rank_high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    # From the leading bits down: which counts hold a middle rank, and how many values lie before them.
    log = Window.partitionBy("source")
    before = log.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts[-1].withColumns({"before": F.coalesce(F.sum("total").over(before), F.lit(0)), "n": F.sum("total").over(log)})
    holds = lambda rank: (F.col("before") <= rank) & (F.col("before") + F.col("total") > rank)
    for finer in reversed(counts[:-1]):
        held = placed.filter(holds(rank_low) | holds(rank_high)).select("source", F.col("at").alias("high"), F.col("before").alias("base"), "n")
        inside = Window.partitionBy("source", "high").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        placed = finer.withColumn("high", F.shiftright("at", BITS)).join(held, ["source", "high"]).select(
            "source", "at", "total", "n", (F.col("base") + F.coalesce(F.sum("total").over(inside), F.lit(0))).alias("before")
        )
    return placed.groupBy("source").agg(
        F.max("n").alias("n_gaps"),
        F.max(F.when(holds(rank_low), F.col("at"))).alias("lower"),
        F.max(F.when(holds(rank_high), F.col("at"))).alias("upper"),
    )


def gap_spread(gaps_df: DataFrame, settings: Settings) -> DataFrame:
    """Median gap and median absolute deviation per source, in seconds; sources without gaps have no row."""
    longest = settings.max_reasonable_gap * t.MICROS
    durations = gaps_df.select("source", "end_line", "duration_us")
    middle = middle_values(durations, "duration_us", longest).join(
        durations.groupBy("source").agg(F.max("end_line").alias("last_line")), "source"
    )
    # Twice the values, so that a median between two microseconds stays a whole number.
    medians = middle.select("source", (F.col("lower") + F.col("upper")).alias("median_2"))
    deviations = blocks.attach(durations, "end_line", medians, "source", settings.block_lines).select(
        "source", F.abs(2 * F.col("duration_us") - F.col("median_2")).alias("deviation_2")
    )
    spread = middle_values(deviations, "deviation_2", 2 * longest).select(
        "source", ((F.col("lower") + F.col("upper")) / F.lit(4.0 * t.MICROS)).alias("mad_seconds")
    )
    return middle.join(spread, "source").select(
        "source",
        "n_gaps",
        "last_line",
        ((F.col("lower") + F.col("upper")) / F.lit(2.0 * t.MICROS)).alias("median_seconds"),
        "mad_seconds",
    )


def gap_cause(gaps_df: DataFrame, settings: Settings, spread: DataFrame | None = None) -> DataFrame:
    """``statistical`` for a gap longer than three deviations (the gap itself, not its distance to the median)."""
    spread = spread if spread is not None else gap_spread(gaps_df, settings)
    per_log = spread.select("source", "mad_seconds")
    beyond = (F.col("duration_seconds") > F.col("mad_seconds") * 3) & (F.col("mad_seconds") > 0)
    return blocks.attach(gaps_df, "end_line", per_log, "source", settings.block_lines).withColumn(
        "cause", F.when(beyond, "statistical").otherwise("static")
    )
