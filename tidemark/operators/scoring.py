"""Roll-up of a log's findings into counters, trust score, status and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import text, time as t
from tidemark.operators import sequence
from tidemark.settings import Settings

COUNTS = (
    "total_lines", "malformed_count", "total_gaps", "low_count", "medium_count", "high_count", "max_gap_violations",
    "causality_count", "forgery_count", "alibi_failures", "pii_leaks",
)


def line_counters(lines: DataFrame, scan_pii: bool = False) -> DataFrame:
    """Volume and extent of each log, from one pass over its lines (a line without ``ts`` is malformed)."""
    parsed = F.col("ts").isNotNull()
    leaks = F.sum(F.when(parsed, text.pii_count(F.col("raw_payload")))) if scan_pii else F.lit(0)
    return lines.groupBy("source").agg(
        F.max("line_number").alias("total_lines"),
        F.count_if(~parsed).alias("malformed_count"),
        F.min_by("ts", F.when(parsed, F.col("line_number"))).alias("file_start"),
        F.max_by("ts", F.when(parsed, F.col("line_number"))).alias("file_end"),
        F.coalesce(leaks, F.lit(0)).cast("bigint").alias("pii_leaks"),
    )


def step_counters(steps: DataFrame, settings: Settings) -> DataFrame:
    return steps.groupBy("source").agg(
        F.count_if(sequence.is_max_gap(F.col("delta_us"), settings)).alias("max_gap_violations"),
        F.count_if(sequence.is_causality(F.col("delta_us"))).alias("causality_count"),
    )


def severity_breakdown(gaps: DataFrame) -> DataFrame:
    """Gaps per severity by their length alone: the lowering outside business hours does not reach the score."""
    level = t.severity(F.col("duration_us"))
    return gaps.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_gaps"),
        F.count_if(level == "LOW").alias("low_count"),
        F.count_if(level == "MEDIUM").alias("medium_count"),
        F.count_if(level == "HIGH").alias("high_count"),
    )


def alibi_failures(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("source").agg(F.count_if(F.col("alibi_evidence_count") > 0).alias("alibi_failures"))


def forgery_counters(forgeries: DataFrame) -> DataFrame:
    return forgeries.groupBy("source").agg(F.count(F.lit(1)).alias("forgery_count"))


def combine(*parts: DataFrame) -> DataFrame:
    """One row per source from several tables of at most one row per source; absent counts are 0."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = union.groupBy("source").agg(*[F.max(c).alias(c) for c in union.columns if c != "source"])
    have = set(merged.columns)
    return merged.select(
        "source",
        *[(F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        *[F.col(c) if c in have else F.lit(None).cast("timestamp_ntz").alias(c) for c in ("file_start", "file_end")],
    )


def trust_percent() -> Column:
    """100 minus the deductions, cut to a whole number and kept within 0 and 100; a log without lines has 100."""
    score = F.lit(100.0)
    # Points per finding, taken off in this order.
    for name, points in (
        ("low_count", 2), ("medium_count", 5), ("high_count", 15), ("max_gap_violations", 20), ("causality_count", 30),
        ("forgery_count", 20), ("malformed_count", 0.1),
    ):
        score = score - F.col(name) * F.lit(float(points))
    score = F.when(F.col("alibi_failures") > 0, score - 50).otherwise(score)
    whole = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(100).cast("bigint"), score.cast("bigint")))
    return F.when(F.col("total_lines") == 0, F.lit(100).cast("bigint")).otherwise(whole)


def status_of(trust: Column) -> Column:
    empty = F.col("total_lines") == 0
    return (
        F.when(empty, "NORMAL")
        .when((F.col("alibi_failures") > 0) | (trust < 50), "COMPROMISED")
        .when(trust < 85, "SUSPICIOUS")
        .otherwise("NORMAL")
    )


def suspicion_density() -> Column:
    weighted = F.col("high_count") * 3 + F.col("medium_count") * 2 + F.col("low_count")
    return F.when(F.col("total_lines") == 0, 0.0).otherwise(F.try_divide(weighted, F.col("total_lines")))


def suspicion_reason(trust: Column) -> Column:
    count = lambda name: F.col(name).cast("string")
    # The reasons, in this order.
    reasons = F.concat_ws(
        " | ",
        F.when(
            F.col("alibi_failures") > 0,
            F.concat(F.lit("CRITICAL: "), count("alibi_failures"), F.lit(" Alibi Failures detected (Proven tampering)")),
        ),
        F.when(
            F.col("causality_count") > 0,
            F.concat(F.lit("CAUSALITY VIOLATION: "), count("causality_count"), F.lit(" reverse-time jumps detected")),
        ),
        F.when(
            F.col("forgery_count") > 0,
            F.concat(F.lit("SYNTHETIC FORGERY: "), count("forgery_count"), F.lit(" instances of Shannon Entropy collapse")),
        ),
        F.when(F.col("high_count") > 0, "Major timeline disruptions (HIGH gaps)"),
        F.when(
            F.col("max_gap_violations") > 0,
            F.concat(count("max_gap_violations"), F.lit(" instances of catastrophic timestamp inconsistency")),
        ),
        F.when(
            F.col("malformed_count") > F.col("total_lines") * F.lit(0.01),
            "Unusually high volume of malformed/corrupted lines",
        ),
    )
    return (
        F.when(F.col("total_lines") == 0, "Log file implies normal contiguous structure")
        .when(reasons != "", reasons)
        .when(trust < 100, "Minor temporal inconsistencies degrading reliability")
        .otherwise("Perfect contiguous structural integrity")
    )


def trust_deductions() -> Column:
    """The non-zero deductions as short texts, in order."""

    def line(name: str, label: str, points: int) -> Column:
        n = F.col(name)
        return F.when(
            n > 0, F.concat(F.lit(f"{label} ("), n.cast("string"), F.lit("x): -"), (n * points).cast("string"))
        )

    # Labels and points.
    malformed = F.col("malformed_count")
    tenths = F.concat(
        F.expr("malformed_count div 10").cast("string"), F.lit("."), F.expr("malformed_count % 10").cast("string")
    )
    entries = F.array(
        line("low_count", "LOW gaps", 2),
        line("medium_count", "MEDIUM gaps", 5),
        line("high_count", "HIGH gaps", 15),
        line("max_gap_violations", "Max gap violations", 20),
        line("causality_count", "Causality violations", 30),
        line("forgery_count", "Entropy collapses", 20),
        F.when(F.col("alibi_failures") > 0, "Alibi failures: -50"),
        F.when(malformed > 0, F.concat(F.lit("Malformed lines ("), malformed.cast("string"), F.lit("x): -"), tenths)),
    )
    return F.array_compact(entries)


def score(counters: DataFrame) -> DataFrame:
    """Add trust, status, reason, deductions and density to the counters of each source."""
    scored = counters.withColumn("trust", trust_percent())
    trust = F.col("trust")
    return scored.select(
        "*",
        status_of(trust).alias("status"),
        suspicion_reason(trust).alias("reason"),
        trust_deductions().alias("deductions"),
        suspicion_density().alias("suspicion_density"),
    )
