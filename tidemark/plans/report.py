"""The integrity report and the gap ledger, as tables and as files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import time as t
from tidemark.functions.rounding import one_decimal
from tidemark.operators import blocks, narrative, sequence
from tidemark.settings import Settings


def span_us():
    return F.coalesce(t.micros_between(F.col("file_start"), F.col("file_end")), F.lit(0))


def detailed_gaps(gaps: DataFrame, counters: DataFrame, settings: Settings) -> DataFrame:
    """The report's view of each gap, numbered in order, with its place and width within the log in percent."""
    extent = counters.select("source", "file_start", span_us().alias("span_us"))
    placed = narrative.with_position(sequence.number_gaps(gaps, settings), extent, settings)
    span = t.seconds(F.col("span_us"))
    offset = t.seconds(t.micros_between(F.col("file_start"), F.col("start_time")))
    share = lambda part: F.when(F.col("span_us") > 0, part / span * F.lit(100.0)).otherwise(0.0)
    return placed.select(
        "source",
        "gap_number",
        "gap_id",
        "start_time",
        "end_time",
        F.expr("duration_us div 1000000").alias("duration_seconds"),
        t.human_duration(F.col("duration_us")).alias("duration_human"),
        "severity",
        "start_line",
        "end_line",
        share(offset).alias("position"),
        share(t.seconds(F.col("duration_us"))).alias("width"),
        F.col("alibi_evidence_count").alias("alibi_events_caught"),
    ).withColumns({"position_percent": one_decimal(F.col("position")), "width_percent": one_decimal(F.col("width"))})


def report_header(scored: DataFrame, settings: Settings, run_at: datetime, hashes: DataFrame | None = None) -> DataFrame:
    """One row per source: metadata, anomalies and trust metrics, without the lists that grow with the findings."""
    if hashes is None:
        hashed = scored.withColumn("sha256", F.lit("N/A"))
    else:
        hashed = scored.join(hashes, "source", "left").withColumn("sha256", F.coalesce("sha256", F.lit("N/A")))
    return hashed.select(
        "source",
        F.struct(
            F.lit(run_at.isoformat()).alias("analysis_timestamp"),
            F.col("source").alias("source_file"),
            F.col("sha256").alias("chain_of_custody_sha256"),
            t.text_stamp(F.col("file_start"), "T").alias("file_start"),
            t.text_stamp(F.col("file_end"), "T").alias("file_end"),
            F.col("total_lines").alias("total_lines_processed"),
            F.lit(settings.min_gap_threshold).cast("bigint").alias("threshold_seconds"),
            t.seconds(span_us()).cast("bigint").alias("total_timespan_seconds"),
        ).alias("metadata"),
        F.struct(
            F.col("total_gaps").alias("total_gaps_found"),
            F.struct(
                F.col("high_count").alias("HIGH"), F.col("medium_count").alias("MEDIUM"), F.col("low_count").alias("LOW")
            ).alias("severity_breakdown"),
            F.col("malformed_count").alias("malformed_lines_skipped"),
            F.col("causality_count").alias("causality_violations_detected"),
            F.col("forgery_count").alias("shannon_entropy_collapses"),
            F.col("alibi_failures").alias("alibi_failures_detected"),
            F.col("pii_leaks").alias("pii_leakage_events"),
        ).alias("anomalies"),
        F.struct(
            F.col("status").alias("system_status"),
            F.col("trust").alias("log_trust_confidence_percent"),
            F.col("reason").alias("suspicion_reason"),
            F.col("deductions").alias("trust_deduction_breakdown"),
        ).alias("trust_metrics"),
    )


def integrity_report(header: DataFrame, details: DataFrame, alerts: DataFrame, settings: Settings) -> DataFrame:
    """The nested report, ready for JSON.

    Its two lists grow with the findings, so it comes in parts of ``part_rows`` gaps and alerts. Part 0 carries the
    header and is the whole report of every log that has no more than that; further parts continue the lists
    ``anomalies.cloud_alerts`` and ``detailed_gaps``, their other fields being null.
    """
    size = settings.part_rows
    gap_fields = (
        "start_time", "end_time", "duration_seconds", "duration_human", "severity", "start_line", "end_line",
        "position_percent", "width_percent", "alibi_events_caught",
    )
    in_report = details.withColumns(
        {name: t.text_stamp(F.col(name), "T") for name in ("start_time", "end_time")}
    )
    gap_parts = (
        in_report.withColumn("part", F.expr(f"(gap_number - 1) div {size}L"))
        .groupBy("source", "part")
        .agg(F.array_sort(F.collect_list(F.struct("gap_number", F.struct(*gap_fields).alias("gap")))).alias("_gaps"))
        .select("source", "part", F.col("_gaps.gap").alias("detailed_gaps"))
    )
    told = blocks.numbered(
        alerts.select("source", "line_number", "kind_rank", "message"), ["source"], ["line_number", "kind_rank"],
        settings.block_lines, "place",
    )
    alert_parts = (
        told.withColumn("part", F.expr(f"(place - 1) div {size}L"))
        .groupBy("source", "part")
        .agg(F.array_sort(F.collect_list(F.struct("place", "message"))).alias("_alerts"))
        .select("source", "part", F.col("_alerts.message").alias("cloud_alerts"))
    )
    first = header.withColumn("part", F.lit(0).cast("bigint"))
    joined = first.join(gap_parts, ["source", "part"], "full").join(alert_parts, ["source", "part"], "full")
    empty_gaps = F.from_json(F.lit("[]"), gap_parts.schema["detailed_gaps"].dataType)
    alerts_or_none = F.coalesce("cloud_alerts", F.array().cast("array<string>"))
    # Further parts have no counts of their own, but their alerts stand in the same place.
    kinds = header.schema["anomalies"].dataType
    blank = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields])
    return joined.select(
        "source",
        "part",
        "metadata",
        F.coalesce("anomalies", blank).withField("cloud_alerts", alerts_or_none).alias("anomalies"),
        "trust_metrics",
        F.coalesce("detailed_gaps", empty_gaps).alias("detailed_gaps"),
    )


def gap_ledger(gaps: DataFrame, scored: DataFrame, settings: Settings) -> DataFrame:
    """One row per gap with the log's totals beside it; ``source`` and ``end_line`` give the order."""
    totals = scored.select("source", "causality_count", "forgery_count", "trust", "status")
    return blocks.attach(gaps, "end_line", totals, "source", settings.block_lines).select(
        "source",
        "end_line",
        t.text_stamp(F.col("start_time"), "T").alias("start_time"),
        t.text_stamp(F.col("end_time"), "T").alias("end_time"),
        F.expr("duration_us div 1000000").alias("duration_seconds"),
        "severity",
        F.col("alibi_evidence_count").alias("alibi_events_caught"),
        F.col("causality_count").alias("total_causality_violations"),
        F.col("forgery_count").alias("shannon_entropy_collapses"),
        F.concat(F.col("trust").cast("string"), F.lit("%")).alias("system_trust_confidence"),
        F.col("status").alias("system_status"),
    )


# Fixed value: the ledger file's columns.
LEDGER_COLUMNS = (
    "start_time", "end_time", "duration_seconds", "severity", "alibi_events_caught", "total_causality_violations",
    "shannon_entropy_collapses", "system_trust_confidence", "system_status",
)


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines, one object per log and part; null fields are left out."""
    report.write.mode("overwrite").json(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """CSV with a header; rows in order within each log, all logs in parallel."""
    ledger.repartitionByRange("source", "end_line").sortWithinPartitions("source", "end_line").select(
        "source", *LEDGER_COLUMNS
    ).write.mode("overwrite").csv(path, header=True)
