"""The registered queries: each operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from suite import inputs as data
from suite.inputs import BY_TYPE, BY_USER, OFFICE, SAFE, SUITE
from tidemark.functions import text, time as t
from tidemark.operators import alerts, alibi, baseline, medians, narrative, scoring, sequence
from tidemark.plans.analyze import Findings, analyze
from tidemark.settings import Settings
from tidemark.sources import files, normalize
from tidemark.workspace import Workspace

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


# Scans and normalization


@query
def scan_text_lines(spark, sf_dir):
    """Write the text log as files of 5,000 line numbers each, then read and number all of them."""
    space = Workspace(spark)
    folder = space.path("text")
    chunked = data.audit_log(spark, sf_dir).withColumn("chunk", F.expr("line_number div 5000"))
    (
        chunked.repartition("source", "chunk")
        .sortWithinPartitions("source", "chunk", "line_number")
        .select("source", "chunk", "line")
        .write.partitionBy("source", "chunk")
        .text(folder)
    )
    lines = files.read_text_lines(spark, folder, space)
    return lines.select(
        F.regexp_extract("source", r"/source=([^/]+)/", 1).alias("source"),
        F.regexp_extract("source", r"/chunk=(\d+)/", 1).cast("bigint").alias("chunk"),
        "line_number",
        "line",
    )


@query
def normalize_text_log(spark, sf_dir):
    return data.text_events(spark, sf_dir).select("source", "line_number", "ts", "raw_payload")


@query
def normalize_cloud_audit(spark, sf_dir):
    return data.audit_events(spark, sf_dir).select(
        "source", "line_number", "ts", "raw_payload", "actor", "source_ip", "region", "event_name", "event_source"
    )


@query
def read_audit_records(spark, sf_dir):
    """Audit documents of a hundred records; one broken record spoils its document."""
    documents = (
        data.audit_json(spark, sf_dir)
        .groupBy(F.expr("line_number div 100").alias("number"))
        .agg(F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("records"))
        .select(
            F.concat(F.lit("doc-"), F.col("number").cast("string")).alias("source"),
            F.concat(F.lit('{"Records": [\n'), F.array_join("records.line", ",\n"), F.lit("\n]}")).alias("document"),
        )
    )
    records = normalize.events(normalize.normalize_audit(files.unpack_records(documents)))
    return records.select("source", "line_number", "ts", "actor", "source_ip", "event_name", "raw_payload")


@query
def rejected_lines(spark, sf_dir):
    return normalize.rejects(normalize.normalize_text(data.audit_log(spark, sf_dir), SUITE))


@query
def custody_hash(spark, sf_dir):
    return data.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query
def custody_hash_files(spark, sf_dir):
    """Documents written as twenty text files, hashed whole and in chunks."""
    folder = Workspace(spark).path("custody")
    docs = data.table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("bucket"), "doc_id", "text")
    (
        docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "text")
        .write.partitionBy("bucket").text(folder)
    )
    bucket = F.regexp_extract("source", r"/bucket=(\d+)/", 1).cast("bigint").alias("bucket")
    whole = files.custody_hashes(spark, folder).select(bucket, "sha256")
    chunked = files.custody_hashes(spark, folder, whole_file_bytes=1).select(bucket, F.col("sha256").alias("sha256_in_chunks"))
    return whole.join(chunked, "bucket")


@query
def parse_timestamps(spark, sf_dir):
    lines = normalize.normalize_text(data.stamped_lines(spark, sf_dir), SUITE.override(default_year=2023))
    return lines.select("source", "line_number", "ts")


# Expressions


@query
def payload_entropy(spark, sf_dir):
    body = text.payload_body(F.col("text"))
    return data.table(spark, sf_dir, "documents").select(
        "doc_id", F.length(body).cast("bigint").alias("chars"), F.round(text.entropy(body), 6).alias("entropy")
    )


@query
def severity_bucket(spark, sf_dir):
    return sequence.steps(data.event_log(spark, sf_dir), SUITE).select(
        "source",
        "line_number",
        F.round(t.seconds(F.col("delta_us")), 6).alias("duration_seconds"),
        t.severity(F.col("delta_us")).alias("severity"),
    )


def _listed(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        "source", "start_time", "end_time", F.round("duration_seconds", 6).alias("duration_seconds"), "severity",
        "start_line", "end_line",
    )


def _event_gaps(spark, sf_dir, settings: Settings) -> DataFrame:
    return sequence.gaps(sequence.steps(data.event_log(spark, sf_dir), settings), settings)


@query
def business_hours_gaps(spark, sf_dir):
    return _listed(_event_gaps(spark, sf_dir, OFFICE))


@query
def safe_interval_filter(spark, sf_dir):
    return _listed(_event_gaps(spark, sf_dir, SAFE))


@query
def pii_rule_hits(spark, sf_dir):
    hits = text.pii_hits(F.col("text"))
    return data.table(spark, sf_dir, "documents").select("doc_id", *[hit.alias(name) for name, hit in hits.items()])


@query
def duration_human(spark, sf_dir):
    steps = sequence.steps(data.user_event_log(spark, sf_dir), SUITE)
    return steps.select("source", "line_number", t.human_duration(F.col("delta_us")).alias("duration_human"))


@query
def gap_position(spark, sf_dir):
    events = data.event_log(spark, sf_dir)
    gaps = sequence.gaps(sequence.steps(events, BY_TYPE), BY_TYPE)
    placed = narrative.with_position(gaps, sequence.log_extent(events), BY_TYPE)
    span = t.seconds(F.col("span_us"))
    offset = t.seconds(t.micros_between(F.col("file_start"), F.col("start_time")))
    return placed.select(
        "source",
        "end_line",
        F.round(F.when(span > 0, offset / span * 100).otherwise(0.0), 6).alias("position"),
        F.round(F.when(span > 0, F.col("duration_seconds") / span * 100).otherwise(0.0), 6).alias("width"),
    )


# Sequence operators


def _text_steps(spark, sf_dir, settings: Settings) -> DataFrame:
    return sequence.steps(data.text_events(spark, sf_dir), settings)


def _text_gaps(spark, sf_dir) -> DataFrame:
    """Gaps of the text logs, stored as ``analyze`` does, for operators that read them along several ways."""
    return Workspace(spark).keep(sequence.gaps(_text_steps(spark, sf_dir, BY_TYPE), BY_TYPE), "gaps")


@query
def gap_detect(spark, sf_dir):
    return _listed(sequence.gaps(_text_steps(spark, sf_dir, SUITE), SUITE))


@query
def causality_violations(spark, sf_dir):
    return sequence.causality_violations(_text_steps(spark, sf_dir, SUITE))


@query
def max_gap_violations(spark, sf_dir):
    return sequence.max_gap_violations(sequence.steps(data.order_log(spark, sf_dir), SUITE), SUITE)


def _collapses(spark, sf_dir, settings: Settings, events: DataFrame | None = None) -> DataFrame:
    events = events if events is not None else data.text_events(spark, sf_dir)
    found = baseline.entropy_collapse(events, settings, Workspace(spark))
    return found.select(
        "source", "line_number", "ts", F.round("entropy", 6).alias("entropy"), F.round("baseline", 6).alias("baseline"),
        "raw_text",
    )


@query
def entropy_collapse(spark, sf_dir):
    return _collapses(spark, sf_dir, Settings())


@query
def entropy_collapse_in_blocks(spark, sf_dir):
    """The same with logs cut into many blocks, as a log too large for one task is."""
    return _collapses(spark, sf_dir, Settings(block_lines=1000))


@query
def entropy_collapse_two_levels(spark, sf_dir):
    """Many blocks of logs whose payloads lie around the cut, so that no block's decisions stand by themselves."""
    return _collapses(spark, sf_dir, Settings(block_lines=1000), data.two_level_events(spark, sf_dir))


@query
def impossible_travel(spark, sf_dir):
    return alerts.impossible_travel(data.audit_events(spark, sf_dir), SUITE).select(
        "source", "line_number", "ts", "actor", "prev_ip", "source_ip", F.round("delta_hours", 6).alias("delta_hours"),
        "message",
    )


# Alerts


def _stored_audit(spark, sf_dir) -> DataFrame:
    """The audit events parsed once and stored, for queries with several readers of them."""
    return Workspace(spark).keep(data.audit_events(spark, sf_dir), "events")


@query
def iam_escalation(spark, sf_dir):
    return alerts.iam_escalation(data.audit_events(spark, sf_dir), SUITE).select(
        "source", "line_number", "ts", "actor", "event_name", "message"
    )


@query
def root_abuse(spark, sf_dir):
    return alerts.root_abuse(data.audit_events(spark, sf_dir), SUITE).select(
        "source", "line_number", "ts", "actor", "event_name", "message"
    )


@query
def alert_feed(spark, sf_dir):
    return alerts.alert_feed(_stored_audit(spark, sf_dir), SUITE).select(
        "source", "line_number", "kind_rank", "kind", "message"
    )


@query
def technique_mapping(spark, sf_dir):
    feed = alerts.alert_feed(_stored_audit(spark, sf_dir), SUITE)
    return alerts.with_technique(feed).select("source", "line_number", "kind", "technique_key", "technique")


# Joins


def _with_evidence(gaps: DataFrame) -> DataFrame:
    return gaps.select("source", "start_time", "end_time", "severity", "end_line", "alibi_evidence_count")


@query
def alibi_cross_check(spark, sf_dir):
    """Gaps of an hour and more in each event log against two secondary logs: all events, and all orders' stamps."""
    settings = SUITE.override(min_gap_threshold=3600)
    secondary = [data.event_log(spark, sf_dir), data.order_log(spark, sf_dir)]
    return _with_evidence(alibi.cross_check(_event_gaps(spark, sf_dir, settings), secondary, settings))


@query
def cloud_alibi(spark, sf_dir):
    """Gaps of the text logs against the normalized audit trail."""
    return _with_evidence(alibi.count_inside(_text_gaps(spark, sf_dir), data.audit_events(spark, sf_dir), BY_TYPE))


@query
def safe_interval_anti_join(spark, sf_dir):
    """Gaps not covered by any of the intervals that follow each event, longer ones after larger values."""
    safe = data.table(spark, sf_dir, "events").select(
        F.expr("ts - interval 1 minute").alias("safe_start"),
        F.expr("ts + make_dt_interval(0, 0, 0, cast(value as int) * 10)").alias("safe_end"),
    )
    return _listed(sequence.without_safe_spans(_event_gaps(spark, sf_dir, BY_TYPE), safe, BY_TYPE))


@query
def alibi_by_path(spark, sf_dir):
    """Gaps of an hour and more in each event log against the text logs, given as files; one of the given paths is not there."""
    folder = Workspace(spark).path("secondary")
    data.audit_log(spark, sf_dir).select("source", "line").write.partitionBy("source").text(folder)
    found = analyze(
        spark, data.event_log(spark, sf_dir), settings=SUITE.override(min_gap_threshold=3600),
        alibi_logs=[f"{folder}/source=click", f"{folder}/source=[esv]*", f"{folder}/source=none"],
    )
    return _with_evidence(found.gaps)


# Aggregates


@query
def log_extent(spark, sf_dir):
    return sequence.log_extent(data.text_events(spark, sf_dir)).select(
        "source", "file_start", "file_end", F.round(t.seconds(F.col("span_us")), 6).alias("span_seconds")
    )


@query
def severity_breakdown(spark, sf_dir):
    return scoring.severity_breakdown(sequence.gaps(_text_steps(spark, sf_dir, BY_TYPE), BY_TYPE))


def _user_findings(spark, sf_dir, secondary: DataFrame | None = None, scan_pii: bool = False) -> Findings:
    """The whole analysis of the logs by user."""
    return analyze(
        spark,
        data.user_log(spark, sf_dir),
        settings=BY_USER,
        scan_pii=scan_pii,
        alibi_logs=[secondary] if secondary is not None else None,
        run_at=datetime(2024, 1, 1),
    )


def _escalations(spark, sf_dir) -> DataFrame:
    return alerts.iam_escalation(data.audit_events(spark, sf_dir), SUITE)


@query
def trust_score(spark, sf_dir):
    settings = SUITE.override(min_gap_threshold=150_000)
    events = data.user_event_log(spark, sf_dir)
    steps = sequence.steps(events, settings)
    counters = scoring.combine(
        events.groupBy("source").agg(F.max("line_number").alias("total_lines")),
        scoring.step_counters(steps, settings),
        scoring.severity_breakdown(sequence.gaps(steps, settings)),
    )
    return scoring.score(counters).select(
        "source", "trust", "status", "alibi_failures", F.round("suspicion_density", 6).alias("suspicion_density")
    )


@query
def log_counters(spark, sf_dir):
    return _user_findings(spark, sf_dir, scan_pii=True).counters.select(
        "source", "total_lines", "malformed_count", "total_gaps", "max_gap_violations", "causality_count", "forgery_count",
        "pii_leaks",
    )


@query
def suspicion_reason(spark, sf_dir):
    return _user_findings(spark, sf_dir).scores.select("source", "trust", "status", "reason")


@query
def trust_deductions(spark, sf_dir):
    return _user_findings(spark, sf_dir).scores.select("source", F.array_join("deductions", "; ").alias("deductions"))


@query
def gap_mad(spark, sf_dir):
    return medians.gap_spread(_text_gaps(spark, sf_dir), BY_TYPE).select(
        "source", "n_gaps", F.round("median_seconds", 6).alias("median_seconds"), F.round("mad_seconds", 6).alias("mad_seconds")
    )


@query
def gap_cause(spark, sf_dir):
    return medians.gap_cause(_text_gaps(spark, sf_dir), BY_TYPE).select(
        "source", "end_line", F.round("duration_seconds", 6).alias("duration_seconds"), "cause"
    )


@query
def gap_cause_far(spark, sf_dir):
    """As ``gap_cause``, with line numbers below zero and beyond 1.7e15."""
    far = F.when(F.col("source").isin("click", "error"), F.lit(-1_000_000)).otherwise(F.lit(1_700_000_000_000_000))
    gaps = _text_gaps(spark, sf_dir).withColumn("end_line", F.col("end_line") + far)
    return medians.gap_cause(gaps, BY_TYPE).select(
        "source", "end_line", F.round("duration_seconds", 6).alias("duration_seconds"), "cause"
    )


@query
def gap_timeline(spark, sf_dir):
    events = data.text_events(spark, sf_dir)
    gaps = sequence.gaps(sequence.steps(events, BY_TYPE), BY_TYPE)
    return narrative.gap_timeline(gaps, sequence.log_extent(events), BY_TYPE)


@query
def pii_totals(spark, sf_dir):
    """Documents as one log per origin."""
    lines = data.table(spark, sf_dir, "documents").select(
        "source",
        F.col("doc_id").alias("line_number"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.col("text").alias("raw_payload"),
    )
    return scoring.line_counters(lines, scan_pii=True).select("source", "pii_leaks")


@query
def incident_narrative(spark, sf_dir):
    settings = BY_TYPE.override(part_rows=500)
    events = _stored_audit(spark, sf_dir)
    gaps = sequence.gaps(sequence.steps(events, settings), settings)
    counters = scoring.combine(
        events.groupBy("source").agg(F.max("line_number").alias("total_lines")), scoring.severity_breakdown(gaps)
    )
    return narrative.incident_narrative(counters, alerts.alert_feed(events, settings), settings)


@query
def explain_narrative(spark, sf_dir):
    return _user_findings(spark, sf_dir, _escalations(spark, sf_dir), scan_pii=True).explanation


# Reports


@query
def integrity_report(spark, sf_dir):
    """The nested report of each user's log, flattened to its scalars and list sizes."""
    report = _user_findings(spark, sf_dir, _escalations(spark, sf_dir), scan_pii=True).report
    return report.select(
        "source",
        "part",
        "metadata.source_file",
        "metadata.file_start",
        "metadata.file_end",
        "metadata.total_lines_processed",
        "metadata.threshold_seconds",
        "metadata.total_timespan_seconds",
        "anomalies.total_gaps_found",
        F.col("anomalies.severity_breakdown.HIGH").alias("high"),
        F.col("anomalies.severity_breakdown.MEDIUM").alias("medium"),
        F.col("anomalies.severity_breakdown.LOW").alias("low"),
        "anomalies.malformed_lines_skipped",
        "anomalies.causality_violations_detected",
        "anomalies.shannon_entropy_collapses",
        "anomalies.alibi_failures_detected",
        "anomalies.pii_leakage_events",
        "trust_metrics.system_status",
        "trust_metrics.log_trust_confidence_percent",
        "trust_metrics.suspicion_reason",
        F.array_join("trust_metrics.trust_deduction_breakdown", "; ").alias("deductions"),
        F.size("detailed_gaps").cast("bigint").alias("n_detailed_gaps"),
        F.array_join("detailed_gaps.duration_human", ", ").alias("gap_durations"),
        F.aggregate(
            "detailed_gaps", F.lit(0).cast("bigint"), lambda total, gap: total + gap["alibi_events_caught"]
        ).alias("alibi_events"),
    )


@query
def gap_ledger(spark, sf_dir):
    return _user_findings(spark, sf_dir, _escalations(spark, sf_dir)).ledger


@query
def gap_numbers(spark, sf_dir):
    return sequence.number_gaps(_text_gaps(spark, sf_dir), BY_TYPE).select("source", "end_line", "gap_number", "gap_id")


@query
def report_gaps(spark, sf_dir):
    """The report's list of gaps, part by part, with all events as the secondary log."""
    found = analyze(
        spark, data.audit_log(spark, sf_dir), settings=BY_TYPE.override(part_rows=500), alibi_logs=[data.event_log(spark, sf_dir)],
        run_at=datetime(2024, 1, 1),
    )
    return found.report.select("source", "part", F.posexplode("detailed_gaps").alias("place", "gap")).select(
        "source", "part", F.col("place").cast("bigint").alias("place"), "gap.*"
    )


@query
def report_alerts(spark, sf_dir):
    """The report's list of alerts, part by part."""
    found = analyze(
        spark, data.audit_json(spark, sf_dir), audit=True, settings=BY_TYPE.override(part_rows=500), run_at=datetime(2024, 1, 1)
    )
    return found.report.select("source", "part", F.posexplode("anomalies.cloud_alerts").alias("place", "message")).select(
        "source", "part", F.col("place").cast("bigint").alias("place"), "message"
    )
