"""Findings put into sentences, and the gaps of a log drawn on a line of sixty marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import time as t
from tidemark.operators import blocks
from tidemark.operators.alerts import ESCALATION, ROOT, TECHNIQUES, TRAVEL
from tidemark.settings import Settings

# The sentences of the incident narrative.
ALERT_SENTENCES = {
    ROOT: f"Root account usage detected, representing a severe risk [{TECHNIQUES['root_abuse']}].",
    ESCALATION: f"Privilege escalation activity detected in the audit trail [{TECHNIQUES['CreateAccessKey']}].",
    TRAVEL: f"Impossible travel authentication anomaly detected [{TECHNIQUES['ConsoleLogin']}].",
}
GAP_SENTENCE = f" abnormal audit silence(s) indicating potential log tampering [{TECHNIQUES['time_gap']}]."
QUIET_SENTENCE = "No significant structural or IAM anomalies detected in the audit sequence."
# The marks of the timeline.
MARKS = {"HIGH": "X", "MEDIUM": "x", "LOW": "!"}
BUCKETS = 60


def incident_narrative(counters: DataFrame, alerts: DataFrame, settings: Settings) -> DataFrame:
    """One text per log: a sentence on its gaps, then one per alert in order.

    A text grows with the alerts, so it comes in numbered parts of ``part_rows`` alerts. A log with no more alerts than
    that has one part; the parts of a longer one, joined by a space in order, are its whole text.
    """
    sentence = F.lit(None).cast("string")
    for kind, words in ALERT_SENTENCES.items():
        sentence = F.when(F.col("kind") == kind, words).otherwise(sentence)
    told = blocks.numbered(
        alerts.select("source", "line_number", "kind_rank", "kind"), ["source"], ["line_number", "kind_rank"],
        settings.block_lines, "place",
    ).select("source", "place", sentence.alias("sentence"))
    opening = counters.filter(F.col("total_gaps") > 0).select(
        "source",
        F.lit(0).cast("bigint").alias("place"),
        F.concat(F.lit("Detected "), F.col("total_gaps").cast("string"), F.lit(GAP_SENTENCE)).alias("sentence"),
    )
    sentences = told.unionByName(opening)
    parts = (
        sentences.withColumn("part", F.expr(f"greatest(place - 1, 0L) div {settings.part_rows}L"))
        .groupBy("source", "part")
        .agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("told"))
        .select("source", "part", F.concat_ws(" ", F.col("told.sentence")).alias("narrative"))
    )
    # A log has part 0 as soon as it has anything to tell.
    first = parts.filter(F.col("part") == 0).select("source")
    quiet = counters.join(first, "source", "left_anti").select(
        "source", F.lit(0).cast("bigint").alias("part"), F.lit(QUIET_SENTENCE).alias("narrative")
    )
    return parts.unionByName(quiet)


def explanation() -> Column:
    """A status sentence and one sentence per kind of evidence, over scored counters."""
    count = lambda name: F.col(name).cast("string")
    # The sentences, in this order.
    status = (
        F.when(F.col("status") == "COMPROMISED", "The system sustained a highly sophisticated data-poisoning attack.")
        .when(
            F.col("status") == "SUSPICIOUS",
            "The system exhibits suspicious temporal anomalies indicating potential probing or configuration failure.",
        )
        .otherwise("No active hostility detected. System timeline is contiguous.")
    )
    return F.concat_ws(
        " ",
        status,
        F.when(
            F.col("causality_count") > 0,
            "The attacker likely spoofed NTP timestamps to mask activities, mapping to MITRE T1070.006 "
            "(Indicator Removal: Timestomp).",
        ),
        F.when(
            F.col("forgery_count") > 0,
            "Synthetic log payloads injected to bypass volumetric detection, mapping to MITRE T1001 (Data Obfuscation).",
        ),
        F.when(
            F.col("alibi_failures") > 0,
            F.concat(
                F.lit("Secondary systems successfully achieved consensus ("),
                count("alibi_failures"),
                F.lit(
                    " background activities confirmed during gaps), cryptographically proving intentional target log "
                    "manipulation."
                ),
            ),
        ),
        F.when(
            F.col("pii_leaks") > 0,
            F.concat(
                F.lit("Data exfiltration risk flagged: "),
                count("pii_leaks"),
                F.lit(" sensitive PII leakage events caught, mapping to MITRE T1005 (Data from Local System)."),
            ),
        ),
    )


def explain(scored: DataFrame) -> DataFrame:
    return scored.select("source", explanation().alias("narrative"))


def with_position(gaps: DataFrame, extent: DataFrame, settings: Settings) -> DataFrame:
    """Attach ``file_start`` and ``span_us`` of the log to each of its gaps."""
    per_log = extent.select("source", "file_start", "span_us")
    return blocks.attach(gaps, "end_line", per_log, "source", settings.block_lines)


def gap_timeline(gaps: DataFrame, extent: DataFrame, settings: Settings) -> DataFrame:
    """Per log a line of sixty marks over its span; where gaps share a mark the last one shows. No span, no line."""
    placed = with_position(gaps, extent, settings).filter(F.col("span_us") > 0)
    offset = F.greatest(F.lit(0.0), t.seconds(t.micros_between(F.col("file_start"), F.col("start_time"))))
    width = t.seconds(F.col("span_us")) / F.lit(float(BUCKETS))
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(offset / width).cast("int"))
    mark = F.lit(None).cast("string")
    for level, sign in MARKS.items():
        mark = F.when(F.col("level") == level, sign).otherwise(mark)
    drawn = (
        placed.withColumn("bucket", bucket)
        .groupBy("source", "bucket")
        .agg(F.max_by("severity", "end_line").alias("level"))
        .groupBy("source")
        .agg(F.map_from_entries(F.collect_list(F.struct("bucket", mark.alias("mark")))).alias("marks"))
    )
    line = F.concat_ws(
        "", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("marks", b), F.lit(".")))
    )
    return (
        extent.filter(F.col("span_us") > 0)
        .select("source")
        .join(drawn, "source", "left")
        .select("source", line.alias("timeline"))
    )
