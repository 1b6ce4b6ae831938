"""Rules over single events (escalation, root use) and over an actor's consecutive events (impossible travel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import time as t
from tidemark.functions.rounding import two_decimals_text
from tidemark.operators import blocks
from tidemark.schemas import ALERT_COLUMNS
from tidemark.settings import Settings

ESCALATION, ROOT, TRAVEL = "IAM_ESCALATION", "ROOT_ABUSE", "IMPOSSIBLE_TRAVEL"


def _text(column):
    return F.coalesce(column.cast("string"), F.lit("None"))


def is_escalation(settings: Settings):
    return F.coalesce(F.col("event_name").isin(*settings.suspicious_events), F.lit(False))


def is_root_use(settings: Settings):
    """Root anywhere in the actor's name, unless the escalation rule already fired."""
    named_root = F.coalesce(F.contains(F.lower(F.col("actor")), F.lit("root")), F.lit(False))
    return ~is_escalation(settings) & named_root


def rule_alerts(events: DataFrame, settings: Settings) -> DataFrame:
    """Escalation and root alerts. A plain projection and filter, so it works the same on a stream."""
    kind = F.when(is_escalation(settings), ESCALATION).when(is_root_use(settings), ROOT)
    stamp, actor, name = t.text_stamp(F.col("ts")), _text(F.col("actor")), _text(F.col("event_name"))
    # The alert sentences.
    escalation = F.concat(F.lit("⚠️ IAM ESCALATION WARNING: "), actor, F.lit(" performed "), name, F.lit(" at "), stamp)
    root = F.concat(
        F.lit("⚠️ ROOT ABUSE WARNING: AWS Root account activity detected at "), stamp, F.lit(" ("), name, F.lit(")")
    )
    return (
        events.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(
            "source",
            "line_number",
            F.lit(0).alias("kind_rank"),
            "kind",
            "ts",
            "actor",
            "event_name",
            F.lit(None).cast("string").alias("prev_ip"),
            "source_ip",
            F.lit(None).cast("double").alias("delta_hours"),
            F.when(F.col("kind") == ESCALATION, escalation).otherwise(root).alias("message"),
        )
    )


def iam_escalation(events: DataFrame, settings: Settings) -> DataFrame:
    return rule_alerts(events.filter(is_escalation(settings)), settings)


def root_abuse(events: DataFrame, settings: Settings) -> DataFrame:
    return rule_alerts(events.filter(is_root_use(settings)), settings)


def located(events: DataFrame) -> DataFrame:
    """The events that tell where an actor was."""
    return events.filter((F.col("actor") != "") & (F.col("source_ip") != "")).select(
        "source", "actor", "line_number", "ts", "source_ip"
    )


def impossible_travel(events: DataFrame, settings: Settings, initial: DataFrame | None = None) -> DataFrame:
    """Another address than the same actor's event before, less than an hour and more than no time later.

    ``initial`` (source, actor, line_number, ts, source_ip) gives where each actor was last seen.
    """
    moves = blocks.previous_values(
        located(events), ["source", "actor"], "line_number", ["ts", "source_ip"], settings.block_lines, initial
    )
    delta = t.micros_between(F.col("prev_ts"), F.col("ts"))
    hours = t.seconds(F.col("_delta")) / F.lit(3600.0)
    # Fixed value: the alert sentence.
    message = F.concat(
        F.lit("🚨 IMPOSSIBLE TRAVEL WARNING: "), F.col("actor"), F.lit(" jumped from "), F.col("prev_source_ip"),
        F.lit(" to "), F.col("source_ip"), F.lit(" in "), two_decimals_text(hours), F.lit(" hours!"),
    )
    return (
        moves.filter(F.col("prev_source_ip") != F.col("source_ip"))
        .withColumn("_delta", delta)
        .filter((F.col("_delta") > 0) & (F.col("_delta") < 3600 * t.MICROS))
        .select(
            "source",
            "line_number",
            F.lit(1).alias("kind_rank"),
            F.lit(TRAVEL).alias("kind"),
            "ts",
            "actor",
            F.lit(None).cast("string").alias("event_name"),
            F.col("prev_source_ip").alias("prev_ip"),
            "source_ip",
            hours.alias("delta_hours"),
            message.alias("message"),
        )
    )


def alert_feed(events: DataFrame, settings: Settings, initial: DataFrame | None = None) -> DataFrame:
    """All alerts; a log's order is (line_number, kind_rank): the rule alert of a line before its travel alert."""
    return (
        rule_alerts(events, settings)
        .select(*ALERT_COLUMNS)
        .unionByName(impossible_travel(events, settings, initial).select(*ALERT_COLUMNS))
    )


# Technique per finding. No rule raises the trail and logging ones; they are listed for lookup.
TECHNIQUES = {
    "DeleteTrail": "T1562.008 (Disable or Modify Cloud Trail)",
    "StopLogging": "T1562.008 (Disable or Modify Cloud Trail)",
    "CreateAccessKey": "T1098 (Account Manipulation)",
    "ConsoleLogin": "T1078 (Valid Accounts)",
    "root_abuse": "T1078.001 (Default Accounts)",
    "time_gap": "T1070.006 (Timestomp / Indicator Removal)",
}
TECHNIQUE_OF_KIND = {ESCALATION: "CreateAccessKey", ROOT: "root_abuse", TRAVEL: "ConsoleLogin"}


def with_technique(alerts: DataFrame) -> DataFrame:
    """Add the technique of each alert. The lookup has one row per alert kind, so it is always small."""
    rows = [(kind, key, TECHNIQUES[key]) for kind, key in TECHNIQUE_OF_KIND.items()]
    lookup = alerts.sparkSession.createDataFrame(rows, "kind STRING, technique_key STRING, technique STRING")
    return alerts.join(F.broadcast(lookup), "kind", "left")
