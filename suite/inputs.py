"""Logs derived from the driver's tables: free text with planted damage, audit JSON, and event tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import blocks
from tidemark.settings import BusinessHours, Settings
from tidemark.sources import normalize

# Small blocks, so that the logs at test scale are cut into several.
SUITE = Settings(block_lines=4096)
BY_TYPE = SUITE.override(min_gap_threshold=300)
BY_USER = SUITE.override(min_gap_threshold=100_000)
OFFICE = SUITE.override(business_hours=BusinessHours("09:00", "17:00", ignore_weekends=True))
SAFE = SUITE.override(
    safe_intervals=(
        (datetime(2024, 1, 2, 0, 0), datetime(2024, 1, 3, 12, 0)),
        (datetime(2024, 1, 5, 6, 0), datetime(2024, 1, 5, 18, 0)),
        (datetime(2024, 1, 8, 0, 0), datetime(2024, 1, 12, 0, 0)),
    )
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small file is one split; share its rows out before costly parsing. Larger tables are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as five ordered logs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("line_number"), "ts"
    )


def user_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("event_id").alias("line_number"), "ts"
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by key: half of their dates run backwards."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("line_number"), F.col("o_orderdate").alias("ts")
    )


_LINE = """
case when event_id % 211 = 0 then concat('### corrupt record ', event_id)
else concat(substring(cast(case when event_id % 1009 = 0 then ts - interval 3 hours else ts end as string), 1, 19), ' ',
  case when event_id % 331 = 0 then repeat('A', 60)
  else concat('audit type=', event_type, ' user=', user_id, ' host=h', user_id % 7, ' props=', props) end)
end
"""


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text lines of five logs, with corrupt lines, backward jumps and forged payloads."""
    return spread(table(spark, sf_dir, "events")).select(
        F.col("event_type").alias("source"), F.col("event_id").alias("line_number"), F.expr(_LINE).alias("line")
    )


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as one log per user, numbered from 1."""
    lines = spread(table(spark, sf_dir, "events")).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), "event_id", F.expr(_LINE).alias("line")
    )
    return blocks.numbered(lines, ["source"], ["event_id"], SUITE.block_lines, "line_number").drop("event_id")


def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw audit records of one log, some of them broken JSON."""
    record = F.expr(
        """
        case when event_id % 499 = 0 then concat('{"broken":', event_id)
        else concat('{"eventTime":"', replace(substring(cast(ts as string), 1, 19), ' ', 'T'), 'Z","userIdentity":{"arn":"arn:aws:iam::000000000000:',
          case when user_id % 25 = 0 then 'root' else concat('user/u', user_id) end, '"},"sourceIPAddress":"10.0.0.',
          get_json_object(props, '$.k'), '","awsRegion":"r', user_id % 4, '","eventName":"',
          case when event_id % 50 = 0 then 'CreateAccessKey' else event_type end, '","eventSource":"audit"}')
        end
        """
    )
    return spread(table(spark, sf_dir, "events")).select(
        F.lit("trail").alias("source"), F.col("event_id").alias("line_number"), record.alias("line")
    )


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.events(normalize.normalize_text(audit_log(spark, sf_dir), SUITE))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.events(normalize.normalize_audit(audit_json(spark, sf_dir)))


# Payloads of about 5 and about 3.7 bits a sign: the lower ones are near three quarters of the mean.
_LEVEL = """
concat(substring(cast(ts as string), 1, 19), ' ',
  case when pmod(event_id * 7919, 100) < 85 then substring('abcdefghijklmnopqrstuvwxyz012345', 1, 30 + cast(event_id % 3 as int))
  else repeat(substring('abcdefghijklmnopqrstuvwxyz', 1, 12 + cast(user_id % 2 as int)), 2) end)
"""


def two_level_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in which most judgements of a payload hang on earlier ones."""
    lines = spread(table(spark, sf_dir, "events")).select(
        F.col("event_type").alias("source"), F.col("event_id").alias("line_number"), F.expr(_LEVEL).alias("line")
    )
    return normalize.events(normalize.normalize_text(lines, SUITE))


def stamped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that open with eight kinds of time stamp, some of them not acceptable."""
    line = F.expr(
        """
        concat(case event_id % 8
          when 0 then concat(replace(substring(d, 3, 8), '-', ''), ' ', replace(t, ':', ''))
          when 1 then concat(d, ' ', t, ',123')
          when 2 then concat(d, ' ', t)
          when 3 then concat(d, ' ', t, '.123')
          when 4 then concat(substring('JanFebMarAprMayJunJulAugSepOctNovDec', month(ts) * 3 - 2, 3), ' ', lpad(day(ts), 2, ' '), ' ', t)
          when 5 then concat(d, 'T', t)
          when 6 then concat(d, ' ', substring(t, 1, 6), '60')
          else concat('99', replace(substring(d, 6, 5), '-', ''), ' ', replace(t, ':', ''))
        end, ' ', props)
        """
    )
    return (
        spread(table(spark, sf_dir, "events"))
        .withColumns({"d": F.expr("substring(cast(ts as string), 1, 10)"), "t": F.expr("substring(cast(ts as string), 12, 8)")})
        .select(F.col("event_type").alias("source"), F.col("event_id").alias("line_number"), line.alias("line"))
    )
