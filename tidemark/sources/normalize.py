"""From raw lines to normalized events, as projections over whole tables.

Every normalizer keeps one row per raw line. A line that is no event comes out with a null ``ts``; ``events`` and
``rejects`` split the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import stamps, text
from tidemark.schemas import EVENT_COLUMNS, EVENTS
from tidemark.settings import Settings

# Fixed value: the three shapes of time stamp that can open a text line.
STAMP_HEADER = (
    r"(?U)^(\d{2,4}[-/]?\d{2}[-/]?\d{2}[T\s]?\d{2}:\d{2}:\d{2}(?:\.\d+)?|"
    r"\d{6}\s+\d{6}|"
    r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
)

Normalizer = Callable[[DataFrame, Settings], DataFrame]


def normalize_text(raw: DataFrame, settings: Settings) -> DataFrame:
    """Free text: a stamp at the start of the stripped line, read by the first configured format that fits it."""
    stamp = stamps.first_stamp(F.col("_stamp"), settings.timestamp_formats, settings.default_year)
    shaped = raw.withColumn("_payload", text.strip(F.col("line"))).withColumn(
        "_stamp", F.regexp_extract("_payload", STAMP_HEADER, 1)
    )
    return _with_all_columns(_evaluated(shaped, ts=F.when(F.col("_stamp") != "", stamp)))


# Kept as variants, so that a value that is no text can be told from one that is.
_RECORD = (
    "array<struct<eventTime: variant, userIdentity: struct<arn: variant, userName: variant, principalId: variant>, "
    "sourceIPAddress: string, awsRegion: string, eventName: string, eventSource: string>>"
)


_TYPED = {
    "time": "_record.eventTime",
    "arn": "_record.userIdentity.arn",
    "user": "_record.userIdentity.userName",
    "principal": "_record.userIdentity.principalId",
}


# Names and texts in single quotes are no JSON.
STRICT = {"allowSingleQuotes": "false"}


def normalize_audit(raw: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Cloud audit records, one JSON object per line.

    The line is parsed as the only element of an array, which turns away text after the object. A time or an actor
    that is not text rejects the line.
    """
    payload = text.strip(F.col("line"))
    parsed = F.from_json(F.concat(F.lit("["), F.col("_payload"), F.lit("]")), _RECORD, STRICT)
    record = F.when(
        F.startswith("_payload", F.lit("{")) & F.endswith("_payload", F.lit("}")), parsed
    )
    shaped = (
        raw.withColumn("_payload", payload)
        .withColumn("_records", record)
        .withColumn("_record", F.when(F.size("_records") == 1, F.get("_records", F.lit(0))))
    )
    shaped = shaped.withColumns(
        {
            f"_{part}_{name}": F.expr(expression.format(field))
            for name, field in _TYPED.items()
            for part, expression in (("text", "try_variant_get({}, '$', 'string')"), ("type", "schema_of_variant({})"))
        }
    )
    actor, fit = _first_actor()
    when = F.col("_text_time")
    is_text = F.col("_type_time") == "STRING"
    stamp = F.when(is_text & (when != "") & fit, stamps.iso_stamp(when))
    return _with_all_columns(
        _evaluated(
            shaped,
            ts=stamp,
            actor=actor,
            source_ip=F.col("_record.sourceIPAddress"),
            region=F.col("_record.awsRegion"),
            event_name=F.col("_record.eventName"),
            event_source=F.col("_record.eventSource"),
        )
    )


def _evaluated(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns through a generator, which the optimizer does not copy expressions out of.

    As plain columns they would be worked out again in every filter that is pushed below them.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[value.alias(name) for name, value in values.items()]))))


def _first_actor() -> tuple[Column, Column]:
    """The first non-empty of arn, user name and principal, and whether it is text (or there is none)."""
    actor, fit = F.lit(None).cast("string"), F.lit(True)
    for name in ("principal", "user", "arn"):
        value, kind = F.col(f"_text_{name}"), F.coalesce(F.col(f"_type_{name}"), F.lit("VOID"))
        # Nothing, empty text, false, zero and empty containers pass the turn on.
        empty = (
            F.when(kind == "STRING", value == "")
            .when(kind == "VOID", True)
            .otherwise(value.isin("false", "0", "[]", "{}"))
        )
        actor = F.when(empty, actor).otherwise(value)
        fit = F.when(empty, fit).otherwise(kind == "STRING")
    return actor, fit


def normalize_with(function: Callable[[str, int], object]) -> Normalizer:
    """A normalizer from a Python function ``(line, line_number) -> mapping or None``.

    The mapping holds ``ts`` (a naive datetime) and any of the other event columns. The function runs inside Arrow
    batches; prefer a DataFrame normalizer where built-in expressions can do the work.
    """

    columns = EVENT_COLUMNS

    def parse_batches(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for source, number, line in zip(*(batch.column(name).to_pylist() for name in ("source", "line_number", "line"))):
                event = function(line, number) or {}
                row = {name: event.get(name) for name in columns}
                row.update(source=source, line_number=number)
                if row["raw_payload"] is None:
                    row["raw_payload"] = line
                if row["ts"] is not None:
                    row["ts"] = row["ts"].replace(tzinfo=None)
                rows.append(row)
            strings = [name for name in columns if name not in ("line_number", "ts")]
            fields = {name: pa.string() for name in strings}
            fields.update(line_number=pa.int64(), ts=pa.timestamp("us"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[name] for row in rows], type=fields[name]) for name in columns], names=list(columns)
            )

    def normalizer(raw: DataFrame, settings: Settings) -> DataFrame:
        return raw.select("source", "line_number", "line").mapInArrow(parse_batches, EVENTS)

    return normalizer


def _with_all_columns(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if not c.startswith("_") and c not in EVENT_COLUMNS and c != "line"]
    optional = ("actor", "source_ip", "region", "event_name", "event_source")
    # A line that is no event keeps its text and nothing else.
    named = [
        (F.when(F.col("ts").isNotNull(), F.col(name)) if name in df.columns else F.lit(None).cast("string")).alias(name)
        for name in optional
    ]
    numbered = ["line_number"] if "line_number" in df.columns else []
    return df.select(*kept, "source", *numbered, "ts", F.col("_payload").alias("raw_payload"), *named)


def events(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("ts").isNotNull())


def rejects(lines: DataFrame) -> DataFrame:
    """The lines that are no event, blank ones included."""
    return lines.filter(F.col("ts").isNull()).select("source", "line_number", F.col("raw_payload").alias("line"))
