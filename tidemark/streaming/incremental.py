"""Findings of logs that keep growing.

Every micro-batch runs the batch operators, which split a busy log over many tasks, and continues from a small state:
the last event, line count and entropy baseline of each log, and where each actor was last seen. A batch reads the state
left by the batches before it and writes its findings, counters and state under its own number, so running a batch again
after a failure replaces what it wrote before and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import alerts, baseline, blocks, scoring, sequence
from tidemark.plans.analyze import Findings
from tidemark.schemas import ALERT_COLUMNS
from tidemark.settings import Settings, load_settings
from tidemark.sources import files, normalize
from tidemark.streaming.follow import FILE_ORDER
from tidemark.workspace import Workspace

LOG_STATE = "source STRING, lines BIGINT, line_number BIGINT, ts TIMESTAMP_NTZ, n BIGINT, r DOUBLE"
ACTOR_STATE = "source STRING, actor STRING, line_number BIGINT, ts TIMESTAMP_NTZ, source_ip STRING"
COUNTERS = (
    "source STRING, total_lines BIGINT, malformed_count BIGINT, file_start TIMESTAMP_NTZ, file_end TIMESTAMP_NTZ, "
    "pii_leaks BIGINT, max_gap_violations BIGINT, causality_count BIGINT, total_gaps BIGINT, low_count BIGINT, "
    "medium_count BIGINT, high_count BIGINT, forgery_count BIGINT"
)
FINDING_SCHEMAS = {
    "gaps": "source STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, duration_us BIGINT, duration_seconds DOUBLE, "
    "severity STRING, start_line BIGINT, end_line BIGINT",
    "causality": "source STRING, timestamp_before TIMESTAMP_NTZ, timestamp_after TIMESTAMP_NTZ, line_number BIGINT",
    "max_gap_violations": "source STRING, line_number BIGINT, timestamp_before TIMESTAMP_NTZ, "
    "timestamp_after TIMESTAMP_NTZ, delta_seconds DOUBLE",
    "forgeries": "source STRING, line_number BIGINT, ts TIMESTAMP_NTZ, entropy DOUBLE, baseline DOUBLE, raw_text STRING",
    "alerts": "source STRING, line_number BIGINT, kind_rank INT, kind STRING, ts TIMESTAMP_NTZ, actor STRING, "
    "event_name STRING, prev_ip STRING, source_ip STRING, delta_hours DOUBLE, message STRING",
    "rejects": "source STRING, line_number BIGINT, line STRING",
}


#: Parts that a state is kept in; a batch reads and writes those of its own keys.
BUCKETS = 64


class StateTable:
    """The latest row per key, stored as the changes of each batch and, now and then, as a whole.

    Either is laid out by a hash of the key, so a batch reads the parts that its keys are in. Once there are two newer whole
    copies, what is older is removed: a batch that is run again starts from a copy before it.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], whole_every: int):
        self.spark, self.folder, self.schema, self.keys, self.whole_every = spark, folder, schema, keys, whole_every

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def before(self, batch_id: int, wanted: DataFrame | None = None) -> DataFrame:
        """State as the batches before ``batch_id`` left it, for the keys in ``wanted`` or for all."""
        return self._state(batch_id, batch_id, wanted)

    def _state(self, batch_id: int, whole_before: int, wanted: DataFrame | None = None) -> DataFrame:
        """As ``before``, starting from a whole copy older than ``whole_before``."""
        whole = [n for n in _numbers(self.spark, f"{self.folder}/whole") if n < whole_before]
        base = max(whole, default=-1)
        later = [n for n in _numbers(self.spark, f"{self.folder}/changes") if base < n < batch_id]
        buckets = None
        if wanted is not None:
            buckets = sorted(row[0] for row in wanted.select(self._bucket()).distinct().collect())
        parts = [self._read("whole", [base], buckets)] if whole else []
        parts += [self._read("changes", later, buckets)] if later else []
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, parts)
        if wanted is not None:
            rows = rows.join(wanted, self.keys, "left_semi")
        values = [c for c in rows.columns if c not in self.keys and c not in ("number", "bucket")]
        latest = rows.groupBy(*self.keys).agg(*[F.max_by(c, "number").alias(c) for c in values])
        return latest.select(*self.spark.createDataFrame([], self.schema).columns)

    def _read(self, kind: str, numbers: list[int], buckets: list[int] | None) -> DataFrame:
        reader = self.spark.read.schema(f"{self.schema}, number BIGINT, bucket INT").option("basePath", f"{self.folder}/{kind}")
        rows = reader.parquet(*[f"{self.folder}/{kind}/number={n}" for n in numbers])
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def write(self, batch_id: int, changes: DataFrame) -> None:
        self._put(f"{self.folder}/changes/number={batch_id}", changes)
        if (batch_id + 1) % self.whole_every == 0:
            # Never from this batch's own copy, which an earlier try may have left.
            self._put(f"{self.folder}/whole/number={batch_id}", self._state(batch_id + 1, batch_id))
            self._forget()

    def _put(self, path: str, rows: DataFrame) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _forget(self) -> None:
        whole = _numbers(self.spark, f"{self.folder}/whole")
        if len(whole) > 2:
            kept = whole[-2]
            for kind, numbers in (("whole", whole), ("changes", _numbers(self.spark, f"{self.folder}/changes"))):
                for n in numbers:
                    if n < kept or n == kept and kind == "changes":
                        _remove(self.spark, f"{self.folder}/{kind}/number={n}")


@dataclass
class LogStream:
    """One stream's settings and folders; ``process`` is the batch function."""

    spark: SparkSession
    folder: str
    settings: Settings
    normalizer: normalize.Normalizer
    scan_pii: bool = False
    whole_every: int = 20
    on_findings: Callable[[dict[str, DataFrame], int], None] | None = None

    @cached_property
    def logs(self) -> StateTable:
        return StateTable(self.spark, f"{self.folder}/state/logs", LOG_STATE, ["source"], self.whole_every)

    @cached_property
    def actors(self) -> StateTable:
        return StateTable(self.spark, f"{self.folder}/state/actors", ACTOR_STATE, ["source", "actor"], self.whole_every)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        space = Workspace(self.spark, f"{self.folder}/work/{batch_id}")
        space.release()
        settings = self.settings
        lines = self._numbered_lines(batch, batch_id, space)
        events = normalize.events(lines)
        logs = space.keep(self.logs.before(batch_id, lines.select("source").distinct()), "logs")
        last_seen = logs.filter(F.col("ts").isNotNull()).select("source", "line_number", "ts")
        steps = space.keep(sequence.notable(sequence.steps(events, settings, last_seen), settings), "steps")
        forgeries, baselines = baseline.collapse_and_state(
            events, settings, space, logs.filter(F.col("n") > 0).select("source", "n", "r")
        )
        located = alerts.located(events)
        actors = space.keep(self.actors.before(batch_id, located.select("source", "actor").distinct()), "actors")
        found = {
            "gaps": sequence.gaps(steps, settings),
            "causality": sequence.causality_violations(steps),
            "max_gap_violations": sequence.max_gap_violations(steps, settings),
            "forgeries": forgeries,
            "alerts": alerts.alert_feed(events, settings, actors).select(*ALERT_COLUMNS),
            "rejects": normalize.rejects(lines),
        }
        stored = dict(zip(found, self._together(
            [lambda kind=kind, rows=rows: self._store(kind, rows, batch_id) for kind, rows in found.items()]
        )))
        counted = scoring.combine(
            scoring.line_counters(lines, self.scan_pii),
            scoring.step_counters(steps, settings),
            scoring.severity_breakdown(stored["gaps"]),
            scoring.forgery_counters(stored["forgeries"]),
        ).drop("alibi_failures")
        self._together([
            lambda: self._store("counters", counted, batch_id),
            lambda: self.logs.write(batch_id, self._log_changes(lines, events, logs, baselines)),
            lambda: self.actors.write(batch_id, self._actor_changes(located)),
        ])
        if (batch_id + 1) % self.whole_every == 0:
            self._fold_counters(batch_id)
        _write_text(self.spark, f"{self.folder}/committed", str(batch_id))
        if self.on_findings is not None:
            self.on_findings(stored, batch_id)
        space.release()

    def _fold_counters(self, batch_id: int) -> None:
        """The counters of all batches so far in one table, so that a report reads few; the parts of older folds go."""
        folded = f"{self.folder}/counters_whole"
        parts = _counter_parts(self.spark, self.folder, batch_id, before=batch_id)
        _merged_counters(parts).withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{folded}/number={batch_id}")
        whole = _numbers(self.spark, folded)
        if len(whole) > 2:
            for n in whole[:-2]:
                _remove(self.spark, f"{folded}/number={n}")
            for n in _numbers(self.spark, f"{self.folder}/counters"):
                if n <= whole[-2]:
                    _remove(self.spark, f"{self.folder}/counters/batch_id={n}")

    def _store(self, kind: str, rows: DataFrame, batch_id: int) -> DataFrame:
        path = f"{self.folder}/{kind}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _together(self, tasks: list[Callable[[], object]]) -> list:
        """Run independent writes side by side; small jobs leave most of a cluster idle one after another."""
        with ThreadPoolExecutor(len(tasks)) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(task)) for task in tasks]]

    def _numbered_lines(self, batch: DataFrame, batch_id: int, space: Workspace) -> DataFrame:
        """The batch's lines, normalized and numbered on from the lines of earlier batches."""
        if "seq" in batch.columns:
            numbered = blocks.numbered(
                space.keep(batch.select("source", "seq", "line"), "raw"), ["source"], ["seq"], self.settings.block_lines,
                "line_number",
            ).drop("seq")
        else:
            raw = space.keep(batch.withColumn("counter", F.monotonically_increasing_id()), "raw")
            numbered = files.with_line_numbers(raw, space, FILE_ORDER)
        known = self.logs.before(batch_id, numbered.select("source").distinct()).select("source", "lines")
        shifted = numbered.join(self._hint(known), "source", "left").withColumn(
            "line_number", F.col("line_number") + F.coalesce("lines", F.lit(0))
        )
        return space.keep(self.normalizer(shifted.select("source", "line_number", "line"), self.settings), "lines")

    def _hint(self, per_log: DataFrame, limit: int = 200_000) -> DataFrame:
        """A table with one row per log is sent to every executor when it is known to be small."""
        return F.broadcast(per_log) if per_log.limit(limit + 1).count() <= limit else per_log

    def _log_changes(self, lines: DataFrame, events: DataFrame, logs: DataFrame, baselines: DataFrame) -> DataFrame:
        line_state = lines.groupBy("source").agg(F.max("line_number").alias("lines"))
        last_events = blocks.last_values(events.select("source", "line_number", "ts"), ["source"], "line_number", ["ts"])
        new = line_state.join(last_events, "source", "left").join(baselines, "source", "left")
        old = logs.select("source", *[F.col(c).alias(f"_old_{c}") for c in ("line_number", "ts", "n", "r")])
        return new.join(old, "source", "left").select(
            "source", "lines", *[F.coalesce(c, f"_old_{c}").alias(c) for c in ("line_number", "ts", "n", "r")]
        )

    def _actor_changes(self, located: DataFrame) -> DataFrame:
        seen = blocks.last_values(located, ["source", "actor"], "line_number", ["ts", "source_ip"])
        return seen.select("source", "actor", "line_number", "ts", "source_ip")


def analyze_stream(
    stream: DataFrame,
    folder: str,
    checkpoint: str | None = None,
    *,
    audit: bool = False,
    normalizer: normalize.Normalizer | None = None,
    settings: Settings | None = None,
    settings_path: str | None = None,
    scan_pii: bool = False,
    on_findings: Callable[[dict[str, DataFrame], int], None] | None = None,
    trigger: dict | None = None,
    whole_every: int = 20,
    **overrides,
) -> StreamingQuery:
    """Start analyzing a stream of (source, seq, line), or of followed files; findings go to tables below ``folder``.

    ``on_findings`` is called with each batch's findings once they are stored. Stop the query at any time and read what
    was seen so far with :func:`findings_so_far`.
    """
    chosen = settings or (load_settings(settings_path) if settings_path else Settings())
    parse = normalizer or (normalize.normalize_audit if audit else normalize.normalize_text)
    log = LogStream(
        stream.sparkSession, folder.rstrip("/"), chosen.override(**overrides), parse, scan_pii, whole_every, on_findings
    )
    return (
        stream.writeStream.foreachBatch(log.process)
        .option("checkpointLocation", checkpoint or f"{log.folder}/checkpoint")
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


class StreamFindings(Findings):
    """Findings read from a stream's tables, up to the last batch that was stored in full."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings, scan_pii: bool = False):
        super().__init__(None, settings, Workspace(spark), scan_pii=scan_pii)
        self.spark, self.folder = spark, folder.rstrip("/")
        self.last_batch = int(_read_text(spark, f"{self.folder}/committed") or -1)

    def _table(self, kind: str, schema: str) -> DataFrame:
        if self.last_batch < 0:
            return self.spark.createDataFrame([], schema)
        return (
            self.spark.read.schema(f"{schema}, batch_id BIGINT")
            .parquet(f"{self.folder}/{kind}")
            .filter(F.col("batch_id") <= self.last_batch)
        )

    def _finding(self, kind: str) -> DataFrame:
        return self._table(kind, FINDING_SCHEMAS[kind]).drop("batch_id")

    @cached_property
    def rejects(self) -> DataFrame:
        return self._finding("rejects")

    @cached_property
    def gaps(self) -> DataFrame:
        return self._finding("gaps").withColumn("alibi_evidence_count", F.lit(0).cast("bigint"))

    @cached_property
    def causality(self) -> DataFrame:
        return self._finding("causality")

    @cached_property
    def max_gap_violations(self) -> DataFrame:
        return self._finding("max_gap_violations")

    @cached_property
    def forgeries(self) -> DataFrame:
        return self._finding("forgeries")

    @cached_property
    def alerts(self) -> DataFrame:
        return self._finding("alerts")

    @cached_property
    def counters(self) -> DataFrame:
        if self.last_batch < 0:
            return scoring.combine(_merged_counters(self.spark.createDataFrame([], f"{COUNTERS}, batch_id BIGINT")))
        return scoring.combine(_merged_counters(_counter_parts(self.spark, self.folder, self.last_batch, self.last_batch + 1)))


def _counter_parts(spark: SparkSession, folder: str, last: int, before: int) -> DataFrame:
    """Counters of the batches up to ``last``, those that a fold older than ``before`` holds as one."""
    base = max((n for n in _numbers(spark, f"{folder}/counters_whole") if n < before), default=-1)
    schema = f"{COUNTERS}, batch_id BIGINT"
    later = [n for n in _numbers(spark, f"{folder}/counters") if base < n <= last]
    parts = spark.createDataFrame([], schema)
    if base >= 0:
        parts = parts.unionByName(spark.read.schema(schema).parquet(f"{folder}/counters_whole/number={base}"))
    if later:
        found = spark.read.schema(schema).option("basePath", f"{folder}/counters")
        parts = parts.unionByName(found.parquet(*[f"{folder}/counters/batch_id={n}" for n in later]))
    return parts


def _merged_counters(parts: DataFrame) -> DataFrame:
    summed = (
        "malformed_count", "pii_leaks", "max_gap_violations", "causality_count", "total_gaps", "low_count",
        "medium_count", "high_count", "forgery_count",
    )
    with_start = F.when(F.col("file_start").isNotNull(), F.col("batch_id"))
    return parts.groupBy("source").agg(
        F.max("total_lines").alias("total_lines"),
        *[F.sum(c).alias(c) for c in summed],
        F.min_by("file_start", with_start).alias("file_start"),
        F.max_by("file_end", with_start).alias("file_end"),
    )


def findings_so_far(
    spark: SparkSession, folder: str, settings: Settings | None = None, scan_pii: bool = False
) -> StreamFindings:
    """The report, scores and tables of what a stream has stored until now.

    Take it anew to see later batches: its tables are read when used, and old parts are removed as the stream goes on.
    """
    return StreamFindings(spark, folder, settings or Settings(), scan_pii)


def live_alerts(lines: DataFrame, settings: Settings) -> DataFrame:
    """Escalation and root alerts of a stream of normalized lines, as a stream: they need no state."""
    return alerts.rule_alerts(normalize.events(lines), settings)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The complete numbered tables in a folder; their names end with a number after ``=``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    done = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS"))
    return sorted(int(status.getPath().getParent().getName().rsplit("=", 1)[-1]) for status in done)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write_text(spark: SparkSession, name: str, text: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _read_text(spark: SparkSession, name: str) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(name, wholetext=True).first()[0].strip()
