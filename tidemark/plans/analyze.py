"""One call from logs to findings."""

from __future__ import annotations

import dataclasses
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import alerts, alibi, baseline, medians, narrative, scoring, sequence
from tidemark.plans import report as reports
from tidemark.schemas import EVENT_COLUMNS
from tidemark.settings import Settings, load_settings
from tidemark.sources import files, normalize
from tidemark.workspace import Workspace


@dataclass
class Findings:
    """The results of one run. Every attribute is a DataFrame that is computed when it is used.

    Lines and notable steps are written once in the workspace, as almost everything else reads them; ``release`` removes them.
    """

    lines: DataFrame
    settings: Settings
    workspace: Workspace
    scan_pii: bool = False
    #: Each gives the time stamps of a secondary log; called only once there are gaps to check.
    secondary: list[Callable[[], DataFrame]] = dataclasses.field(default_factory=list)
    hashes: DataFrame | None = None
    #: Names of the logs' files, known without reading them.
    names: DataFrame | None = None
    run_at: datetime = dataclasses.field(default_factory=datetime.now)

    @cached_property
    def events(self) -> DataFrame:
        return normalize.events(self.lines)

    @cached_property
    def rejects(self) -> DataFrame:
        return normalize.rejects(self.lines)

    @cached_property
    def steps(self) -> DataFrame:
        return sequence.steps(self.events, self.settings)

    @cached_property
    def notable_steps(self) -> DataFrame:
        """Stored, so that the lines are ordered once for gaps, causality, jumps and their counts."""
        return self.workspace.keep(sequence.notable(self.steps, self.settings), "steps")

    @cached_property
    def gaps(self) -> DataFrame:
        found = sequence.gaps(self.notable_steps, self.settings)
        # Without gaps the other logs are not read.
        if not self.secondary or found.isEmpty():
            return alibi.cross_check(found, [], self.settings)
        secondary = [stamps_of() for stamps_of in self.secondary]
        return self.workspace.keep(alibi.cross_check(found, secondary, self.settings, self.workspace), "gaps")

    @cached_property
    def causality(self) -> DataFrame:
        return sequence.causality_violations(self.notable_steps)

    @cached_property
    def max_gap_violations(self) -> DataFrame:
        return sequence.max_gap_violations(self.notable_steps, self.settings)

    @cached_property
    def forgeries(self) -> DataFrame:
        """Stored, as the counters, the report and the caller read them."""
        found = baseline.entropy_collapse(self.events, self.settings, self.workspace)
        return self.workspace.keep(found, "forgeries")

    @cached_property
    def alerts(self) -> DataFrame:
        """Stored, as the report and the narrative number them."""
        return self.workspace.keep(alerts.alert_feed(self.events, self.settings), "alerts")

    @cached_property
    def counters(self) -> DataFrame:
        counted = scoring.combine(
            scoring.line_counters(self.lines, self.scan_pii),
            scoring.step_counters(self.notable_steps, self.settings),
            scoring.severity_breakdown(self.gaps),
            scoring.alibi_failures(self.gaps),
            scoring.forgery_counters(self.forgeries),
            # Names logs without a single line, too.
            *([self.names] if self.names is not None else []),
        )
        return self.workspace.keep(counted, "counters")

    @cached_property
    def scores(self) -> DataFrame:
        return scoring.score(self.counters)

    @cached_property
    def detailed_gaps(self) -> DataFrame:
        return reports.detailed_gaps(self.gaps, self.counters, self.settings)

    @cached_property
    def report(self) -> DataFrame:
        header = reports.report_header(self.scores, self.settings, self.run_at, self.hashes)
        return reports.integrity_report(header, self.detailed_gaps, self.alerts, self.settings)

    @cached_property
    def ledger(self) -> DataFrame:
        return reports.gap_ledger(self.gaps, self.scores, self.settings)

    @cached_property
    def narrative(self) -> DataFrame:
        return narrative.incident_narrative(self.counters, self.alerts, self.settings)

    @cached_property
    def explanation(self) -> DataFrame:
        return narrative.explain(self.scores)

    @cached_property
    def gap_causes(self) -> DataFrame:
        return medians.gap_cause(self.gaps, self.settings)

    @cached_property
    def timeline(self) -> DataFrame:
        extent = self.counters.select("source", "file_start", reports.span_us().alias("span_us"))
        return narrative.gap_timeline(self.gaps, extent, self.settings)

    def write_report(self, path: str) -> None:
        reports.write_report(self.report, path)

    def write_ledger(self, path: str) -> None:
        reports.write_ledger(self.ledger, path)

    def release(self) -> None:
        self.workspace.release()


def analyze(
    spark: SparkSession,
    logs: str | list[str] | DataFrame,
    *,
    audit: bool = False,
    documents: bool | None = False,
    normalizer: normalize.Normalizer | None = None,
    settings: Settings | None = None,
    settings_path: str | None = None,
    scan_pii: bool = False,
    alibi_logs: list[str | DataFrame] | None = None,
    custody: bool = True,
    workspace: Workspace | None = None,
    run_at: datetime | None = None,
    **overrides,
) -> Findings:
    """Analyze text logs, audit records or an event table; each ``source`` is one log.

    ``logs`` is a path, glob or list of them, a table of raw lines (source, line_number, line), or a table of events
    with a ``ts`` column. ``documents`` reads each audit file as one JSON document; None decides for
    each file by its first line. ``alibi_logs`` are secondary logs in the same format (one record a line) or event tables; a path that does not exist is skipped with a warning.
    """
    chosen = settings or (load_settings(settings_path) if settings_path else Settings())
    chosen = chosen.override(**overrides)
    space = workspace or Workspace(spark)
    parse = normalizer or (normalize.normalize_audit if audit else normalize.normalize_text)

    def normalized(data, as_documents: bool | None) -> DataFrame:
        if isinstance(data, DataFrame):
            return data if "ts" in data.columns else parse(data, chosen)
        if as_documents is None:
            whole, by_line = files.by_form(spark, data)
            forms = [normalized(whole, True)] if whole else []
            forms += [normalized(by_line, False)] if by_line or not whole else []
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), forms)
        if as_documents:
            return parse(files.document_records(spark, data, space), chosen)
        return files.read_normalized(spark, data, chosen, space, parse)

    lines = _complete(normalized(logs, documents))
    is_event_table = isinstance(logs, DataFrame) and "ts" in logs.columns
    is_stored = not isinstance(logs, DataFrame) and documents is False and normalizer is None
    if not (is_event_table or is_stored):
        lines = space.keep(lines, "events")
    hashes = names = None
    if custody and not isinstance(logs, DataFrame):
        hashes, names = files.custody_hashes(spark, logs), files.file_names(spark, logs)

    def stamps_of(log) -> DataFrame:
        # Only the time stamps are wanted, so nothing is numbered or stored.
        if isinstance(log, DataFrame):
            parsed = normalized(log, False)
        elif normalizer is None:
            parsed = parse(files.raw_splits(spark, log), chosen)
        else:
            parsed = normalized(log, False)
        return normalize.events(parsed).select("ts")

    secondary = [partial(stamps_of, log) for log in _readable(spark, alibi_logs or [])]
    return Findings(
        lines, chosen, space, scan_pii=scan_pii, secondary=secondary, hashes=hashes, names=names,
        run_at=run_at or datetime.now(),
    )


def _readable(spark: SparkSession, logs: list) -> list:
    wanted = []
    for log in logs:
        if isinstance(log, str) and not files.existing_paths(spark, [log])[0]:
            warnings.warn(f"secondary log skipped, not found: {log}", stacklevel=3)
        else:
            wanted.append(log)
    return wanted


def _complete(lines: DataFrame) -> DataFrame:
    """Give an event table the optional columns it lacks."""
    have = set(lines.columns)
    return lines.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EVENT_COLUMNS])
