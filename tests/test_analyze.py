import hashlib
import json
import random
from datetime import datetime, timedelta
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tidemark import Settings, Workspace, analyze
from tidemark.operators import blocks
from tidemark.sources import files, normalize


def write(path, lines):
    path.write_text("".join(line + "\n" for line in lines))
    return str(path)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    expected = {}
    for name in ("a.log", "b.log", "empty.log"):
        lines = [] if name == "empty.log" else [("x" * rng.randrange(60)) + str(i) if i % 7 else "" for i in range(3000)]
        breaks = [rng.choice(["\n", "\n", "\r\n"]) for _ in lines]
        (tmp_path / name).write_bytes("".join(a + b for a, b in zip(lines, breaks)).encode())
        expected[name] = lines
    raw = files.raw_splits(spark, str(tmp_path))
    assert raw.select("source", "split_start").distinct().count() > 10
    rows = files.read_text_lines(spark, str(tmp_path), Workspace(spark)).collect()
    for name, lines in expected.items():
        mine = sorted((r.line_number, r.line) for r in rows if r.source.endswith(name))
        assert mine == list(enumerate(lines, 1))


def test_line_ends_and_bad_bytes(spark, tmp_path):
    (tmp_path / "odd.log").write_bytes(b"one\rtwo\r\nthree\xff\n\nfive")
    rows = files.read_text_lines(spark, str(tmp_path / "odd.log"), Workspace(spark)).orderBy("line_number").collect()
    assert [r.line for r in rows] == ["one", "two", "three�", "", "five"]


def test_custody(spark, tmp_path):
    contents = {"small.bin": b"abc", "empty file.bin": b"", "a b%20c.bin": b"d", "large file.bin": b"0123456789" * 5000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    rows = files.custody_hashes(spark, str(tmp_path), whole_file_bytes=1000).collect()
    assert len(rows) == len(contents)
    assert {unquote(r.source).rsplit("/", 1)[1]: r.sha256 for r in rows} == {
        name: hashlib.sha256(content).hexdigest() for name, content in contents.items()
    }


def test_names_need_no_hash(spark, tmp_path, monkeypatch):
    """Counting does not hash; a secondary log is not looked at while there are no gaps."""
    (tmp_path / "a.log").write_text("2024-10-15 10:00:00 a\n2024-10-15 10:00:10 b\n")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "other").write_text("2024-10-15 10:00:05 c\n")
    space = Workspace(spark, str(tmp_path / "space"))
    found = analyze(spark, str(tmp_path / "*.log"), alibi_logs=[str(tmp_path / "other")], workspace=space)
    found.hashes = None
    found.secondary = [lambda: 1 / 0]
    assert {(r.source.rsplit("/", 1)[1], r.total_lines) for r in found.counters.collect()} == {("a.log", 2), ("empty.log", 0)}
    found.release()


def test_both_forms_of_audit_files(spark, tmp_path):
    """A file of one record a line and a printed document, read in one run, each as what it is."""
    records = [{"eventTime": f"2024-10-14T10:0{i}:00Z", "eventName": "x"} for i in range(5)]
    (tmp_path / "by line.json").write_text("\n".join(json.dumps(r) for r in records))
    (tmp_path / "printed.json").write_text(json.dumps({"Records": records}, indent=2))
    space = Workspace(spark, str(tmp_path / "space"))
    found = analyze(spark, str(tmp_path / "*.json"), audit=True, documents=None, workspace=space)
    assert {(unquote(r.source).rsplit("/", 1)[1], r.total_lines, r.malformed_count) for r in found.counters.collect()} == {
        ("by line.json", 5, 0), ("printed.json", 5, 0)
    }
    found.release()


def test_positions_of_any_size(spark):
    facts = [("a", p) for p in (-1_000_000, -30, 0, 5, 1_700_000_000_000_000)] + [("b", 7)]
    facts = spark.createDataFrame(facts, "source STRING, at BIGINT")
    values = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source STRING, v INT")
    joined = blocks.attach(facts, "at", values, "source", 10).collect()
    assert sorted((r.source, r["at"], r.v) for r in joined) == sorted((s, p, 1 if s == "a" else 2) for s, p in map(tuple, facts.collect()))


RECORDS = [{"eventTime": f"2024-10-14T10:0{i}:00Z", "eventName": "é", "n": [1, 2]} for i in range(3)]
DOCUMENTS = {
    "pretty": json.dumps({"Records": RECORDS}, indent=2, ensure_ascii=False),
    "oneline": json.dumps({"Records": RECORDS}),
    "single": json.dumps(RECORDS[0], indent=1),
    "list": json.dumps(RECORDS, indent=1),
    "norecords": '{"Records": [],\n "eventTime": "2024-10-14T10:00:00Z"}',
    "broken": '{\n "Records": [\n {"eventTime": "2024-10-14T10:00:00Z"}\n',
    "tail": json.dumps({"Records": RECORDS}, indent=1) + " x",
}


def test_documents(spark):
    frame = spark.createDataFrame(list(DOCUMENTS.items()), "source STRING, document STRING")
    lines = files.unpack_records(frame)
    counts = {r.source: (r.events, r.rejects) for r in normalize.normalize_audit(lines).groupBy("source").agg(
        F.count("ts").alias("events"), F.count_if(F.col("ts").isNull()).alias("rejects")).collect()}
    assert counts == {
        "pretty": (3, 0), "oneline": (3, 0), "single": (1, 0), "list": (3, 0), "norecords": (1, 0), "broken": (0, 1), "tail": (0, 1)
    }
    strict = files.unpack_records(frame, strict=True).orderBy("source", "line_number").collect()
    assert [r.line for r in strict if r.source == "pretty"] == [json.dumps(r) for r in RECORDS]
    assert {r.source for r in strict} == {"pretty", "oneline", "single", "norecords"}


def test_document_or_lines(spark):
    texts = {'{\n"a":1}': True, '{"a":\n1}': True, '{"a":1}\n{"b":2}': False, "[\n1]": False, " {  \r\n}": True}
    frame = spark.createDataFrame([(t,) for t in texts], "d STRING")
    assert {r.d: r.m for r in frame.select("d", files.is_multi_line(F.col("d")).alias("m")).collect()} == texts


def test_three_lines_one_gap(spark, tmp_path):
    path = write(tmp_path / "a.log", ["2024-10-15 08:00:00 Event 1", "2024-10-15 08:00:10 Event 2", "2024-10-15 08:02:00 Event 3"])
    found = analyze(spark, path, timestamp_formats=["%Y-%m-%d %H:%M:%S"], min_gap_threshold=60)
    gap, = found.gaps.collect()
    assert (gap.duration_seconds, gap.start_line, gap.end_line) == (110.0, 2, 3)
    assert found.counters.first().total_lines == 3


def test_threshold_override(spark, tmp_path):
    path = write(tmp_path / "a.log", ["2024-10-14 10:00:00 Started", "2024-10-14 10:02:00 Event"])
    found = analyze(spark, path, min_gap_threshold=300)
    assert found.counters.first().total_lines == 2 and found.gaps.count() == 0
    assert analyze(spark, path).gaps.count() == 1


def test_logs_without_events(spark, tmp_path):
    write(tmp_path / "rejects.log", ["", "no stamp"])
    write(tmp_path / "empty.log", [])
    found = analyze(spark, str(tmp_path))
    empty, row = found.scores.orderBy("source").collect()
    assert (row.total_lines, row.malformed_count, row.file_start, row.trust) == (2, 2, None, 99)
    assert (empty.total_lines, empty.trust, empty.status) == (0, 100, "NORMAL")
    assert found.report.count() == 2 and found.ledger.count() == 0 and found.timeline.count() == 0


AUDIT = [
    ("10:00:00", "root", "192.168.1.1", "ConsoleLogin"),
    ("10:00:10", "root", "192.168.1.1", "CreateAccessKey"),
    ("10:00:15", "root", "203.0.113.5", "Describe"),
    ("10:20:00", "root", "203.0.113.5", "StopLogging"),
]


def audit_lines():
    return [
        json.dumps({"eventTime": f"2024-10-14T{at}Z", "userIdentity": {"arn": f"arn:aws:iam::1:{who}"}, "sourceIPAddress": ip, "eventName": name})
        for at, who, ip, name in AUDIT
    ]


def test_audit_report_end_to_end(spark, tmp_path):
    path = write(tmp_path / "trail.json", audit_lines())
    other = write(tmp_path / "flow.json", [json.dumps({"eventTime": "2024-10-14T10:05:00Z"}), json.dumps({"eventTime": "2024-10-14T10:20:00Z"})])
    run_at = datetime(2024, 10, 15)
    with pytest.warns(UserWarning, match="absent"):
        found = analyze(spark, path, audit=True, scan_pii=True, alibi_logs=[other, other, str(tmp_path / "absent.json")], run_at=run_at)
    found.write_report(str(tmp_path / "report"))
    found.write_ledger(str(tmp_path / "ledger"))
    report, = [json.loads(line) for part in (tmp_path / "report").glob("part-*") for line in part.read_text().splitlines()]
    assert report["metadata"] == {
        "analysis_timestamp": "2024-10-15T00:00:00", "source_file": report["source"],
        "chain_of_custody_sha256": hashlib.sha256(open(path, "rb").read()).hexdigest(), "file_start": "2024-10-14T10:00:00",
        "file_end": "2024-10-14T10:20:00", "total_lines_processed": 4, "threshold_seconds": 60, "total_timespan_seconds": 1200,
    }
    assert report["trust_metrics"] == {
        "system_status": "COMPROMISED", "log_trust_confidence_percent": 45,
        "suspicion_reason": "CRITICAL: 1 Alibi Failures detected (Proven tampering)",
        "trust_deduction_breakdown": ["MEDIUM gaps (1x): -5", "Alibi failures: -50"],
    }
    assert report["detailed_gaps"] == [{
        "start_time": "2024-10-14T10:00:15", "end_time": "2024-10-14T10:20:00", "duration_seconds": 1185, "duration_human": "19m 45s",
        "severity": "MEDIUM", "start_line": 3, "end_line": 4, "position_percent": 1.2, "width_percent": 98.8, "alibi_events_caught": 2,
    }]
    messages = report["anomalies"]["cloud_alerts"]
    assert [m.split(":")[0] for m in messages] == [
        "⚠️ ROOT ABUSE WARNING", "⚠️ IAM ESCALATION WARNING", "⚠️ ROOT ABUSE WARNING", "🚨 IMPOSSIBLE TRAVEL WARNING", "⚠️ ROOT ABUSE WARNING"
    ]
    assert messages[3].endswith("jumped from 192.168.1.1 to 203.0.113.5 in 0.00 hours!")
    assert report["anomalies"]["pii_leakage_events"] == 4
    told, = found.narrative.collect()
    assert told.narrative.startswith("Detected 1 abnormal audit silence(s)") and told.narrative.count("Root account usage") == 3
    ledger = [line for part in (tmp_path / "ledger").glob("part-*") for line in part.read_text().splitlines()]
    assert ledger[0].split(",")[1:] == [
        "start_time", "end_time", "duration_seconds", "severity", "alibi_events_caught", "total_causality_violations",
        "shannon_entropy_collapses", "system_trust_confidence", "system_status",
    ]
    assert ledger[1].split(",")[1:] == ["2024-10-14T10:00:15", "2024-10-14T10:20:00", "1185", "MEDIUM", "2", "0", "0", "45%", "COMPROMISED"]
    assert found.gap_causes.first().cause == "static"
    found.release()
    assert not (tmp_path / found.workspace.folder).exists()


def test_report_in_parts(spark):
    rows = [("a", i, datetime(2024, 1, 1) + timedelta(minutes=2 * i)) for i in range(1, 27)]
    log = spark.createDataFrame(rows, "source STRING, line_number BIGINT, ts TIMESTAMP_NTZ")
    found = analyze(spark, log.withColumn("raw_payload", F.lit("")), settings=Settings(part_rows=10, block_lines=4))
    parts = found.report.orderBy("part").collect()
    assert [len(p.detailed_gaps) for p in parts] == [10, 10, 5]
    assert parts[0].metadata is not None and parts[1].metadata is None
    assert [g.start_line for p in parts for g in p.detailed_gaps] == list(range(1, 26))


def test_documents_through_analyze(spark, tmp_path):
    (tmp_path / "doc.json").write_text(DOCUMENTS["pretty"])
    found = analyze(spark, str(tmp_path / "doc.json"), audit=True, documents=True)
    assert [(g.start_line, g.end_line) for g in found.gaps.orderBy("end_line").collect()] == [(1, 2), (2, 3)]
