import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark import Settings, analyze, analyze_stream, findings_so_far, follow_text, messages
from tidemark.sources import normalize
from tidemark.streaming.incremental import LogStream, StateTable, live_alerts

RAW = "source STRING, seq BIGINT, line STRING"
SETTINGS = Settings(block_lines=90, default_year=2024)


def damaged_log(seed, size=420):
    rng = random.Random(seed)
    clock, rows = datetime(2024, 1, 1), []
    for i in range(size):
        clock += timedelta(seconds=rng.choice([1, 5, 59, 60, 400, 4000, 200_000, -30]))
        source = rng.choice(["busy", "busy", "busy", "calm"])
        body = "A" * 60 if rng.random() < 0.05 else f"user=u{rng.randrange(9)} host=h{rng.randrange(5)} did {rng.random():.12f} root@x.io"
        rows.append((source, 3 * i, "" if rng.random() < 0.05 else f"{clock:%Y-%m-%d %H:%M:%S} {body}"))
    return rows


def audit_trail(seed, size=300):
    rng = random.Random(seed)
    clock, rows = datetime(2024, 1, 1), []
    for i in range(size):
        clock += timedelta(seconds=rng.choice([0, 30, 900, 5000]))
        rows.append(("trail", i, json.dumps({
            "eventTime": f"{clock:%Y-%m-%dT%H:%M:%S}Z", "userIdentity": {"arn": rng.choice(["root", "u1", "u2", ""])},
            "sourceIPAddress": f"10.0.0.{rng.randrange(3)}", "eventName": rng.choice(["List", "CreateAccessKey"]),
        })))
    return rows


def batch_result(spark, rows, audit):
    """The rows in one go, numbered as the stream numbers them."""
    seen, lines = {}, []
    for source, _, line in rows:
        seen[source] = seen.get(source, 0) + 1
        lines.append((source, seen[source], line))
    frame = spark.createDataFrame(lines, "source STRING, line_number BIGINT, line STRING")
    return analyze(spark, frame, audit=audit, settings=SETTINGS, scan_pii=True)


def same(left, right, columns):
    def rows(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect())

    assert rows(left) == rows(right)
    return len(rows(left))


COMPARED = {
    "gaps": ["source", "start_time", "end_time", "severity", "start_line", "end_line"],
    "causality": ["source", "timestamp_before", "timestamp_after", "line_number"],
    "max_gap_violations": ["source", "line_number", "delta_seconds"],
    "forgeries": ["source", "line_number", "entropy", "baseline", "raw_text"],
    "alerts": ["source", "line_number", "kind_rank", "kind", "prev_ip", "message"],
    "rejects": ["source", "line_number", "line"],
    "scores": ["source", "total_lines", "malformed_count", "pii_leaks", "file_start", "file_end", "trust", "status", "reason"],
}


@pytest.mark.parametrize("audit", [False, True])
def test_stream_equals_batch(spark, tmp_path, audit):
    rows = audit_trail(4) if audit else damaged_log(4)
    rng = random.Random(8)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    source = tmp_path / "in"
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        part = rows[a:b]
        rng.shuffle(part)
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(str(source / f"n={n}"))
    stream = spark.readStream.schema(f"{RAW}, n INT").option("maxFilesPerTrigger", 1).parquet(str(source))
    heard = []
    query = analyze_stream(
        messages(stream, "source", "seq", "line"), str(tmp_path / "out"), audit=audit, settings=SETTINGS, scan_pii=True, whole_every=2,
        trigger={"availableNow": True}, on_findings=lambda found, n: heard.append((n, found["alerts"].count())),
    )
    query.awaitTermination()
    assert query.exception() is None
    whole, streamed = batch_result(spark, rows, audit), findings_so_far(spark, str(tmp_path / "out"), SETTINGS)
    counts = {kind: same(getattr(streamed, kind), getattr(whole, kind), columns) for kind, columns in COMPARED.items()}
    expected = ("alerts", "gaps") if audit else ("gaps", "causality", "max_gap_violations", "forgeries", "rejects")
    assert all(counts[kind] > 0 for kind in expected), counts
    assert [n for n, _ in heard] == [0, 1, 2] and sum(c for _, c in heard) == counts["alerts"]
    assert streamed.report.filter("part = 0").count() == counts["scores"]
    assert same(streamed.narrative, whole.narrative, ["source", "part", "narrative"])


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = damaged_log(6, 240)
    log = LogStream(spark, str(tmp_path), SETTINGS, normalize.normalize_text, True, whole_every=2)
    assert findings_so_far(spark, str(tmp_path), SETTINGS).scores.count() == 0
    for batch_id, (a, b) in enumerate([(0, 90), (90, 170), (170, 240)]):
        part = spark.createDataFrame(rows[a:b], RAW)
        log.process(part, batch_id)
        log.process(part, batch_id)
    streamed, whole = findings_so_far(spark, str(tmp_path), SETTINGS), batch_result(spark, rows, False)
    for kind in ("gaps", "forgeries", "scores"):
        same(getattr(streamed, kind), getattr(whole, kind), COMPARED[kind])


def test_state_table(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), "k STRING, v BIGINT", ["k"], whole_every=2)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(table.before(0)) == []
    for batch_id, changes in enumerate([[("a", 1), ("b", 1)], [("b", 2)], [("c", 3)], [("a", 4)]]):
        table.write(batch_id, spark.createDataFrame(changes, "k STRING, v BIGINT"))
    assert rows(table.before(1)) == [("a", 1), ("b", 1)]
    assert rows(table.before(3)) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(table.before(4)) == [("a", 4), ("b", 2), ("c", 3)]
    assert rows(table.before(4, spark.createDataFrame([("b",)], "k STRING"))) == [("b", 2)]


def test_a_repeated_whole_copy_starts_from_the_one_before(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), "k STRING, v BIGINT", ["k"], whole_every=2)
    state = lambda *rows: spark.createDataFrame(list(rows), "k STRING, v BIGINT")
    table.write(0, state(("a", 1)))
    table.write(1, state(("b", 2)))
    table.write(1, state(("b", 7), ("c", 8)))
    assert sorted(map(tuple, table.before(2).collect())) == [("a", 1), ("b", 7), ("c", 8)]


def test_follow_a_folder(spark, tmp_path):
    import os

    folder = tmp_path / "log"
    folder.mkdir()
    old = folder / "0.log"
    old.write_text("2024-01-01 00:00:00 before\n")
    os.utime(old, (1_000_000_000, 1_000_000_000))
    since = datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(hours=1)
    stream = follow_text(spark, str(folder), since=since, files_per_trigger=1)
    for i, text in enumerate(["2024-01-01 01:00:00 a\n\n", "2024-01-01 01:00:10 b\n2024-01-01 01:02:10 c\n"]):
        path = folder / f"{9 - i}.log"
        path.write_text(text)
        os.utime(path, (datetime.now().timestamp() + i, datetime.now().timestamp() + i))
        analyze_stream(stream, str(tmp_path / "out"), trigger={"availableNow": True}).awaitTermination()
    found = findings_so_far(spark, str(tmp_path / "out"))
    assert [(g.start_line, g.end_line) for g in found.gaps.collect()] == [(3, 4)]
    assert [r.line_number for r in found.rejects.collect()] == [2]
    assert found.scores.first().total_lines == 4


def test_stateless_alerts_as_a_plain_stream(spark, tmp_path):
    spark.createDataFrame(audit_trail(1, 50), RAW).write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(RAW).parquet(str(tmp_path / "in")).withColumnRenamed("seq", "line_number")
    feed = live_alerts(normalize.normalize_audit(raw), Settings())
    query = feed.writeStream.format("memory").queryName("alerts_now").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = live_alerts(normalize.normalize_audit(spark.createDataFrame(audit_trail(1, 50), RAW).withColumnRenamed("seq", "line_number")), Settings())
    assert 0 < spark.table("alerts_now").count() == batch.count()
    assert same(spark.table("alerts_now"), batch, ["line_number", "message"])


def table_bucket(keys, table):
    return keys.select(table._bucket()).first()[0]


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), "k STRING, v BIGINT", ["k"], whole_every=3)
    for n in range(5):
        table.write(n, spark.createDataFrame([(f"k{i}", 10 * n + i) for i in range(200)], table.schema))
    wanted = spark.createDataFrame([("k7",)], "k STRING")
    read = table.before(5, wanted)
    assert [tuple(r) for r in read.collect()] == [("k7", 47)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan, plan
    # Of a batch that touches one key, one bucket is read.
    read = [r.p.rsplit("/", 2)[-2] for r in table._read("changes", [3, 4], [table_bucket(wanted, table)]).select(F.col("_metadata.file_path").alias("p")).distinct().collect()]
    assert read == [f"bucket={table_bucket(wanted, table)}"] * 2
    assert table.before(5).count() == 200


def test_state_and_counters_stay_bounded(spark, tmp_path):
    """Batch after batch: no more files than a few batches leave, and the report of all of them."""
    table = StateTable(spark, str(tmp_path / "state"), "k STRING, v BIGINT", ["k"], whole_every=4)
    seen = {}
    for n in range(22):
        rows = [(f"k{(n * 5 + i) % 40}", n) for i in range(3)]
        seen |= dict(rows)
        table.write(n, spark.createDataFrame(rows, table.schema))
        kept = sorted(int(p.name.split('=')[1]) for kind in ("changes", "whole") for p in (tmp_path / "state" / kind).glob("*"))
        assert len(kept) <= 3 * 4 + 2 and kept[0] >= n - 12
    assert {r.k: r.v for r in table.before(22).collect()} == seen
    # A batch may be run again although older parts are gone.
    table.write(21, spark.createDataFrame(rows, table.schema))
    assert {r.k: r.v for r in table.before(22).collect()} == seen


def test_folded_counters_report_all_batches(spark, tmp_path):
    rows = damaged_log(12, 260)
    log = LogStream(spark, str(tmp_path), SETTINGS, normalize.normalize_text, True, whole_every=2)
    for n in range(7):
        log.process(spark.createDataFrame(rows[n * 40:(n + 1) * 40], RAW), n)
    # The last batch is run again.
    log.process(spark.createDataFrame(rows[240:], RAW), 6)
    assert len(list((tmp_path / "counters").glob("batch_id=*"))) == 3 and len(list((tmp_path / "counters_whole").glob("*"))) == 2
    whole, streamed = batch_result(spark, rows, False), findings_so_far(spark, str(tmp_path), SETTINGS)
    same(streamed.scores, whole.scores, COMPARED["scores"])
