import random
import statistics
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from tidemark import BusinessHours, Settings, Workspace
from tidemark.operators import alerts, alibi, baseline, blocks, medians, narrative, scoring, sequence, timeline

T0 = datetime(2024, 1, 1)
EVENTS = "source STRING, line_number BIGINT, ts TIMESTAMP_NTZ"
FULL = EVENTS + ", raw_payload STRING, actor STRING, source_ip STRING, region STRING, event_name STRING, event_source STRING"


def events(spark, rows, schema=EVENTS):
    return spark.createDataFrame(rows, schema)


def random_log(seed, sources=4, size=400):
    """Skewed sources, holes in the numbering, equal and backward stamps."""
    rng = random.Random(seed)
    rows, clock, line = [], defaultdict(lambda: T0), defaultdict(int)
    for _ in range(size):
        source = f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        line[source] += rng.choice([1, 1, 1, 2, 30])
        clock[source] += timedelta(microseconds=rng.choice([0, 10**6, 61 * 10**6, 301 * 10**6, 4000 * 10**6, 200000 * 10**6, -10**7]))
        rows.append((source, line[source], clock[source]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_previous_values_equal_a_plain_window(spark, width):
    frame = events(spark, random_log(width))
    window = Window.partitionBy("source").orderBy("line_number")
    plain = frame.select("*", F.lag("line_number").over(window).alias("p"), F.lag("ts").over(window).alias("t"))
    mine = blocks.previous_values(frame, ["source"], "line_number", ["ts"], width)
    assert sorted(map(tuple, mine.select("source", "line_number", "ts", "prev_line_number", "prev_ts").collect()), key=str) == sorted(
        map(tuple, plain.collect()), key=str
    )


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_running_and_numbered_equal_plain_windows(spark, width):
    frame = events(spark, random_log(width + 1)).withColumn("v", F.pmod(F.hash("ts"), F.lit(50)))
    window = Window.partitionBy("source").orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = frame.select("source", "line_number", F.sum("v").over(window), F.max("v").over(window), F.count("*").over(window))
    blocked = blocks.with_block(frame, "line_number", width)
    order = [F.col("line_number")]
    summed = blocks.running(blocked, ["source"], order, F.col("v"), "total")
    both = blocks.running(summed, ["source"], order, F.col("v"), "top", "max").drop("_blk")
    mine = blocks.numbered(both, ["source"], ["line_number"], width, "n").select("source", "line_number", "total", "top", "n")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, plain.collect()))


def test_gap_limits(spark):
    base = 60 * 10**6
    top = 172800 * 10**6
    deltas = [base - 1, base, base + 1, 300 * 10**6, 300 * 10**6 + 1, 3600 * 10**6, 3600 * 10**6 + 1, top - 1, top, top + 1, 0, -1]
    rows, clock = [("a", 1, T0)], T0
    for i, delta in enumerate(deltas, 2):
        clock += timedelta(microseconds=delta)
        rows.append(("a", i, clock))
    settings = Settings(block_lines=4)
    steps = sequence.steps(events(spark, rows), settings)
    gaps = {r.end_line: r.severity for r in sequence.gaps(steps, settings).collect()}
    assert gaps == {3: "LOW", 4: "LOW", 5: "LOW", 6: "MEDIUM", 7: "MEDIUM", 8: "HIGH", 9: "HIGH", 10: "HIGH"}
    assert [r.line_number for r in sequence.max_gap_violations(steps, settings).collect()] == [11]
    assert [r.line_number for r in sequence.causality_violations(steps).collect()] == [13]


def test_backward_step_becomes_the_new_reference(spark):
    rows = [("a", 1, T0), ("a", 2, T0 - timedelta(hours=1)), ("a", 3, T0 - timedelta(minutes=50))]
    gaps = sequence.gaps(sequence.steps(events(spark, rows), Settings()), Settings()).collect()
    assert [(g.start_line, g.duration_seconds) for g in gaps] == [(2, 600.0)]


def test_business_hours_lower_the_ledger_but_not_the_count(spark):
    settings = Settings(business_hours=BusinessHours("09:00", "17:00", False))
    gaps = sequence.gaps(sequence.steps(events(spark, [("a", 1, T0), ("a", 2, T0 + timedelta(hours=2))]), settings), settings)
    assert gaps.first().severity == "LOW"
    counted = scoring.severity_breakdown(gaps).first()
    assert (counted.low_count, counted.high_count) == (0, 1)


def test_extent_follows_lines(spark):
    rows = [("a", 1, T0), ("a", 2, T0 + timedelta(days=1)), ("a", 3, T0 - timedelta(days=1)), ("b", 7, T0)]
    extent = {r.source: r for r in sequence.log_extent(events(spark, rows)).collect()}
    assert extent["a"].file_end == T0 - timedelta(days=1) and extent["a"].span_us == -86400 * 10**6
    assert extent["b"].span_us == 0


def gap_rows(rng, count):
    rows = []
    for i in range(count):
        start = T0 + timedelta(seconds=rng.randrange(50_000))
        end = start + timedelta(seconds=rng.choice([0, 1, 60, 500, 9000]))
        rows.append((f"s{rng.randrange(3)}", start, end, (end - start) // timedelta(microseconds=1), float((end - start).seconds), "LOW", i, i + 1))
    return rows


GAPS = (
    "source STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, duration_us BIGINT, duration_seconds DOUBLE, severity STRING, "
    "start_line BIGINT, end_line BIGINT"
)


@pytest.mark.parametrize("block_lines", [7, 60, 100_000])
def test_alibi_counts_equal_brute_force(spark, block_lines):
    rng = random.Random(block_lines)
    rows = gap_rows(rng, 120)
    # Many events share one instant, and some stand exactly on the ends of gaps.
    stamps = [T0 + timedelta(seconds=rng.randrange(60_000)) for _ in range(500)] + [rows[0][1]] * 40 + [r[2] for r in rows[:30]]
    gaps = spark.createDataFrame(rows, GAPS)
    secondary = spark.createDataFrame([(s,) for s in stamps], "ts TIMESTAMP_NTZ")
    counted = alibi.cross_check(gaps, [secondary], Settings(block_lines=block_lines)).collect()
    assert len(counted) == len(rows)
    for row in counted:
        assert row.alibi_evidence_count == sum(row.start_time < s < row.end_time for s in stamps)
    twice = alibi.cross_check(gaps, [secondary, secondary], Settings(block_lines=block_lines))
    assert twice.agg(F.sum("alibi_evidence_count")).first()[0] == 2 * sum(r.alibi_evidence_count for r in counted)
    assert alibi.cross_check(gaps, [], Settings()).agg(F.sum("alibi_evidence_count")).first()[0] == 0


def test_alibi_within_a_shared_key(spark):
    rng = random.Random(9)
    rows = gap_rows(rng, 60)
    other = [(f"s{rng.randrange(4)}", T0 + timedelta(seconds=rng.randrange(60_000))) for _ in range(400)]
    counted = alibi.count_inside(
        spark.createDataFrame(rows, GAPS), spark.createDataFrame(other, "source STRING, ts TIMESTAMP_NTZ"), Settings(), ["source"]
    )
    for row in counted.collect():
        assert row.alibi_evidence_count == sum(s == row.source and row.start_time < ts < row.end_time for s, ts in other)


@pytest.mark.parametrize("block_lines", [7, 3600])
def test_safe_spans_equal_brute_force(spark, block_lines):
    rng = random.Random(3)
    rows = gap_rows(rng, 150)
    spans = [(s := T0 + timedelta(seconds=rng.randrange(50_000)), s + timedelta(seconds=rng.randrange(2_000))) for _ in range(40)]
    spans += [(rows[0][1], rows[0][2])]
    left = sequence.without_safe_spans(
        spark.createDataFrame(rows, GAPS), spark.createDataFrame(spans, "safe_start TIMESTAMP_NTZ, safe_end TIMESTAMP_NTZ"),
        Settings(block_lines=block_lines),
    )
    wanted = [r for r in rows if not any(a <= r[1] and r[2] <= b for a, b in spans)]
    assert 0 < len(wanted) < len(rows)
    assert sorted(map(tuple, left.collect())) == sorted(wanted)


def test_blocks_follow_the_rows_and_not_the_clock(spark):
    """A crowded minute and ten sparse years on one line: no block beyond its size, and the order kept."""
    crowded, sparse = F.lit(1_700_000_000_000_000) + F.col("id") * 600, F.col("id") * 3_155_000_000
    line = spark.range(100_000).select(crowded.alias("_at")).unionByName(spark.range(100_000).select(sparse.alias("_at"))).distinct()
    settings = Settings(block_lines=5_000)
    cut = timeline.placed(line.withColumn("_turn", F.lit(1)), [], ["_at", "_turn"], settings, Workspace(spark))
    sizes = cut.groupBy("_blk").agg(F.count("*").alias("n"), F.min("_at").alias("low"), F.max("_at").alias("high")).orderBy("_blk").collect()
    assert len(sizes) > 40 and max(r.n for r in sizes) <= 5_000
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))
    totals = timeline.running(
        line.withColumns({"_turn": F.lit(1), "one": F.lit(1).cast("bigint")}), [], ["_at", "_turn"], "one", "upto", "sum", settings, Workspace(spark)
    )
    assert totals.agg(F.max("upto"), F.count_distinct("upto")).first() == (line.count(), line.count())


def test_gaps_that_end_together_are_dealt_out(spark):
    """A fleet that resumes at one instant: its gaps read their totals in many tasks, the others in as many as there are."""
    gaps = spark.range(40_000).select(
        F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(7).cast("bigint").alias("at"), F.col("id").alias("end_line")
    ).unionByName(spark.createDataFrame([("x", None, 1), ("y", 8, 2), ("z", 9, 3)], "source STRING, at BIGINT, end_line BIGINT"))
    values = spark.createDataFrame([(7, 70), (None, 0), (8, 80)], "key BIGINT, value BIGINT")
    read = timeline.read_off(gaps, {"at": "key"}, values, ["source", "end_line"])
    assert read.columns == ["source", "at", "end_line", "value"]
    counts = {(r.at, r.value): r["count"] for r in read.groupBy("at", "value").count().collect()}
    assert counts == {(7, 70): 40_000, (None, 0): 1, (8, 80): 1}
    salts = gaps.groupBy("at", F.pmod(F.xxhash64("source", "end_line"), F.lit(timeline.SALTS))).count().agg(F.max("count")).first()[0]
    assert salts < 300


@pytest.mark.parametrize("seed", range(3))
def test_medians_equal_statistics(spark, seed):
    rng = random.Random(seed)
    rows = []
    for source, count in (("one", 1), ("two", 2), ("same", 40), ("many", 301)):
        for i in range(count):
            micros = 77 if source == "same" else rng.choice([60 * 10**6, 61 * 10**6 + 1, rng.randrange(1, 172800 * 10**6)])
            rows.append((source, T0, T0, micros, micros / 1e6, "LOW", i, i + 1))
    spread = {r.source: r for r in medians.gap_spread(spark.createDataFrame(rows, GAPS), Settings(block_lines=50)).collect()}
    assert len(spread) == 4
    for source, row in spread.items():
        values = [r[4] for r in rows if r[0] == source]
        middle = statistics.median(values)
        assert row.n_gaps == len(values)
        assert row.median_seconds == pytest.approx(middle, abs=1e-9)
        assert row.mad_seconds == pytest.approx(statistics.median([abs(v - middle) for v in values]), abs=1e-7)


def test_medians_of_gaps_that_are_all_alike(spark):
    """Gaps within one second of each other: every step of the search sees no more counts than its bits tell apart."""
    gaps = spark.range(300_000).select(
        F.lit("log").alias("source"), F.col("id").alias("end_line"), (60_000_000 + (F.col("id") * 7919) % 1_000_000).alias("duration_us")
    ).withColumn("duration_seconds", F.col("duration_us") / 1e6)
    row = medians.gap_spread(gaps, Settings()).first()
    values = [60_000_000 + k * 7919 % 1_000_000 for k in range(300_000)]
    middle = statistics.median(values)
    assert row.median_seconds == pytest.approx(middle / 1e6, abs=1e-9)
    assert row.mad_seconds == pytest.approx(statistics.median([abs(v - middle) for v in values]) / 1e6, abs=1e-9)
    found = medians.middle_values(gaps, "duration_us", 172_800_000_000).first()
    assert (found.n_gaps, found.lower, found.upper) == (300_000, *sorted(values)[149_999:150_001])
    assert medians.middle_values(gaps.limit(0), "duration_us", 100).collect() == []


def fold(rows):
    """The definition, one event after another."""
    r, n, found = 0.0, 0, []
    for line, e, chars in rows:
        forged = n > 50 and chars > 20 and (e < r * 0.75 or e < 3.0)
        if forged:
            found.append((line, round(r, 9)))
        else:
            r = (r * n + e) / (n + 1)
        n += 1
    return found, n, r


def measured_rows(seed, sources=3):
    """Payload entropies near the cut, so that decisions hang on each other."""
    rng = random.Random(seed)
    rows = []
    for s in range(sources):
        level = rng.uniform(4.0, 6.0)
        for line in range(1, rng.randrange(60, 900)):
            near = rng.random() < rng.choice([0.05, 0.5])
            e = level * rng.uniform(0.7, 0.8) if near else rng.uniform(2.8, 6.5)
            rows.append((f"s{s}", line * rng.choice([1, 1, 1]), e, rng.choice([20, 21, 80])))
    return rows


@pytest.mark.parametrize("seed, width", [(1, 10), (2, 97), (3, 300), (4, 40), (5, 1000)])
def test_baseline_in_blocks_equals_the_fold(spark, monkeypatch, seed, width):
    rows = measured_rows(seed)
    frame = spark.createDataFrame(rows, "source STRING, line_number BIGINT, entropy DOUBLE, chars INT").withColumns(
        {"ts": F.lit("2024-01-01 00:00:00"), "raw_text": F.lit("x")}
    )
    monkeypatch.setattr(baseline, "measured", lambda df: df)
    found, state = baseline.collapse_and_state(frame, Settings(block_lines=width), Workspace(spark))
    mine, ends = defaultdict(list), {r.source: (r.n, r.r) for r in state.collect()}
    for row in found.orderBy("source", "line_number").collect():
        mine[row.source].append((row.line_number, row.baseline))
    total = 0
    for source in {r[0] for r in rows}:
        expected, n, r = fold([row[1:] for row in rows if row[0] == source])
        total += len(expected)
        assert [line for line, _ in mine[source]] == [line for line, _ in expected]
        assert [level for _, level in mine[source]] == pytest.approx([level for _, level in expected], abs=1e-8)
        assert ends[source] == (n, pytest.approx(r, abs=1e-9))
    assert total > 50


def test_first_event_that_can_be_forged_is_the_52nd(spark):
    payload = "2024-01-01 00:00:00 " + "A" * 40
    rows = [("a", i, T0, payload, None, None, None, None, None) for i in range(1, 54)]
    rows.append(("a", 54, T0, "2024-01-01 00:00:00 " + "A" * 20, None, None, None, None, None))
    found = baseline.entropy_collapse(events(spark, rows, FULL), Settings(), Workspace(spark)).collect()
    assert sorted(r.line_number for r in found) == [52, 53]
    assert found[0].entropy == 0.0 and found[0].raw_text == payload[:60]


def audit(line, ts, actor="u", ip="1.1.1.1", name="List"):
    return ("t", line, ts, "{}", actor, ip, None, name, None)


def test_impossible_travel_limits(spark):
    hour = timedelta(hours=1)
    micro = timedelta(microseconds=1)
    rows = [
        audit(1, T0), audit(2, T0, ip="2.2.2.2"),  # no time between: not flagged
        audit(3, T0 + hour - micro, ip="3.3.3.3"),  # flagged
        audit(4, T0 + 2 * hour - micro, ip="4.4.4.4"),  # exactly one hour: not flagged
        audit(5, T0 + 2 * hour, ip="4.4.4.4"),  # same address
        audit(6, T0 + 2 * hour + micro, actor="", ip="5.5.5.5"), audit(7, T0 + 2 * hour + micro, actor=None, ip="5.5.5.5"),
        audit(8, T0 + 2 * hour + micro, ip=""), audit(9, T0 + 2 * hour + micro, ip=None),
        audit(10, T0 + 2 * hour + timedelta(minutes=9), ip="6.6.6.6"),  # flagged against line 5
        audit(11, T0 + hour, ip="7.7.7.7"),  # back in time: not flagged, but moves the state
        audit(12, T0 + hour + timedelta(minutes=9), ip="6.6.6.6"),  # flagged
    ]
    for width in (2, 1000):
        found = alerts.impossible_travel(events(spark, rows, FULL), Settings(block_lines=width)).orderBy("line_number").collect()
        assert [(r.line_number, r.prev_ip) for r in found] == [(3, "2.2.2.2"), (10, "4.4.4.4"), (12, "7.7.7.7")]
    assert found[2].message == "🚨 IMPOSSIBLE TRAVEL WARNING: u jumped from 7.7.7.7 to 6.6.6.6 in 0.15 hours!"


def test_rules_and_texts(spark):
    rows = [
        audit(1, T0, actor="arn:ROOT", name="CreateAccessKey"),
        audit(2, T0 + timedelta(microseconds=5), actor="chroot-user", name=None),
        audit(3, T0, actor=None, name="PutUserPolicy"),
        audit(4, T0, actor=None, name=None),
    ]
    found = alerts.rule_alerts(events(spark, rows, FULL), Settings()).orderBy("line_number").collect()
    assert [r.message for r in found] == [
        "⚠️ IAM ESCALATION WARNING: arn:ROOT performed CreateAccessKey at 2024-01-01 00:00:00",
        "⚠️ ROOT ABUSE WARNING: AWS Root account activity detected at 2024-01-01 00:00:00.000005 (None)",
        "⚠️ IAM ESCALATION WARNING: None performed PutUserPolicy at 2024-01-01 00:00:00",
    ]
    mapped = {r.line_number: r.technique for r in alerts.with_technique(alerts.rule_alerts(events(spark, rows, FULL), Settings())).collect()}
    assert mapped == {1: "T1098 (Account Manipulation)", 2: "T1078.001 (Default Accounts)", 3: "T1098 (Account Manipulation)"}


def scored(spark, **counts):
    frame = spark.createDataFrame([("a",)], "source STRING").select(
        "source", *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()]
    )
    return scoring.score(scoring.combine(frame)).first()


def test_scores(spark):
    empty = scored(spark, total_lines=0)
    assert (empty.trust, empty.status, empty.reason) == (100, "NORMAL", "Log file implies normal contiguous structure")
    clean = scored(spark, total_lines=10)
    assert (clean.trust, clean.status, clean.reason, clean.deductions) == (100, "NORMAL", "Perfect contiguous structural integrity", [])
    minor = scored(spark, total_lines=1000, low_count=1, medium_count=1, malformed_count=7)
    assert (minor.trust, minor.status, minor.reason) == (92, "NORMAL", "Minor temporal inconsistencies degrading reliability")
    assert minor.deductions == ["LOW gaps (1x): -2", "MEDIUM gaps (1x): -5", "Malformed lines (7x): -0.7"]
    assert minor.suspicion_density == pytest.approx(0.003)
    assert scored(spark, total_lines=100, high_count=1).status == "NORMAL"
    assert scored(spark, total_lines=100, high_count=1, low_count=1).status == "SUSPICIOUS"
    assert (scored(spark, total_lines=100, medium_count=10).status, scored(spark, total_lines=100, medium_count=11).status) == ("SUSPICIOUS", "COMPROMISED")
    proven = scored(spark, total_lines=100, high_count=1, alibi_failures=3, malformed_count=2, causality_count=1, forgery_count=2, max_gap_violations=4)
    assert (proven.trust, proven.status) == (0, "COMPROMISED")
    assert proven.reason == (
        "CRITICAL: 3 Alibi Failures detected (Proven tampering) | CAUSALITY VIOLATION: 1 reverse-time jumps detected | "
        "SYNTHETIC FORGERY: 2 instances of Shannon Entropy collapse | Major timeline disruptions (HIGH gaps) | "
        "4 instances of catastrophic timestamp inconsistency | Unusually high volume of malformed/corrupted lines"
    )
    assert scored(spark, total_lines=100, malformed_count=1).reason.startswith("Minor")


def test_timeline(spark):
    minute = timedelta(minutes=1)
    rows = [("a", 1, T0), ("a", 2, T0 + 2 * minute), ("a", 3, T0 + 30 * minute), ("a", 4, T0 + 60 * minute), ("b", 1, T0), ("c", 1, T0), ("c", 2, T0 - minute)]
    log = events(spark, rows)
    gaps = sequence.gaps(sequence.steps(log, Settings()), Settings())
    lines = {r.source: r.timeline for r in narrative.gap_timeline(gaps, sequence.log_extent(log), Settings()).collect()}
    expected = ["."] * 60
    expected[0], expected[2], expected[30] = "!", "x", "x"
    assert lines == {"a": "".join(expected)}


def test_narrative_parts_join_to_the_whole(spark):
    rows = [audit(i, T0 + timedelta(seconds=i), actor="root") for i in range(1, 26)] + [("quiet", 1, T0) + ("{}",) + (None,) * 5]
    log = events(spark, rows, FULL)
    counters = scoring.combine(scoring.line_counters(log))
    settings = Settings(part_rows=10, block_lines=4)
    told = narrative.incident_narrative(counters, alerts.alert_feed(log, settings), settings).orderBy("source", "part").collect()
    assert [(r.source, r.part) for r in told] == [("quiet", 0), ("t", 0), ("t", 1), ("t", 2)]
    whole = narrative.incident_narrative(counters, alerts.alert_feed(log, Settings()), Settings()).filter("source = 't'").collect()
    assert len(whole) == 1 and " ".join(r.narrative for r in told[1:]) == whole[0].narrative
    assert told[0].narrative == narrative.QUIET_SENTENCE
