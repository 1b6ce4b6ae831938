import math
import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import rounding, text, time as t
from tidemark.settings import BusinessHours


def entropy(value):
    if not value:
        return 0.0
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def test_entropy(spark):
    rng = random.Random(5)
    alphabets = ["ab", "abcdefghij 0123456789", "äöüß€", "😀😁a", "x"]
    values = ["", "a", "😀", "😀a" * 10] + [
        "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(200))) for _ in range(400)
    ]
    values.append("xyz" * 700_000)
    values.append("ö" + "xyz" * 500_000)
    frame = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING").repartition(3)
    for row in frame.select("i", text.entropy(F.col("v")).alias("e")).collect():
        assert math.isclose(row.e, entropy(values[row.i]), abs_tol=1e-9)


def test_entropy_of_null(spark):
    frame = spark.createDataFrame([(1, None), (2, "ab")], "i INT, v STRING").coalesce(1)
    assert [r.e for r in frame.orderBy("i").select(text.entropy(F.col("v")).alias("e")).collect()] == [None, 1.0]


def test_payload_is_cut_by_characters(spark):
    frame = spark.createDataFrame([("é" * 20 + "😀rest",), ("short",), ("x" * 20,)], "v STRING")
    assert [r[0] for r in frame.select(text.payload_body(F.col("v"))).collect()] == ["😀rest", "", ""]


def test_pii_rules(spark):
    cases = {
        "mail me a.b+c@ex-ample.org now": (1, 0, 0),
        "at @ nothing": (0, 0, 0),
        "from 999.1.22.333:80": (0, 1, 0),
        "version 1.2.3": (0, 0, 0),
        "x1.2.3.4": (0, 0, 0),
        "API_KEY = 'abcdefghijklmnop'": (0, 0, 1),
        "Token:abcdefghijklmno": (0, 0, 0),
        "secret\": \"ABCDEFGH-12345678\" to root@host.net from 10.0.0.1": (1, 1, 1),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v STRING")
    for row in frame.select("v", *[h.cast("int").alias(n) for n, h in text.pii_hits(F.col("v")).items()]).collect():
        assert (row.email, row.ipv4, row.api_key) == cases[row.v], row.v


def test_severity_and_durations(spark):
    micros = [0, 999_999, 300_000_000, 300_000_001, 3_600_000_000, 3_600_000_001, 93_784_000_000, 86_400_000_000]
    frame = spark.createDataFrame([(m,) for m in micros], "m BIGINT")
    rows = frame.select("m", t.severity(F.col("m")).alias("s"), t.human_duration(F.col("m")).alias("h")).collect()
    assert [(r.s, r.h) for r in rows] == [
        ("LOW", "0s"), ("LOW", "0s"), ("LOW", "5m"), ("MEDIUM", "5m"), ("MEDIUM", "1h"), ("HIGH", "1h"), ("HIGH", "1d 2h 3m 4s"),
        ("HIGH", "1d"),
    ]


def test_differences_do_not_depend_on_the_session_zone(spark):
    pairs = [
        (datetime(2024, 3, 10, 1, 30), datetime(2024, 3, 10, 3, 30, 0, 1)),
        (datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 30)),
        (datetime(2024, 11, 3, 0, 30), datetime(2024, 11, 3, 2, 30)),
        (datetime(2024, 11, 3, 2, 30), datetime(2024, 11, 3, 0, 30)),
        (datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999999)),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a STRING, b STRING").select(
            F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b")
        )
        rows = frame.select(
            t.micros_between(F.col("a"), F.col("b")).alias("d"), t.epoch_micros(F.col("b")).alias("e"), t.text_stamp(F.col("b")).alias("s")
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    one = (datetime(1970, 1, 1, 0, 0, 0, 1) - datetime(1970, 1, 1))
    assert [r.d for r in rows] == [(b - a) // one for a, b in pairs]
    assert [r.e for r in rows] == [(b - datetime(1970, 1, 1)) // one for _, b in pairs]
    assert [r.s for r in rows] == [str(b) for _, b in pairs]


def outside(start, end, hours):
    if hours.ignore_weekends and start.weekday() >= 5 and end.weekday() >= 5:
        return True
    opening = datetime.strptime(hours.start_time, "%H:%M").time()
    closing = datetime.strptime(hours.end_time, "%H:%M").time()
    return end.time() < opening or start.time() > closing


def test_business_hours(spark):
    stamps = [
        datetime(2024, 10, 11, 8, 59, 59, 999999), datetime(2024, 10, 11, 9), datetime(2024, 10, 11, 17),
        datetime(2024, 10, 11, 17, 0, 0, 1), datetime(2024, 10, 12, 12), datetime(2024, 10, 13, 12), datetime(2024, 10, 14, 3),
    ]
    pairs = [(a, b) for a in stamps for b in stamps]
    frame = spark.createDataFrame(pairs, "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    for weekends in (True, False):
        hours = BusinessHours("09:00", "17:00", weekends)
        rows = frame.select("a", "b", t.outside_business_hours(F.col("a"), F.col("b"), hours).alias("o")).collect()
        assert all(r.o == outside(r.a, r.b, hours) for r in rows)


def test_rounding_like_python(spark):
    rng = random.Random(2)
    values = [k / 20 for k in range(0, 400)] + [k / 200 for k in range(200)] + [rng.random() * 100 for _ in range(300)]
    values += [-v for v in values[:100]] + [5000.25, 0.0]
    frame = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for row in frame.select("v", rounding.one_decimal(F.col("v")).alias("r")).collect():
        assert row.r == round(row.v, 1), row.v
    small = [k * 18_000_000 / 1e6 / 3600 for k in range(1, 200)] + [rng.random() for _ in range(200)]
    frame = spark.createDataFrame([(v,) for v in small], "v DOUBLE")
    for row in frame.select("v", rounding.two_decimals_text(F.col("v")).alias("r")).collect():
        assert row.r == f"{row.v:.2f}", row.v
