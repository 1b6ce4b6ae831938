from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import Settings
from tidemark.functions import stamps
from tidemark.sources import normalize

YEAR = 2023


def parse_all(spark, lines, settings=None, parse=normalize.normalize_text):
    raw = spark.createDataFrame([("log", i, line) for i, line in enumerate(lines, 1)], "source STRING, line_number BIGINT, line STRING")
    rows = parse(raw, settings or Settings(default_year=YEAR)).orderBy("line_number").collect()
    assert [row.line_number for row in rows] == list(range(1, len(lines) + 1))
    return rows


TEXT_CASES = [
    ("081109 203615 start", datetime(2008, 11, 9, 20, 36, 15)),
    ("991109 203615 start", datetime(1999, 11, 9, 20, 36, 15)),
    ("681109   203615", datetime(2068, 11, 9, 20, 36, 15)),
    ("690101 000000", datetime(1969, 1, 1)),
    ("Oct  5 01:02:03 host", datetime(YEAR, 10, 5, 1, 2, 3)),
    ("Oct 15 01:02:03 host", datetime(YEAR, 10, 15, 1, 2, 3)),
    ("Oct 1501:02:03 host", None),
    ("Feb 29 01:02:03 host", None),
    ("Xyz 12 01:02:03 host", None),
    ("2024-10-15 08:00:60 x", None),
    ("2024-10-15 08:00:61 x", None),
    ("2024-10-15 24:00:00 x", None),
    ("2024-02-30 08:00:00 x", None),
    ("0000-10-15 08:00:00 x", None),
    ("2024-02-29 08:00:00 x", datetime(2024, 2, 29, 8)),
    ("2024-10-15 08:00:00,123 x", datetime(2024, 10, 15, 8)),
    ("2024-10-15 08:00:00.123 x", None),
    ("2024-10-15T08:00:00 x", None),
    ("2024/10/15 08:00:00 x", None),
    ("  \t2024-10-15 08:00:00 padded\x1f ", datetime(2024, 10, 15, 8)),
    ("say 2024-10-15 08:00:00", None),
    ("", None),
    ("   ", None),
    ("Just some random text without timestamp", None),
]


def test_text_lines(spark):
    rows = parse_all(spark, [line for line, _ in TEXT_CASES])
    for row, (line, expected) in zip(rows, TEXT_CASES):
        assert row.ts == expected, line
    assert rows[19].raw_payload == "2024-10-15 08:00:00 padded"
    assert rows[0].actor is None and rows[0].event_name is None


def test_custom_formats_follow_their_order(spark):
    settings = Settings(timestamp_formats=("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"))
    rows = parse_all(spark, ["2024-10-15 08:00:00.123 a", "2024-10-15 08:00:00 b", "2024-10-15T08:00:01 c"], settings)
    assert [row.ts for row in rows] == [
        datetime(2024, 10, 15, 8, 0, 0, 123000), datetime(2024, 10, 15, 8), datetime(2024, 10, 15, 8, 0, 1)
    ]
    assert parse_all(spark, ["2024-10-15 08:00:00 b"], Settings(timestamp_formats=()))[0].ts is None


@pytest.mark.parametrize(
    "text, fmt",
    [
        ("03:04:05 PM 07/08/2021", "%I:%M:%S %p %m/%d/%Y"),
        ("12:04:05 am 07/08/2021", "%I:%M:%S %p %m/%d/%Y"),
        ("12:04:05 PM 07/08/2021", "%I:%M:%S %p %m/%d/%Y"),
        ("march 7 2021 1:2:3", "%B %d %Y %H:%M:%S"),
        ("2021-3-7 1:2:3.5", "%Y-%m-%d %H:%M:%S.%f"),
        ("7.3.21", "%d.%m.%y"),
        ("20210307T010203", "%Y%m%dT%H%M%S"),
        ("2021-03-07 01:02", "%Y-%m-%d %H:%M:%S"),
        ("2021-03-07 01:02:033", "%Y-%m-%d %H:%M:%S"),
        ("100% 2021", "100%% %Y"),
    ],
)
def test_formats_agree_with_strptime(spark, text, fmt):
    try:
        expected = datetime.strptime(text, fmt)
    except ValueError:
        expected = None
    frame = spark.createDataFrame([(text,)], "t STRING")
    assert frame.select(stamps.parse_stamp(F.col("t"), fmt, YEAR)).first()[0] == expected


def test_unknown_directive():
    with pytest.raises(ValueError):
        stamps._layout("%Q")


ISO_CASES = [
    "2024-10-14T10:00:00Z", "2024-10-14T10:00:00.5Z", "2024-10-14T10:00:00+05:30", "2024-10-14 10:00:00", "2024-10-14",
    "20241014T100000Z", "2024-10-14T10", "2024-10-14T10:05", "2024-10-14T10:00:00.1234567", "2024-10-14T10:00:00,25",
    "2024-10-14T10:00:60Z", "2024-13-14T10:00:00Z", "2024", "yesterday", "2024-10-14T10:00:00-0830", "0000-01-01T00:00:00Z",
    "2024-10-14T10:00:00+25:00", "2024-10-14T1:00:00Z", " 2024-10-14T10:00:00Z",
]


def test_iso_stamps_agree_with_fromisoformat(spark):
    def expected(text):
        try:
            return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            return None

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ISO_CASES)], "i INT, t STRING")
    rows = frame.select("i", stamps.iso_stamp(F.col("t")).alias("ts")).orderBy("i").collect()
    assert [(ISO_CASES[r.i], r.ts) for r in rows] == [(t, expected(t)) for t in ISO_CASES]


AUDIT_CASES = [
    ('{"eventTime":"2024-10-14T10:00:00Z","userIdentity":{"arn":"a","userName":"u"},"sourceIPAddress":"1.1.1.1"}', "a"),
    ('{"eventTime":"2024-10-14T10:00:00Z","userIdentity":{"arn":"","userName":"u"}}', "u"),
    ('{"eventTime":"2024-10-14T10:00:00Z","userIdentity":{"arn":null,"principalId":"p"}}', "p"),
    ('{"eventTime":"2024-10-14T10:00:00Z","userIdentity":{"arn":0,"userName":false,"principalId":"p"}}', "p"),
    ('{"eventTime":"2024-10-14T10:00:00Z","userIdentity":"text"}', None),
    ('  {"eventTime":"2024-10-14T10:00:00Z"}  ', None),
]
AUDIT_REJECTS = [
    "", "text", '["eventTime"]', '{"broken":1', '{"eventTime":""}', '{"eventTime":null}', "{}", '{"eventTime":20241014}',
    '{"eventTime":"2024-10-14T10:00:00Z"} tail', '{"eventTime":"2024-10-14T10:00:00Z"},{"eventTime":"2024-10-14T10:00:00Z"}',
    '{"eventTime":"2024-10-14T10:00:00Z","userIdentity":{"arn":7}}', '{"eventTime":"soon"}',
    "{'eventTime':'2024-10-14T10:00:00Z'}", "{\"eventTime\":'2024-10-14T10:00:00Z'}",
]


def test_audit_lines(spark):
    rows = parse_all(spark, [line for line, _ in AUDIT_CASES], parse=normalize.normalize_audit)
    for row, (line, actor) in zip(rows, AUDIT_CASES):
        assert row.ts == datetime(2024, 10, 14, 10), line
        assert row.actor == actor, line
        assert row.raw_payload == line.strip()
    assert rows[0].source_ip == "1.1.1.1"


def test_audit_rejects(spark):
    rows = parse_all(spark, AUDIT_REJECTS, parse=normalize.normalize_audit)
    assert [row.ts for row in rows] == [None] * len(AUDIT_REJECTS)
    assert all(row.actor is None for row in rows)


def test_python_line_function(spark):
    def parse(line, number):
        if not line.startswith("t="):
            return None
        return {"ts": datetime(2024, 1, 1, 0, 0, int(line[2:])), "actor": f"line{number}"}

    rows = parse_all(spark, ["t=5", "no", "t=7"], parse=normalize.normalize_with(parse))
    assert [(row.ts, row.actor) for row in rows] == [
        (datetime(2024, 1, 1, 0, 0, 5), "line1"), (None, None), (datetime(2024, 1, 1, 0, 0, 7), "line3")
    ]
    assert rows[1].raw_payload == "no"
