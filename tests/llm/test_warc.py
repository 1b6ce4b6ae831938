import hashlib

import pytest

from tidemark.llm import warc
from tidemark.workspace import Workspace

BIG = "<p>é " + "x" * 200


@pytest.mark.parametrize("shared", [1_000, 2])
def test_round_trip(spark, monkeypatch, shared):
    monkeypatch.setattr(warc, "SHARED", shared)
    rows = [(3, "http://a", BIG), (1, "http://b\r\nX: y", BIG), (2, None, BIG), (2, None, BIG), (4, "u", None), (5, "v", ""), (6, "w", "tiny"), (7, "w", "tiny"),
            (None, "n", BIG), (8, "long", "z" * 3_000_000), (None, "m", BIG + "2")]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id bigint, url string, html string, digest string")
    space = Workspace(spark)
    warc.write_archive(pages, space.path("archive"), space)
    records = warc.read_archive(spark, space.path("archive"))
    assert spark.read.parquet(space.path("archive") + "/payloads").count() == 5
    found = records.select("*", warc.record_bytes().alias("record")).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        head = dict(line.split(": ", 1) for line in r.header.split("\r\n")[1:] if line)
        by_id.setdefault(head["WARC-Record-ID"], []).append(head)
        assert head["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(r.payload).hexdigest()
        body = bytes(r.payload) if head["WARC-Type"] == "response" else b""
        assert bytes(r.record) == r.header.encode() + body + b"\r\n\r\n" and len(body) == int(head["Content-Length"])
    kinds = {k: sorted(h["WARC-Type"] + h.get("WARC-Refers-To", "") for h in v) for k, v in by_id.items()}
    revisit = "revisit<urn:page:1>"
    assert kinds == {
        "<urn:page:1>": ["response"], "<urn:page:2>": [revisit, revisit], "<urn:page:3>": [revisit], "<urn:page:4>": ["response"],
        "<urn:page:5>": ["response"], "<urn:page:6>": ["response"], "<urn:page:7>": ["response"], "<urn:page:8>": ["response"],
        "<urn:page:>": ["response", revisit],
    }
    space.release()


def test_empty(spark):
    space = Workspace(spark)
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), space.path("archive"), space)
    assert warc.read_archive(spark, space.path("archive")).count() == 0
    space.release()
