"""Files that grow while they are followed."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark import Settings, analyze, analyze_stream, findings_so_far, follow_appended
from tidemark.sources import appended


def plain(data: bytes, whole: bool):
    """Place and content of each line, one byte after the other."""
    out, begin, at = [], 0, 0
    while at < len(data):
        step = 2 if data[at:at + 2] == b"\r\n" else 1 if data[at:at + 1] in (b"\r", b"\n") else 0
        if step == 1 and data[at:at + 1] == b"\r" and at + 1 == len(data) and not whole:
            break
        if step:
            out.append((begin, data[begin:at]))
            begin = at + step
        at += step or 1
    if whole and begin < len(data):
        out.append((begin, data[begin:]))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_any_cut_gives_each_line_once(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(appended, "CHUNK", rng.choice([1, 2, 7, 64]))
    data = b"".join(rng.choice([b"", b"a", b"line", b"x" * 50, "ä".encode()]) + rng.choice([b"\n", b"\r", b"\r\n", b"\n\n"]) for _ in range(rng.randint(0, 30)))
    data += rng.choice([b"", b"half", b"\r"])
    end = appended.last_line_end(io.BytesIO(data), len(data))
    for upto, whole in ((end, False), (len(data), True)):
        size = rng.randint(1, 40)
        found = [pair for at in range(0, upto, size) for pair in appended.lines_between(io.BytesIO(data), at, min(at + size, upto), upto)]
        assert found == plain(data, whole)


def collected(spark, stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return sorted((r["source"].rsplit("/", 1)[-1], r["seq"], r["line"]) for r in spark.read.parquet(str(out)).collect())


def held(folder):
    return sorted(
        (name.name, at, line.decode("utf-8", "replace")) for name in folder.glob("[!_]*.log") for at, line in plain(name.read_bytes(), False)
    )


def test_growth_over_restarts(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs %41", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    first = folder / "a.log"
    first.write_bytes(b"one\ntwo\nhal")
    (folder / "_hidden.log").write_bytes(b"no\n")
    (folder / "other.txt").write_bytes(b"no\n")
    follow = lambda: follow_appended(spark, f"{folder}/*.log", partition_bytes=100_000)
    assert collected(spark, follow(), out, checkpoint) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    # Half a line more, then its end, a second file, and a growth of many ranges.
    with first.open("ab") as file:
        file.write(b"f a li")
    assert collected(spark, follow(), out, checkpoint) == held(folder)
    with first.open("ab") as file:
        file.write(b"ne\r\nnext \xff\n" + b"".join(b"%d %s\n" % (k, b"x" * (k % 300)) for k in range(20_000)) + b"y" * 500_000)
    (folder / "b.log").write_bytes(b"\n\nlone")
    assert collected(spark, follow(), out, checkpoint) == held(folder)
    with first.open("ab") as file:
        file.write(b"\nlast\n")
    found = collected(spark, follow(), out, checkpoint)
    assert found == held(folder) and len(found) == 20_008
    # Nothing new, nothing twice.
    assert collected(spark, follow(), out, checkpoint) == found


def test_from_the_end_and_replaced(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"old\nolder\nhalf")
    assert collected_or_none(spark, follow_appended(spark, str(folder), from_end=True), out, checkpoint) == []
    with (folder / "a.log").open("ab") as file:
        file.write(b" and half\nnew\n")
    (folder / "b.log").write_bytes(b"whole\n")
    assert collected(spark, follow_appended(spark, str(folder), from_end=True), out, checkpoint) == [
        ("a.log", 10, "half and half"), ("a.log", 24, "new"), ("b.log", 0, "whole"),
    ]
    (folder / "a.log").write_bytes(b"fresh\n")
    assert ("a.log", 0, "fresh") in collected(spark, follow_appended(spark, str(folder), from_end=True), out, checkpoint)


def collected_or_none(spark, stream, out, checkpoint):
    try:
        return collected(spark, stream, out, checkpoint)
    except Exception as error:  # nothing was written yet
        if "UNABLE_TO_INFER_SCHEMA" in str(error) or "PATH_NOT_FOUND" in str(error):
            return []
        raise


def test_batch_form_is_the_whole_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\r\ntwo\rthree")
    appended.register(spark)
    read = lambda path: spark.read.format(appended.NAME).option("path", path).option("partitionBytes", 4).load()
    assert sorted((r["seq"], r["line"]) for r in read(str(tmp_path)).collect()) == [(0, "one"), (5, ""), (7, "two"), (11, "three")]
    assert read(f"{tmp_path}/none*").count() == 0


def test_a_growing_log_is_analyzed(spark, tmp_path):
    log, out = tmp_path / "in" / "app.log", tmp_path / "out"
    log.parent.mkdir()
    settings = Settings(block_lines=50, default_year=2024)
    text = "".join(f"2024-01-0{1 + k // 100} {k % 24:02}:{k % 60:02}:00 event {k} by user\n" for k in range(300)).encode()
    for part in (text[:4000], text[4000:4010], text[4010:9000], text[9000:]):
        with log.open("ab") as file:
            file.write(part)
        query = analyze_stream(follow_appended(spark, str(log), partition_bytes=1000), str(out), settings=settings, trigger={"availableNow": True})
        query.awaitTermination()
        assert query.exception() is None
    whole, streamed = analyze(spark, str(log), settings=settings), findings_so_far(spark, str(out), settings)
    for kind in ("gaps", "causality"):
        columns = [c for c in getattr(whole, kind).columns if c not in ("source", "alibi_evidence_count")]
        rows = lambda found: sorted(map(str, getattr(found, kind).select(*columns).collect()))
        assert rows(whole) == rows(streamed) and len(rows(whole)) > 0
    assert streamed.scores.select("total_lines").first()[0] == 300
