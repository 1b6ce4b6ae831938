"""Cutting JSON documents by ranges, against parsing them whole."""

import json
import random

import pytest

from tidemark import Workspace, analyze
from tidemark.sources import documents, files


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(["", 'a "quote"', "back\\", "\\\\\"", "{[", "]}", "ä€😀", "x" * 40, ",", '\\"'])
    if kind == 1:
        return rng.choice([1, -2.5, True, None, 10**20])
    if kind == 2:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind == 3:
        return "plain"
    return {rng.choice(["k", 'q"', "Records", "{"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def document(rng):
    records = [{"n": i, **(v if isinstance(v := value(rng), dict) else {"v": v})} for i in range(rng.randint(1, 12))]
    spell = lambda v: json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    body = "[" + rng.choice([",", " ,\n ", ",\t"]).join(spell(r) for r in records) + rng.choice(["]", "\n]"])
    return rng.choice([body, " " + body + "\n", '{"Records": ' + body + "}", '{"a": "[{", "Records":' + body + ', "z": 1}\n'])


ODD = [
    "", " ", "{}", "[]", '{"Records": []}', "[1, 2]", '[{"a": 1}, 2]', '[{"a": 1} {"b": 2}]', '[{"a": 1},, {"b": 2}]', '[{"a": 1},]', '[{"a": 1}',
    '[{"a": }]', '{"Records": [{"a": 1}]', '{"Records": [{"a": 1}]} tail', '{"other": [{"a": 1}], "Records": [{"b": 2}]}', '{"eventTime": "x", "list": [{"a": 1}]}',
    '[{"a": "unclosed}]', '[{"a": NaN}]', '[[{"a": 1}]]', '{"Records": {"a": [{"b": 1}]}}', '[{"a": "\\', "not json", '{"a": 1}\n{"b": 2}',
]


def test_any_range_gives_the_same_records(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(documents, "BEYOND", 3)
    texts = [document(rng) for _ in range(25)] + ODD
    for i, text in enumerate(texts):
        (tmp_path / f"d{i:03} %41.json").write_text(text, encoding="utf-8")
    whole = files.unpack_records(files.raw_documents(spark, str(tmp_path)))
    rows = lambda df: sorted((r["source"], r["line_number"], r["line"]) for r in df.collect())
    expected = rows(whole)
    for size in (150, 1 << 20):
        monkeypatch.setattr(documents, "RANGE_BYTES", size)
        monkeypatch.setattr(documents.cut, "__defaults__", (size,))
        found = files.document_records(spark, str(tmp_path), Workspace(spark))
        assert rows(found) == expected
    sources = [f"file://{tmp_path}/d{i:03}%20%2541.json" for i in range(len(texts))]
    _, odd = documents.cut(spark, [s for s, t in zip(sources, texts) if t], Workspace(spark), 400)
    # All well formed lists of objects are cut; nothing broken is.
    assert {int(s.rsplit("/d", 1)[1][:3]) for s in odd} == {i for i, t in enumerate(texts) if i >= 25 and t}


def test_a_large_document_in_many_tasks(spark, tmp_path):
    path = tmp_path / "big.json"
    with path.open("w") as file:
        file.write('{"Records": [\n')
        file.write(",\n".join('{"eventTime":"2024-01-01T%02d:%02d:%02dZ","userIdentity":{"arn":"u%d"},"eventName":"List","pad":"%s"}' % (i // 3600 % 24, i // 60 % 60, i % 60, i % 7, "x" * 100) for i in range(50_000)))
        file.write("\n]}")
    found, odd = documents.cut(spark, [f"file://{path}"], Workspace(spark), 1 << 19)
    assert odd == [] and path.stat().st_size // (1 << 19) >= 16
    whole = files.unpack_records(files.raw_documents(spark, str(path)))
    assert found.count() == whole.count() == 50_000
    assert found.select("line_number", "line").exceptAll(whole.select("line_number", "line")).count() == 0
    assert analyze(spark, str(path), audit=True, documents=True, min_gap_threshold=300).counters.first()["total_lines"] == 50_000
