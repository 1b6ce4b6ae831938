"""Repeated spans against a search of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import substrings
from tidemark.workspace import Workspace

WORD = re.compile("[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def plain(rows, width):
    """(doc_id, n_words, n_removed, kept or None, digest of all words) of each row."""
    starts = {}
    texts = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for rank, words in texts:
        for k in range(len(words) - width + 1):
            span = tuple(words[k:k + width])
            starts[span] = min(starts.get(span, LAST), rank)
    out = []
    for (i, _), (rank, words) in zip(rows, texts):
        gone = set()
        for k in range(len(words) - width + 1):
            if starts[tuple(words[k:k + width])] < rank:
                gone |= set(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone) if gone else None
        out.append((str(i), len(words), len(gone), kept, hashlib.sha256(" ".join(words).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, folder, width, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    made = substrings.repeats(docs, Workspace(spark, str(folder)), width=width, **more).collect()
    for r in made:
        assert sum(s["last"] - s["first"] + 1 for s in r["removed"]) == r["n_removed"]
    return sorted(((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"], r["whole"]) for r in made), key=repr)


def tangled(seed, width):
    """Few words, so that nodes branch and windows run in circles; shared passages, copies and near copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c é", "Ü", "x\x0by"])
    passages = [" ".join(word() for _ in range(rng.randint(1, 4 * width))) for _ in range(4)]
    rows = []
    for i in rng.sample(range(1000), 40):
        parts = [rng.choice([*passages, " ".join(word() for _ in range(rng.randint(0, 2 * width))), "z " * rng.randint(1, 3 * width)]) for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.choice([" ", "\n", "\t \r"]).join(parts)))
    rows += [(2000 + k, rows[k][1]) for k in range(10)]
    rows += [(rows[5][0], rows[6][1]), rows[7], rows[7], (None, rows[8][1]), (None, rows[8][1] + " tail"), (None, None), (3000, None), (3001, ""), (3002, " \n")]
    return rows


@pytest.mark.parametrize("seed, width", [(1, 4), (2, 3), (3, 7)])
def test_all_windows(spark, tmp_path, seed, width):
    rows = tangled(seed, width)
    assert found(spark, rows, tmp_path, width) == plain(rows, width)


@pytest.mark.parametrize("mask", [0x7, 0xFF])
def test_colliding_nodes_are_told_apart(spark, tmp_path, mask):
    rows = tangled(9, 5)
    assert found(spark, rows, tmp_path, 5, mask=mask) == plain(rows, 5)


def test_long_texts_and_many_spans_of_a_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substrings, "SPANS", 3)
    rng = random.Random(5)
    source = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    rows = [(1, " ".join(source)), (2, " ".join(source[:300] + ["odd"] + source[300:]))]
    for i in range(30):
        at = rng.randrange(39_000)
        rows.append((10 + i, " ".join([f"own{i}", *source[at:at + 60 + i], "end"])))
    assert found(spark, rows, tmp_path, 50) == plain(rows, 50)


@pytest.mark.parametrize("rows", [[], [(1, "one two")], [(None, None)], [(1, "w " * 60), (1, "w " * 60)]])
def test_little_input(spark, tmp_path, rows):
    assert found(spark, rows, tmp_path, 50) == plain(rows, 50)


def test_rows_come_back_with_their_columns(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, f"own  words\n{text} more"), (3, text), (3, text), (4, None), (None, "a  b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("k1", "k2", "row", "rank", "removed", "kept", "anchors", "t"):
        docs = docs.withColumn(name, F.lit("clash"))
    made = substrings.without_repeats(docs, Workspace(spark, str(tmp_path))).select("row.doc_id", "row.kept", "text", "n_words", "n_removed")
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([
        (1, "clash", text, 60, 0), (2, "clash", "own words more", 63, 60), (3, "clash", "", 60, 60), (3, "clash", "", 60, 60),
        (4, "clash", None, 0, 0), (None, "clash", "a  b", 2, 0),
    ], key=repr)


def test_paths_are_whole(spark, tmp_path):
    """Two texts meet and part: the shared run is one piece; three sources in turn make a path of pieces."""
    def edges(*texts):
        nodes = {}
        name = lambda span: nodes.setdefault(span, len(nodes))
        return [(name(tuple(t[k:k + 2])), name(tuple(t[k + 1:k + 3])), (n << 8) + k) for n, t in enumerate(texts) for k in range(len(t) - 2)]

    schema = "left bigint, right bigint, place bigint"
    run = spark.createDataFrame(edges("abcdefgh", "xxcdefgyy", "abcdqq"), schema)
    pieces, follow = substrings.compacted(run, 8, Workspace(spark, str(tmp_path / "a")))
    assert sorted((r["source"], r["piece"]) for r in pieces.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert follow.collect() == []
    # abcdef is shared by 0 and 3, then efghij by 1 and 3, then ijkl by 2 and 3: one path of three sources.
    run = spark.createDataFrame(edges("abcdef", "defghij", "hijkl", "abcdefghijkl"), schema)
    pieces, follow = substrings.compacted(run, 8, Workspace(spark, str(tmp_path / "b")))
    at = {r["piece"]: (r["path"], r["at"]) for r in follow.collect()}
    assert at == {(1 << 8) + 1: (0, 4), (2 << 8) + 1: (0, 8)}
    assert pieces.count() == 10


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"wörter{k % 97}" for k in range(5000)).encode()
    whole = substrings.word_hashes(text)
    monkeypatch.setattr(substrings, "BLOCK", 100)
    assert np.array_equal(whole, substrings.word_hashes(text)) and len(set(whole.tolist())) == 97
    assert np.array_equal(substrings._least(np.array([5, 3, 4, 1, 9, 2]), 3), [3, 1, 1, 1])
