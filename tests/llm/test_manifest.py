"""The Merkle manifest against trees built by hand."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest
from tidemark.llm.common import numbered
from tidemark.workspace import Workspace

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests, fanout):
    """The root, and for each leaf its (before, after) on the way there."""
    steps, where = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above = []
        for k in range(0, len(digests), fanout):
            run = digests[k:k + fanout]
            for s in range(len(run)):
                for leaf in where[k + s]:
                    steps[leaf].append(("".join(run[:s]), "".join(run[s + 1:])))
            above.append(sha("".join(run)))
        where = [sum(where[k:k + fanout], []) for k in range(0, len(where), fanout)]
        digests = above
    return digests[0], steps


def expected(rows, fanout, alter=lambda row: row):
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    tops, below = [], []
    for name in names:
        members = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        top, steps = climb([leaf_of(r) for r in members], fanout)
        tops.append(top)
        below.append((members, steps))
    root, upper = climb(tops, fanout)
    return sorted(
        (str(row[0]), str(row[1]), leaf_of(row), leaf_of(alter(row)), top, root, tuple(own + more))
        for top, (members, steps), more in zip(tops, below, upper) for row, own in zip(members, steps)
    )


def found(frame):
    return sorted(
        (str(r.doc_id), str(r.source), r.leaf, r.altered_leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.steps))
        for r in frame.collect()
    )


@pytest.mark.parametrize("fanout", [4, 16])
def test_trees_by_hand(spark, tmp_path, fanout):
    rows = [(i * 7 % 101, f"s{i % 3}" if i % 5 else "s0", "en", i, f"Text {i}") for i in range(70)]
    rows += [(1000, None, None, None, None), (None, None, "de", 3, ""), (5, "alone", None, 0, "ä€😀"), (6, "", "en", 9, "x" * 70_000)]
    rows += [(2000, "twice", "en", 1, "same")] * 4 + [(2000, "twice", "en", 1, "other")]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = manifest.manifest(docs.repartition(5), Workspace(spark, str(tmp_path)), fanout=fanout)
    assert found(made) == expected(rows, fanout)


def test_alterations_are_seen(spark, tmp_path):
    rows = [(i, "a" if i % 2 else None, "en", i, "Upper" if i % 3 else "lower") for i in range(20)]
    made = manifest.manifest(spark.createDataFrame(rows, SCHEMA), Workspace(spark, str(tmp_path)), F.lower("text"), fanout=16)
    assert found(made) == expected(rows, 16, lambda r: (*r[:4], r[4].lower()))
    checked = made.select("doc_id", (manifest.folded(F.col("altered_leaf"), F.col("steps")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id for r in checked if r.ok} == {r[0] for r in rows if r[4] == "lower"}
    # Untouched leaves fold to the root.
    assert made.filter(manifest.folded(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0


@pytest.mark.parametrize("rows", [[], [(3, "s", "en", 1, "one")], [(None, None, None, None, None)]])
def test_empty_and_single(spark, tmp_path, rows):
    made = manifest.manifest(spark.createDataFrame(rows, SCHEMA), Workspace(spark, str(tmp_path)))
    assert found(made) == (expected(rows, 16) if rows else [])
    assert [r[0] for r in made.select(manifest.proof_hash(F.col("steps"))).collect()] == [sha("")] * len(rows)


def test_clashing_columns_are_left_out(spark, tmp_path):
    rows = [(i, "s", "en", i, "t") for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("digest", "leaf", "place", "n", "steps", "root", "_row", "all", "c0", "a.b"):
        docs = docs.withColumn(name, F.lit("other"))
    assert found(manifest.manifest(docs, Workspace(spark, str(tmp_path)))) == expected(rows, 16)


def test_numbering_cuts_a_group_of_equal_rows(spark, tmp_path):
    nodes = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), F.lit(1).alias("v"))
    space = Workspace(spark, str(tmp_path))
    placed = numbered(nodes, "g", ["v"], space, "t").groupBy("g").agg(
        F.count_distinct("place").alias("places"), F.max("place").alias("last"), F.max("n").alias("n")
    )
    assert {tuple(r) for r in placed.collect()} == {("hot", 2000, 1999, 2000), (None, 1000, 999, 1000)}
