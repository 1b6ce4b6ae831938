import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import knn
from tidemark.workspace import Workspace


def plain(data, queries, k):
    best = {}
    for q, u in queries:
        for i, v in data:
            if None not in (q, i) and u is not None and v is not None and i != q and len(u) == len(v):
                s = sum(a * b for a, b in zip(u, v))
                best[q, i] = max(best.get((q, i), s), s)
    found = []
    for q in {q for q, _ in best}:
        ordered = sorted((-s, i) for (p, i), s in best.items() if p == q)[:k]
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ordered)]
    return sorted(found)


@pytest.mark.parametrize("chunk,per_pivot", [(4_096, 256), (16, 4)])
def test_equals_brute_force(spark, monkeypatch, chunk, per_pivot):
    monkeypatch.setattr(knn, "DATA_CHUNK", chunk)
    monkeypatch.setattr(knn, "QUERY_CHUNK", chunk // 2)
    monkeypatch.setattr(knn, "QUERIES_PER_PIVOT", per_pivot)
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (5, 6))
    data = [(i, (centres[i % 5] + rng.integers(-20, 20, 6)).tolist()) for i in range(300)]
    data += [(1000 + i, [1, 1, 1, 1, 1, 1]) for i in range(40)] + [(5, data[5][1]), (7, [9] * 6), (None, [1] * 6), (8, None)]
    data += [(2000, [3, 4]), (2001, [5, 6]), (2002, []), (2003, []), (2004, [2**33, 1]), (2005, [1])]
    queries = [d for d in data if d[0] is None or d[0] % 9 == 0 or d[0] in (7, 2000, 2002, 2004, 2005)]
    make = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, vector array<bigint>, dim int")
    space = Workspace(spark)
    found = knn.top_k(make(data), make(queries), 5, space).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == plain(data, queries, 5)
    assert knn.top_k(make([]), make(queries), 5, space).count() == 0
    assert knn.top_k(make(data), make([]), 5, space).count() == 0
    space.release()


def test_bounds_leave_groups_out():
    """Far groups are not visited, near ones are."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(0, 5, (50, 4)) + 100, rng.integers(0, 5, (50, 4)) - 100])
    bounds = knn.Bounds(np.arange(100), rows, 2)
    pivot, distance = bounds.nearest(rows)
    bounds.radius = np.array([distance[pivot == p].max() for p in range(2)])
    needed = bounds.needed(np.arange(3), rows[:3], 5)
    assert needed[:, pivot[0]].all() and not needed[:, pivot[60]].any()


def test_scaled(spark):
    df = spark.createDataFrame(
        [([0.5, -0.001],), ([float("nan")],), ([float("inf")],), ([None, 1.0],), (None,), ([],)], "embedding array<float>"
    )
    assert [r[0] for r in df.select(knn.scaled("embedding")).collect()] == [[128, -1], None, None, None, None, []]
    assert df.select(F.size(knn.scaled("embedding"))).count() == 6


def made(spark, rows):
    return spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows], "vec_id bigint, vector array<bigint>")


def test_many_meetings_equal_brute_force(spark, monkeypatch):
    """Several blocks of queries and parts of data, groups in several of them, chunks cut by what a task may hold."""
    for name, value in dict(QUERY_BLOCK=24, DATA_BLOCK=60, PRODUCTS=64, QUERY_CHUNK=5, DATA_CHUNK=9, QUERIES_PER_PIVOT=12, HELD=40,
                            TILE=7, FEW=3, SAMPLE=60).items():
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(8)
    centres = rng.integers(-300, 300, (4, 5))
    data = [(i, centres[0 if i < 250 else i % 4] + rng.integers(-9, 9, 5)) for i in range(400)]
    data += [(900 - i, [7] * 5) for i in range(60)] + [(3, centres[1]), (3, centres[2]), (-4, [2**29] * 5), (-5, [-(2**31)] * 5)]
    data += [(2000 + i, [i, 1]) for i in range(9)] + [(3000, [1, 2, 3])]
    queries = [d for d in data if d[0] % 3 == 0 or d[0] > 850 or d[0] < 0] + [(5, centres[3]), (7000, [1, 2, 3]), (7001, [1] * 4)]
    space = Workspace(spark)
    found = knn.top_k(made(spark, data), made(spark, queries), 4, space).collect()
    ints = lambda rows: [(i, [int(x) for x in v]) for i, v in rows]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == plain(ints(data), ints(queries), 4)
    space.release()


def broadcast_columns(plan):
    """Columns of what a plan's joins broadcast."""
    if plan.nodeName() == "BroadcastExchange":
        yield from (plan.output().apply(i).name() for i in range(plan.output().size()))
    for i in range(plan.children().size()):
        yield from broadcast_columns(plan.children().apply(i))


def test_vectors_are_not_broadcast(spark, monkeypatch):
    """Their files are small beside Spark's limit for broadcasts, but every query goes to every pivot that it needs."""
    monkeypatch.setattr(knn, "QUERIES_PER_PIVOT", 8)
    rng = np.random.default_rng(2)
    data = [(i, rng.integers(-99, 99, 8)) for i in range(200)]
    space = Workspace(spark)
    found = knn.top_k(made(spark, data), made(spark, data[::2]), 3, space)
    prepared = found._jdf.queryExecution().executedPlan()
    sent = set(broadcast_columns(prepared.initialPlan() if prepared.nodeName() == "AdaptiveSparkPlan" else prepared))
    assert sent <= {"dim", "pivot", "first", "parts", "blocks", "firsts", "lasts"}
    assert found.count() == 300
    space.release()


def test_sample_is_bounded_where_an_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(knn, "SAMPLE", 4)
    monkeypatch.setattr(knn, "sampled", lambda rows, key, n: rows)  # as where the sample's hash takes the id
    rows = spark.range(3_000).selectExpr("if(id < 2900, 1, id) as vec_id", "array(id, id % 7) as vector", "2 as dim")
    assert 1 <= len(knn._sample(rows)) <= 16


@pytest.mark.parametrize("high", [9, 2**20, 2**30])
def test_block_in_each_number_type(high):
    """Sums in 32 and 64 bit floating point and in whole numbers; repeated ids, many ties, k beyond a chunk."""
    rng = np.random.default_rng(high)
    for k, few in ((1, 64), (3, 2), (50, 1)):
        queries = rng.integers(-high, high, (30, 3))
        block = knn._Block(3, k)
        for at in range(0, 30, 10):
            block.add(np.arange(at, at + 10), queries[at : at + 10], np.full(10, knn.LEAST), np.packbits([True, at > 0]).tobytes())
        data, knn_few = [], knn.FEW
        knn.FEW = few
        for pivot in (0, 0, 1):
            ids, vectors = np.sort(rng.integers(0, 60, 40)), rng.integers(-high, high, (40, 3)) // (high // 2) * (high // 2)
            block.meet(pivot, ids, vectors)
            data.append((pivot, ids, vectors))
        knn.FEW = knn_few
        found = [tuple(x) for batch in block.found() for x in zip(*(c.to_pylist() for c in batch.columns))]
        for q, u in enumerate(queries.tolist()):
            best = {}
            for pivot, ids, vectors in data:
                for i, v in zip(ids.tolist(), vectors.tolist()):
                    if i != q and (q >= 10 or pivot == 0):
                        s = sum(a * b for a, b in zip(u, v))
                        best[i] = max(best.get(i, s), s)
            expected = sorted((-s, i) for i, s in best.items())[:k]
            assert sorted((-s, i) for p, i, s in found if p == q) == expected
