"""Whitening against numpy's own eigenvalues and a plain calculation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening
from tidemark.workspace import Workspace


def spectrum(values, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = (q * np.asarray(values, float)) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 2, 1, 0.5], [4, 4, 4, 4, 4, 1], [5, 4, 3, 2, 2, 2, 1], [1e6, 1, 1e-3, 1e-6, 0, 0], [3], [2, 1], [1, 1, 1, 1, 1, 1, 1],
    [7, 6, 5, 4, 4 - 1e-9, 1], [1e-12, 5e-13, 3e-13, 2e-13, 1e-13], [8, 0, 0, 0, 0, 0], list(np.linspace(1, 2, 64)), [5, 1, -3, -4, -9],
])
def test_leading_pairs(values):
    v = spectrum(values)
    found, vectors = whitening.leading(v, 4)
    true = np.sort(np.linalg.eigvalsh(v))[::-1][:4]
    scale = np.abs(values).max()
    assert np.allclose(found, true, atol=1e-13 * scale * len(values), rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
    assert np.abs(v @ vectors - vectors * found).max() < 1e-11 * scale


@pytest.mark.parametrize("seed", range(20))
def test_inertia_counts_signs(seed):
    rng = np.random.default_rng(seed)
    values = rng.standard_normal(rng.integers(1, 12))
    assert whitening.inertia(spectrum(values, seed)) == (int((values > 0).sum()), int((values < 0).sum()))
    a = rng.integers(-2, 3, (6, 6))
    a = (a + a.T) * (1 - np.eye(6))  # zero diagonal: pivots of two rows
    true = np.linalg.eigvalsh(a)
    if np.abs(true).min() > 1e-9:
        assert whitening.inertia(a.astype(float)) == (int((true > 0).sum()), int((true < 0).sum()))


def plain(rows):
    """By vec_id: exact deviation, whitened values up to sign; and the explained shares."""
    whole = {
        i: tuple(math.floor(256 * c) for c in v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    fit = sorted(set(whole.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    y = {i: ((np.array(x) - np.array(sums) / n) @ u) / np.sqrt(e) for i, x in whole.items()}
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in whole.items()}
    return n, deviation, y, e / np.trace(v)


def test_rows_against_a_plain_calculation(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 10)) * np.linspace(2, 0.2, 10)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies count once in the fit list
    rows += [(2000, None), (2001, [None] + [0.0] * 9), (2002, [float("nan")] + [0.0] * 9), (2003, [float("inf")] + [0.0] * 9), (2004, [0.5] * 9), (2005, [])]
    data = spark.createDataFrame(rows, "vec_id bigint, v array<double>").withColumns({c: F.lit(1) for c in ("row", "x", "n", "component", "whitened")})
    made = whitening.whiten(data.repartition(4), "v", Workspace(spark, str(tmp_path))).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    n, deviation, y, explained = plain([r for r in rows if r[0] < 2004])
    assert len(made) == 4 * len(y)
    signs = {}
    for r in made:
        k = r["component"] - 1
        assert (r["n"], int(r["deviation"])) == (n, deviation[r["vec_id"]])
        assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
        assert r["identity_error"] < 1e-9
        true = y[r["vec_id"]][k]
        if abs(true) > 1e-3:
            signs.setdefault(k, np.sign(true * r["whitened"]))
            assert r["whitened"] * signs[k] == pytest.approx(true, rel=1e-8)


def test_deviation_beyond_64_bits(spark, tmp_path):
    rows = [(i, [float(1 << 40) * i, 1.0 * i]) for i in range(5)] + [(9, [1e300, 0.0])]
    data = spark.createDataFrame(rows[:5], "vec_id bigint, v array<double>")
    made = whitening.whiten(data, "v", Workspace(spark, str(tmp_path / "a"))).select("row.vec_id", "deviation").distinct().collect()
    n, deviation, *_ = plain(rows[:5])
    assert {r[0]: int(r[1]) for r in made} == deviation
    # Entries beyond 64 bits are held at their ends, without failing.
    assert whitening.whiten(spark.createDataFrame(rows, data.schema), "v", Workspace(spark, str(tmp_path / "b"))).count() > 0


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [0.5, 0.5])],
])
def test_nothing_to_scale(spark, tmp_path, rows):
    data = spark.createDataFrame(rows, "vec_id bigint, v array<float>")
    made = whitening.whiten(data, "v", Workspace(spark, str(tmp_path)))
    assert made.collect() == [] and made.columns == ["row", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_directions_than_components(spark, tmp_path):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)] + [(None, [1.0, 2.0, 0.0])] * 2
    made = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, v array<float>"), "v", Workspace(spark, str(tmp_path))).collect()
    assert len(made) == 8 and {r["component"] for r in made} == {1} and made[0]["n"] == 6


def test_eigenvalue_at_rounding_level_on_the_interval_end():
    # All eigenpairs wanted, the smallest a rounding-level one just above 0: it was counted inside but not found.
    v = np.array([[1.0, -5.55043733e-17], [-5.55043733e-17, 1.23274563e-32]])
    values, vectors = whitening.leading(v, 2)
    assert values == pytest.approx([1.0, 0.0], abs=1e-15)
    assert np.abs(vectors.T @ vectors - np.eye(2)).max() < 1e-12
    values, _ = whitening.leading(np.diag([3.0, 2.0, 1e-30, 0.0, 0.0]), 4)
    assert values == pytest.approx([3.0, 2.0, 0.0, 0.0], abs=1e-12)
