"""Maps of blocks on the entropy baseline, against the fold of one event after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import Settings, Workspace
from tidemark.operators import baseline, branches

LIMIT = 10**9


def events(seed, size):
    rng = random.Random(seed)
    kind = rng.choice(["mixed", "levels", "quiet", "forged"])
    out = []
    for _ in range(size):
        e = {
            "mixed": rng.uniform(2.5, 6.0), "levels": rng.choice([5.0, 4.9, 3.585, 3.7, 3.807]),
            "quiet": rng.uniform(4.4, 5.0), "forged": rng.choice([0.0, 4.5, 2.9]),
        }[kind]
        out.append((e, rng.choice([80, 80, 80, 20])))
    return out


def fold(rows, n, r):
    for e, chars in rows:
        if not (n > 50 and chars > 20 and (e < 3.0 or e < 0.75 * r)):
            r = (r * n + e) / (n + 1)
        n += 1
    return r


def mapped(rows, n, low, high, guess, limit=LIMIT):
    entropies, chars = np.array([e for e, _ in rows]), np.array([c for _, c in rows])
    judged = (n + np.arange(len(rows)) > 50) & (chars > 20)
    return branches.of_block(entropies, judged, n, low, high, guess, limit, 0.75, 3.0)


@pytest.mark.parametrize("seed", range(40))
def test_a_map_is_the_fold_for_every_start(seed):
    rng = random.Random(seed)
    rows, n = events(seed, rng.randint(1, 400)), rng.choice([0, 1, 49, 51, 1000])
    found = mapped(rows, n, 0.0, 8.0, 4.0)
    # The branches lie side by side and rise.
    assert found[0, 0] == 0.0 and found[-1, 1] == 8.0 and np.array_equal(found[1:, 0], found[:-1, 1])
    for _ in range(50):
        r = rng.uniform(1e-6, 8.0)
        if np.abs(found[:, :2] - r).min() > 1e-9:
            out, known = branches.applied(found, r)
            assert known and out == pytest.approx(fold(rows, n, r), abs=1e-9)
    few = mapped(rows, n, 0.0, 8.0, 4.4, 3)
    assert len(few) <= 3
    out, known = branches.applied(few, 4.4)
    assert known and out == pytest.approx(fold(rows, n, 4.4), abs=1e-9)


@pytest.mark.parametrize("seed", range(20))
def test_neighbours_compose(seed):
    rng = random.Random(seed)
    n, parts = rng.choice([60, 500]), [events(100 + seed, rng.randint(1, 90)) for _ in range(4)]
    maps, at = [], n
    for part in parts:
        maps.append(mapped(part, at, 0.0, 8.0, 4.0))
        at += len(part)
    left = branches.composed(branches.composed(branches.composed(maps[0], maps[1]), maps[2]), maps[3])
    right = branches.composed(branches.composed(maps[0], maps[1]), branches.composed(maps[2], maps[3]))
    for _ in range(50):
        r = rng.uniform(2.0, 7.0)
        if np.abs(left[:, :2] - r).min() > 1e-9:
            true = fold(sum(parts, []), n, r)
            assert branches.applied(left, r) == (pytest.approx(true, abs=1e-9), True)
            assert branches.applied(right, r) == (pytest.approx(true, abs=1e-9), True)


def test_what_no_branch_holds_is_a_guess():
    known = np.array([[1.0, 2.0, 0.5, 1.0]])
    assert branches.applied(known, 1.5) == (1.75, True)
    assert branches.applied(known, 2.5) == (2.25, False)
    assert branches.applied(known, 1.0) == (1.5, False)
    assert branches.applied(known[:0], 3.0) == (3.0, False)
    assert len(branches.composed(known, known + 10)) == 0


@pytest.mark.parametrize("group, kept", [(512, 64), (4, 64), (4, 2)])
def test_blocks_do_not_wait_for_each_other(spark, monkeypatch, group, kept):
    """Two levels around the cut: most decisions hang on earlier ones, over 64 blocks and in few rounds."""
    monkeypatch.setattr(baseline, "measured", lambda df: df)
    monkeypatch.setattr(baseline, "GROUP", group)
    monkeypatch.setattr(baseline, "BRANCHES", kept)
    rng = random.Random(11)
    rows = []
    for source in ("a", "b"):
        for line in range(6400):
            e = rng.choice([5.0, 5.0, 4.907]) if rng.random() < 0.85 else rng.choice([3.585, 3.7, 3.65])
            rows.append((source, line, e, 80))
    frame = spark.createDataFrame(rows, "source STRING, line_number BIGINT, entropy DOUBLE, chars INT").withColumns(
        {"ts": F.lit("2024-01-01 00:00:00"), "raw_text": F.lit("x")}
    )
    rounds = []
    found, state = baseline.collapse_and_state(frame, Settings(block_lines=100), Workspace(spark), on_round=rounds.append)
    mine = {s: [] for s in "ab"}
    for row in found.collect():
        mine[row.source].append((row.line_number, row.baseline))
    ends = {r.source: r.r for r in state.collect()}
    for source in "ab":
        r, expected = 0.0, []
        for n, (_, line, e, _) in enumerate(row for row in rows if row[0] == source):
            if n > 50 and e < 0.75 * r:
                expected.append((line, r))
            else:
                r = (r * n + e) / (n + 1)
        assert [line for line, _ in sorted(mine[source])] == [line for line, _ in expected]
        assert [level for _, level in sorted(mine[source])] == pytest.approx([level for _, level in expected], abs=1e-8)
        assert ends[source] == pytest.approx(r, abs=1e-9)
    # With all branches that matter, no more rounds than the logarithm of the blocks and two; with two branches, more.
    assert 100 < len(mine["a"]) and rounds[-1] == 0 and len(rounds) <= (8 if kept == 64 else 64), rounds
