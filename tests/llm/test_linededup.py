import random

import pytest

from tidemark.llm import linededup
from tidemark.workspace import Workspace

LONG = " ".join(f"w{i}" for i in range(60))
PASSAGE = "\n".join(" ".join(f"p{line}x{i}" for i in range(9)) for line in range(24))
SCHEMA = "doc_id bigint, text string, key string, first string"


def run(spark, rows):
    space = Workspace(spark)
    found = linededup.without_repeats(spark.createDataFrame(rows, SCHEMA), space).collect()
    space.release()
    return found


def test_long_line_stays_once(spark):
    rows = [(2, f"own two\n{LONG}\ntail two", "k", "f"), (1, f"{LONG}\nown one", "k", "f"), (3, f"x\n{LONG}", None, None)]
    found = {r.row.doc_id: (r.text, r.removed_lines, r.n_lines) for r in run(spark, rows)}
    assert found == {1: (f"{LONG}\nown one", 0, 2), 2: ("own two\ntail two", 1, 3), 3: ("x", 1, 2)}


def test_passage_goes_wherever_it_is_shifted(spark):
    rows = [(i, "\n".join([*(f"start {i} {j}" for j in range(i)), PASSAGE, f"end {i}"]), None, None) for i in range(1, 6)]
    found = {r.row.doc_id: r for r in run(spark, rows)}
    assert found[1].removed_lines == 0 and found[1].text == rows[0][1]
    for i in range(2, 6):
        # All but the chunks at the passage's ends, which hold lines around it.
        assert found[i].removed_lines >= 12
        assert all(f"start {i} {j}" in found[i].text for j in range(i)) and f"end {i}" in found[i].text


def test_nothing_else_goes(spark):
    rows = [
        (1, "short\nAll rights reserved.\nmine", None, None), (2, "All rights reserved.\nother", None, None), (3, "", "", ""), (4, None, None, None),
        (5, "\n\n\n", None, None), (6, "\n\n\n", None, None), (7, f"{LONG}", None, None), (7, f"{LONG}", None, None),
        (8, f"{LONG}x\n{LONG}x", None, None), (None, f"{LONG}y", None, None), (None, f"z\n{LONG}y", None, None),
    ]
    found = sorted(((str(r.row.doc_id), r.text, r.removed_lines) for r in run(spark, rows)), key=str)
    assert found == sorted([
        ("1", rows[0][1], 0), ("2", rows[1][1], 0), ("3", "", 0), ("4", None, 0), ("5", "\n\n\n", 0), ("6", "\n\n\n", 0),
        ("7", LONG, 0), ("7", LONG, 0), ("8", f"{LONG}x", 1), ("None", f"{LONG}y", 0), ("None", f"z\n{LONG}y", 0),
    ], key=str)


def test_null_ids_give_way(spark):
    found = {r.row.doc_id: r.text for r in run(spark, [(5, LONG, None, None), (None, f"a\n{LONG}", None, None)])}
    assert found == {5: LONG, None: "a"}


def test_very_long_and_empty(spark):
    text = "\n".join(f"line {i} of a very long text" for i in range(20_000))
    found = run(spark, [(1, text, None, None), (2, text, None, None)])
    assert {r.row.doc_id: (len(r.text), r.removed_lines) for r in found} == {1: (len(text), 0), 2: (0, 20_000)}
    assert run(spark, []) == []


@pytest.mark.parametrize("n_lines", range(2, 11))
def test_short_runs_of_lines_go_whole(spark, n_lines):
    """Passages of 54 to 60 words over 2 to 10 lines between unrelated lines."""
    each = -(-54 // n_lines)
    rows, own = [], {}
    for p in range(6):
        passage = "\n".join(" ".join(f"p{p}l{line}x{i}" for i in range(each)) for line in range(n_lines))
        for copy in range(2):
            i = 10 * copy + p
            above, below = [[f"own {side} {i} {j} of no other text" for j in range(4)] for side in "ab"]
            own[i] = "\n".join(above + below)
            rows.append((i, "\n".join([*above, passage, *below]), None, None))
    found = {r.row.doc_id: r for r in run(spark, rows)}
    for i, text, *_ in rows:
        assert (found[i].text, found[i].removed_lines) == ((text, 0) if i < 10 else (own[i], n_lines))
        assert found[i].removed_words == (0 if i < 10 else each * n_lines)


def test_runs_against_brute_force(spark):
    """Few different lines, so that runs of all kinds repeat, overlap and end beside short lines."""
    rng = random.Random(4)
    lines = [" ".join(f"w{k}x{i}" for i in range(rng.choice([0, 1, 6, 20, 30, 55]))) for k in range(9)]
    rows = [(i, "\n".join(rng.choice(lines) + rng.choice(["", "", "", f" {i}"]) for _ in range(rng.randint(1, 14))), None, None) for i in range(40)]
    split = {i: t.split("\n") for i, t, *_ in rows}

    def places(run):
        return [(i, k) for i, s in split.items() for k in range(len(s) - len(run) + 1) if s[k : k + len(run)] == run]

    gone = {i: set() for i in split}
    for i, s in split.items():
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(len(x.split()) for x in s[a:b]) >= 50 and s[a].split() and s[b - 1].split():
                    first = min(places(s[a:b]))
                    if first != (i, a):
                        # Shortest passages: longer runs consist of them.
                        short = sum(len(x.split()) for x in s[a + 1 : b]) < 50 or sum(len(x.split()) for x in s[a : b - 1]) < 50
                        if short:
                            gone[i] |= set(range(max(a, first[1] + b - a) if first[0] == i else a, b))
    df = spark.createDataFrame(rows, SCHEMA)
    space = Workspace(spark)
    found = {r.row.doc_id: r for r in linededup.without_repeats(df, space, chunk_words=10**6).collect()}
    for i, s in split.items():
        assert found[i].text == "\n".join(x for k, x in enumerate(s) if k not in gone[i]), i
        assert found[i].removed_lines == len(gone[i])
    space.release()
