import re
from collections import defaultdict

import pytest

from tidemark.llm import decontaminate
from tidemark.workspace import Workspace


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(decontaminate.WORD, lowered)


def plain(docs, items, span=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - min(span, len(w)) + 1) if w else 0):
            windows[tuple(w[i : i + min(span, len(w))])] |= {str(item)} if item is not None else set()
    found = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for window, names in windows.items():
            n = len(window)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    ids |= names
        found.append((str(doc), len(w), sorted(hit), sorted(ids)))
    return sorted(found, key=str)


def run(spark, docs, items, **parameters):
    space = Workspace(spark)
    d = spark.createDataFrame([(a, b, "x", "y") for a, b in docs], "doc_id bigint, text string, words string, met string")
    b = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id bigint, text string, hash string")
    rows = decontaminate.contamination(d, b, space, **parameters).collect()
    space.release()
    return sorted(((str(r.row.doc_id), r.n_words, list(r.hit), list(r.item_ids)) for r in rows), key=str)


ALPHA = " ".join(f"a{i}" for i in range(30))
BETA = " ".join(["tick tock"] * 12)


@pytest.mark.parametrize("span,gram", [(10, 5), (10, 1), (10, 10), (4, 2)])
def test_equals_brute_force(spark, span, gram):
    a = ALPHA.split()
    docs = [
        (1, " ".join(a)), (2, "x " + " ".join(a[3:12]) + " y"), (3, "x " + " ".join(a[3:13]) + " y"), (4, "Start, " + " ".join(a[20:]).upper() + "!"),
        (5, " ".join(a[:10] + ["mid"] + a[10:22] + a[5:16])), (6, BETA + " x " + BETA), (7, None), (8, ""), (9, "... ;;"), (1, " ".join(a)),
        (None, " ".join(a[8:25])), (11, "one two"), (12, "zero one two three one two"), (13, "é É naïve " + "solo " * 3), (14, "tick " * 40),
        (15, "one\x00two\x7f" + "".join(map(chr, range(256))) + "\u3000one two"),
    ]
    items = [(1, ALPHA), (2, BETA), (3, "one two"), (4, "One, two."), (5, None), (6, "!!"), (7, "solo"), (None, "zero one"), (10, ALPHA + " more"), (8, "a1 a2 a3 a4 a5 a6 a7 a8 a9")]
    assert run(spark, docs, items, span=span, gram=gram) == plain(docs, items, span)


def test_empty_tables(spark):
    assert run(spark, [], [(1, ALPHA)]) == []
    assert run(spark, [(1, ALPHA)], []) == [("1", 30, [], [])]


def test_stage_leaves_clean_rows(spark):
    space = Workspace(spark)
    docs = spark.createDataFrame([(1, ALPHA, 5), (2, "clean words", 6), (3, None, 7), (None, "also", 8)], "doc_id bigint, text string, row int")
    bench = spark.createDataFrame([(1, ALPHA)], "item_id bigint, text string")
    left = decontaminate.without_benchmark(docs, bench, space)
    assert left.columns == docs.columns and sorted(r.row for r in left.collect()) == [6, 7, 8]
    space.release()
