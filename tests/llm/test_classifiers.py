"""Quality, language and toxicity: planted signs are found in held-out rows, odd rows have defined results."""

import random

import numpy as np
import pytest

from tidemark.llm import language, logistic, quality, toxicity
from tidemark.workspace import Workspace

SYLLABLES = {"aa": "ka lo mi tu re sa".split(), "bb": "wen dok brü schl fen orst".split(), "cc": "ção nha que dos es ia".split()}
ODD = [(9001, None, None), (9001, None, None), (9002, "", ""), (9003, "123 !!! 45", "x"), (None, "a", None), (9004, "x " * 60_000, "y")]


def prose(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rng():
    return random.Random(4)


def test_language(spark, rng):
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    docs = spark.createDataFrame([(*r, "n") for r in rows + ODD], "doc_id bigint, text string, lang string, score string")
    model = language.fit(docs.filter("doc_id < 60"))
    assert sorted(set(model.langs)) == sorted(SYLLABLES)
    found = language.identify(docs, model).collect()
    assert len(found) == len(rows) + len(ODD)
    truth = {i: lang for i, _, lang in rows if i >= 60}
    held = [r for r in found if r.row.doc_id in truth]
    assert np.mean([r.nearest == truth[r.row.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in found)
    odd = {r.row.doc_id: (r.nearest, r.score, r.rejected) for r in found if r.row.doc_id in (9001, 9002, 9003)}
    assert set(odd.values()) == {("und", 0.0, True)}
    foreign = language.identify(spark.createDataFrame([(1, "ωμέγα ψυχή ξένος")], "doc_id bigint, text string"), model).first()
    assert foreign.rejected and foreign.lang_pred == "und" and foreign.nearest in SYLLABLES
    nothing = language.fit(docs.limit(0))
    assert {r.nearest for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = "Ärger über 12 Öfen, naïve  Ωμέγα 𝒳y; tail" * 9
    whole = language.counts(text)
    # Letters of the text: each is one gram of its own.
    assert whole.sum() > sum(c.isalpha() for c in text)
    monkeypatch.setattr(language, "BLOCK", 1 << 30)
    assert (language.counts(text) == whole).all()
    assert language.counts(None) is None and language.counts("12 !") is None


def test_quality(spark, rng):
    good = [(i, prose(rng, "aa", rng.randint(20, 80)), f"s{i % 7}") for i in range(200)]
    bad = [(500 + i, " ".join(f"{w.upper()}!!" for w in prose(rng, "aa").split()) if i % 4 < 2 else "spam spam spam " * 30, f"s{i % 7}") for i in range(80)]
    rows = good + bad + [(i, t, s) for i, t, s in ODD]
    docs = spark.createDataFrame([(i, t, "aa", s, len(t or ""), "k") for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")
    labels = spark.createDataFrame(
        [(i, 1) for i, *_ in good[::2]] + [(i, 0) for i, *_ in bad[::2]] + [(None, 1), (0, 1), (2, None)], "doc_id bigint, quality int"
    )
    scored = quality.score(docs, quality.fit(docs, labels, Workspace(spark))).collect()
    assert len(scored) == len(rows)
    verdict = {r.row.doc_id: r.score >= 0.5 for r in scored}
    assert np.mean([verdict[i] for i, *_ in good[1::2]]) > 0.97 and np.mean([verdict[i] for i, *_ in bad[1::2]]) < 0.05
    left = quality.accepted(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, v in verdict.items() if v}
    # Without labels nothing is rejected; with one class its share is the score.
    assert quality.accepted(docs, labels.limit(0)).count() == len(rows)
    assert quality.accepted(docs, labels.filter("quality = 1")).count() == len(rows)
    assert quality.accepted(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("labels, real, noise, idle, least", [(80, 0.4, 0.3, 0, 0.7), (24, 0.6, 0.5, 8, 0.62)])
def test_views_teach_each_other(labels, real, noise, idle, least):
    """Labels of which one view can make little; it learns the classes from the other's pseudo-labels."""
    rng = np.random.default_rng(2)
    y, pool_y = np.array([0.0, 1.0] * (labels // 2)), np.array([0.0, 1.0] * 400)
    strong = lambda labels: labels[:, None] * 4 + rng.normal(0, 0.5, (len(labels), 2))
    weak = lambda labels: np.hstack([labels[:, None] * real + rng.normal(0, noise, (len(labels), 2)), rng.normal(0, 1, (len(labels), idle))])
    held = np.arange(labels) % 4 > 1
    x, others = (strong(y), weak(y)), {"text": strong(pool_y), "metadata": weak(pool_y)}
    nobody = {name: v[:0] for name, v in others.items()}
    taught = quality.co_train(*x, y, held, lambda turn: turn.sums(others))
    alone = quality.co_train(*x, y, held, lambda turn: turn.sums(nobody))
    fresh = np.array([0.0, 1.0] * 2000)
    seen = weak(fresh)
    right = lambda m: np.mean((m.metadata.margin(seen) > np.median(m.metadata.margin(seen))) == (fresh > 0))
    assert right(taught) >= right(alone) - 0.01 and right(taught) > least


def test_newton_sums_of_parts_give_the_regression():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 2, (400, 3))
    y = (x[:, 0] + rng.normal(0, 1, 400) > 0).astype(float)
    view = quality.View(x.mean(axis=0), x.std(axis=0), np.zeros(4))
    for _ in range(20):
        view.step(sum(view.sums(x[k::7], y[k::7]) for k in range(7)))
    assert np.allclose(view.beta, logistic.fit(view.standard(x), y), atol=1e-6)


def test_every_unlabelled_row_teaches(spark, monkeypatch):
    """The sums that Spark makes equal those over all rows at once; one id of many rows and copies of a text included."""
    rng = random.Random(6)
    rows = [(i, prose(rng, "aa"), f"s{i % 5}", 1) for i in range(60)] + [(100 + i, "SPAM!! " * 30, f"s{i % 5}", 0) for i in range(60)]
    hot = [(7, prose(rng, "aa", 10), "hot") for _ in range(300)] + [(7, "same text", "hot")] * 300
    free = [(None if i % 9 == 0 else 1000 + i, prose(rng, "bb", 30), f"s{i % 3}") for i in range(500)]
    docs = spark.createDataFrame([(i, t, "aa", s, len(t)) for i, t, s, *_ in [*rows, *hot, *free]], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(6)
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows if i != 7] + [(7, 1)], "doc_id bigint, quality int")
    seen = []
    learn = quality.co_train

    def watched(text, metadata, y, held, pool, **more):
        def both(turn):
            found = pool(turn)
            x = {"text": np.array([quality.text_features(t) for _, t, _ in free], np.float32).astype(float),
                 "metadata": np.array([quality.metadata_features(s, "aa", len(t)) for _, t, s in free], np.float32).astype(float)}
            seen.append(np.allclose(found, turn.sums(x), rtol=1e-6, atol=1e-6))
            return found

        seen.append(len(y))
        return learn(text, metadata, y, held, both, **more)

    monkeypatch.setattr(quality, "co_train", watched)
    quality.fit(docs, labels, Workspace(spark), labelled_rows=200)
    assert seen[0] <= 300 and seen[1:] == [True] * quality.ROUNDS * quality.STEPS


def plain_segments(scores):
    """All maximal scoring subsequences by their definition: the best one, then both sides alike."""
    def best(a, b):
        found, top = None, 0.0
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > top + 1e-12:
                    found, top = (i, j + 1), total
        return [*best(a, found[0]), (*found, top), *best(found[1], b)] if found else []

    return best(0, len(scores))


def test_segments_against_their_definition():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-0.25, -0.25, -0.25, 1.1, 3.7, 0.13]) for _ in range(rng.randint(0, 25))]
        found = toxicity.segments([(i, s) for i, s in enumerate(scores) if s != -0.25], -0.25, len(scores))
        assert [(a, b, round(s, 6)) for a, b, s in found] == [(a, b, round(s, 6)) for a, b, s in plain_segments(scores)]


def test_toxicity(spark, rng):
    toxic = ["zorkwit", "grumfel", "blastik"]
    rows = []
    for i in range(500):
        words = prose(rng, "aa", 60).split()
        if i % 5 == 0:
            for at in rng.sample(range(len(words)), 3):
                words.insert(at, rng.choice(toxic))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "p") for i, t in rows + [(i, t) for i, t, _ in ODD]], "doc_id bigint, text string, passages string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    space = Workspace(spark)
    model = toxicity.fit(docs, labels, space)
    assert set(toxic) <= set(model.odds)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.row.doc_id is not None and 300 <= r.row.doc_id < 500]
    assert np.mean([(r.score >= 0.5) == (r.row.doc_id % 5 == 0) for r in held]) > 0.97
    spans = [(set(r.row.text.lower().replace(".", "").split()[p.first : p.end])) for r in held for p in r.passages]
    assert np.mean([bool(words & set(toxic)) for words in spans]) > 0.9
    # A lone sign can make a document likely toxic without being beyond chance as a passage.
    assert np.mean([bool(r.passages) for r in held if r.row.doc_id % 5 == 0]) > 0.5
    assert all(r.score < 0.5 and not r.passages for r in found if r.row.doc_id in (9001, 9002, 9003, 9004))
    nothing = toxicity.fit(docs, labels.limit(0), space)
    assert len({r.score for r in toxicity.score(docs, nothing).collect()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    space.release()
