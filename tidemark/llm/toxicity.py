"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words and the beginnings of longer words. A token's score is its log-odds between toxic and other learning
documents under a Dirichlet prior proportional to its frequency in both, taken for what it is only where it is
significant; all other words score a little below zero. A linear scan finds every maximal segment of a text, that is
every passage which no longer or shorter one around it beats, and keeps those too good to be chance.

The best scores by chance follow an extreme-value distribution whose decay is solved from the scores' distribution in
non-toxic text. Each segment is measured against it for the text's length, the segments are added up on that scale, and
a one-variable regression turns the sum into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import logistic
from tidemark.llm.common import labelled, sampled
from tidemark.workspace import Workspace

#: About so many labelled documents are learnt from.
LABELLED_ROWS = 100_000
#: Beginnings of words that count as tokens, beside the whole words, where the word is longer.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Weight of the prior in tokens, and the most of all tokens it may be; log-odds and their significance from which a
#: token scores, and what is taken off them.
PRIOR = 5_000.0
PRIOR_SHARE = 0.05
LEAST_ODDS = 3.0
SIGNIFICANCE = 3.0
MARGIN = 1.0
#: Tokens a model may hold, those of most significance.
MODEL_TOKENS = 200_000
#: What any other word scores, and the chance level of a significant passage.
NEUTRAL = -0.25
CHANCE = 0.01

_WORD = re.compile(r"[^\W\d_]+")


def tokens_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]


def segments(scores: Iterable[tuple[int, float]], neutral: float, size: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence of ``size`` tokens, in one linear scan.

    ``scores`` gives position and score of the tokens that do not score ``neutral``, in order. Candidates are kept with
    the sums before their first and at their last token; a new one that another candidate's continuation beats is
    merged with it.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at the end, candidate to the left
    total, at = 0.0, 0
    for position, score in scores:
        total += neutral * (position - at)
        at = position + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, left, right = position, before, total
        j = len(kept) - 1
        while True:
            # The nearest candidate whose sum before it is less; the others between need not be looked at again.
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((first, position + 1, left, right, j))
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
            j = len(kept) - 1
    return [(a, b, r - l) for a, b, l, r, _ in kept]


@dataclass
class Model:
    """Scores of the tokens that have one, the extreme-value decay and size, the final regression."""

    odds: dict[str, float]
    decay: float = 1.0
    size: float = 0.1
    slope: float = 0.0
    shift: float = -4.0

    def word(self, word: str) -> float | None:
        found = [self.odds[t] for t in tokens_of(word) if t in self.odds]
        return max(found) if found else None

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and every maximal segment with its score on the extreme-value scale, by word positions."""
        words = _WORD.findall((text or "").lower())
        if not self.odds:
            return len(words), []
        scored = {w: self.word(w) for w in set(words)}
        scored = {w: s for w, s in scored.items() if s is not None}
        found = segments(((i, scored[w]) for i, w in enumerate(words) if w in scored), NEUTRAL, len(words)) if scored else []
        return len(words), [(a, b, self.decay * s - self._floor(len(words))) for a, b, s in found]

    def _floor(self, n_words: int) -> float:
        """What so many words reach by chance; no text is so short that it gains by it."""
        return math.log(max(1.0, self.size * n_words))

    def total(self, n_words: int, found: list[tuple[int, int, float]]) -> float:
        """All segments together on the extreme-value scale; that of an empty segment if there are none."""
        nothing = -self._floor(n_words) - 1.0
        return float(np.logaddexp.reduce([nothing, *[s for _, _, s in found]]))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        n_words, found = self.passages(text)
        p = float(logistic.probability(np.array([self.slope * self.total(n_words, found) + self.shift]))[0])
        # By chance so good a segment comes up in a text of this length with this probability.
        return p, [(a, b, s) for a, b, s in found if -math.expm1(-math.exp(-min(s, 700))) <= CHANCE]


def _decay(scores: np.ndarray, chances: np.ndarray) -> float:
    """The positive solution of: expected exp(decay * score) = 1, by halving."""
    value = lambda x: float((chances * np.expm1(np.minimum(x * scores, 600))).sum())
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def fit(docs: DataFrame, labels: DataFrame, space: Workspace, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Learn from the texts of ``docs`` that ``labels`` (doc_id, toxic) covers.

    Token counts are summed in Spark; only tokens that score, and one number per learning document, reach the driver.
    Without labels of both kinds nothing is learnt and every text scores alike.
    """
    spark: SparkSession = docs.sparkSession
    known = sampled(labelled(labels, "toxic"), "doc_id", labelled_rows)
    # About ``labelled_rows`` rows of two numbers: their number, and so their size, is bounded by the parameter.
    taught = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            both: dict[str, list[int]] = {"": [0, 0]}
            # A token counts once a document, so that a document which repeats a word counts no more than another.
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                both[""][label] += len(words)
                counts[label].update({token for word in words for token in tokens_of(word)})
            for label, tokens in counts.items():
                for token, n in tokens.items():
                    both.setdefault(token, [0, 0])[label] = n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(both)), pa.array([v[1] for v in both.values()]), pa.array([v[0] for v in both.values()])],
                names=["token", "toxic", "other"],
            )

    # A token seen in one toxic document alone can not become significant; only the others are looked at twice.
    totals = taught.mapInArrow(counted, "token string, toxic bigint, other bigint").groupBy("token").agg(
        F.sum("toxic").cast("double").alias("toxic"), F.sum("other").cast("double").alias("other")
    ).filter("toxic >= 2 or token = ''")
    totals = space.keep(totals, "tokens")
    # The row of no token holds the numbers of words.
    n_toxic, n_other = totals.filter("token = ''").select("toxic", "other").first() or (0.0, 0.0)
    if not n_toxic or not n_other:
        return Model({})
    share = (F.col("toxic") + F.col("other")) / F.lit(n_toxic + n_other)
    prior = min(PRIOR, PRIOR_SHARE * (n_toxic + n_other))
    a, b = F.col("toxic") + prior * share, F.col("other") + prior * share
    odds = F.log(a / (n_toxic + prior - a)) - F.log(b / (n_other + prior - b))
    scoring = (
        totals.filter((F.col("token") != "") & (a < n_toxic + prior) & (b < n_other + prior))
        .select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"), (b / (n_other + prior)).alias("chance"))
        .filter((F.col("odds") > LEAST_ODDS) & (F.col("z") >= SIGNIFICANCE))
        .orderBy(F.col("z").desc(), "token").limit(MODEL_TOKENS).toPandas()
    )
    if not len(scoring):
        return Model({})
    gains = (scoring["odds"] - MARGIN).to_numpy()
    model = Model(dict(zip(scoring["token"], gains.tolist())))
    chances = scoring["chance"].to_numpy()
    rest = max(0.0, 1 - float(chances.sum()))
    model.decay = _decay(np.append(gains, NEUTRAL), np.append(chances, rest))
    shipped = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [shipped.value.total(*shipped.value.passages(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(total, pa.float64())], names=["label", "x"])

    values = taught.mapInArrow(measured, "label int, x double").toPandas()
    beta = logistic.fit(values[["x"]].to_numpy(), values["label"].to_numpy(float), ridge=0.01)
    model.slope, model.shift = max(0.0, float(beta[0])), float(beta[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (every input column), ``score`` (0 to 1), ``passages`` (first and end word, score) of every document.

    ``passages`` are the significant ones, in order, with ``first`` from 0 and ``end`` behind the last word. Null and
    empty texts have none, and the score of a text without any sign. Rows are kept one for one, repeated ones alike; an
    empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<first:int,end:int,score:double>>"
    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double, passages {kind}"
    item = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.score(t.as_py()) for t in batch.column("text")]
            passages = [[{"first": a, "end": b, "score": s} for a, b, s in p] for _, p in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([p for p, _ in found], pa.float64()), pa.array(passages, item)],
                names=["row", "score", "passages"],
            )

    return rows.mapInArrow(run, schema)
