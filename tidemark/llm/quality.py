"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

Both start from the same labelled documents. In every round each view scores all documents without a label, and those
of which it is sure teach the other view in that round; their classes weigh no more than the labelled documents do. The
regressions are fitted by Newton steps whose sums Spark makes over the whole table, per class, from narrow stored features: what reaches
the driver is as large as the number of features squared, and no unlabelled row is sampled or left out. Each view is
then calibrated on labelled documents kept apart, a last regression weighs the calibrated views against each other, and
all documents are scored in one pass without a shuffle.

The text's features are read from the whole text. Only the labelled rows that are learnt from are bounded in number, by a parameter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import logistic
from tidemark.llm.common import labelled, sampled
from tidemark.workspace import Workspace

#: About so many labelled documents are learnt from.
LABELLED_ROWS = 20_000
#: Rounds of exchange, Newton steps in each, and the probability that a pseudo-label needs.
ROUNDS = 3
STEPS = 2
CONFIDENCE = 0.97
#: Documents scoring less are rejected.
THRESHOLD = 0.5
#: Buckets for source and for language.
SOURCES = 64
LANGUAGES = 16

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_CLOSING = np.isin(_BYTES, [33, 44, 46, 58, 59, 63])
_SYMBOL = (_BYTES < 128) & ~(_UPPER | _LOWER | _DIGIT | _SPACE | _CLOSING)


def text_features(text: str | None) -> list[float]:
    """Shares and means over the whole text; null counts as empty."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    histogram = np.bincount(raw, minlength=256)
    words = (text or "").split()
    n_bytes, n_words = max(1, len(raw)), max(1, len(words))
    letters = max(1, int(histogram[_UPPER].sum() + histogram[_LOWER].sum() + histogram[128:].sum()))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    n_lines = int(histogram[10]) + 1
    return [
        math.log1p(len(words)),
        len(counts) / n_words ** 0.8,
        len(counts) / n_words,
        top / n_words,
        sum(map(eq, words, words[1:])) / n_words,
        histogram[_UPPER].sum() / letters,
        histogram[_SYMBOL].sum() / n_bytes,
        histogram[_SYMBOL].sum() / n_words,
        histogram[_DIGIT].sum() / n_bytes,
        histogram[_CLOSING].sum() / n_words,
        histogram[33] / n_words,
        histogram[124] / n_words,
        histogram[46] / n_words,
        letters / n_bytes,
        histogram[_SPACE].sum() / n_bytes,
        math.log1p(n_words / n_lines),
        n_bytes / n_words,
        float(not words),
    ]


def metadata_features(source: str | None, lang: str | None, n_chars: float | None) -> list[float]:
    """Source and language as hashed indicators, the stated length; null is a value of its own."""
    found = [0.0] * (SOURCES + LANGUAGES + 2)
    found[zlib.crc32(repr(source).encode("utf-8", "surrogatepass")) % SOURCES] = 1.0
    found[SOURCES + zlib.crc32(repr(lang).encode("utf-8", "surrogatepass")) % LANGUAGES] = 1.0
    found[-2] = math.log1p(max(0.0, n_chars)) if n_chars is not None else 0.0
    found[-1] = float(n_chars is None)
    return found


@dataclass
class View:
    """A standardized regression and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray) -> View:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        return cls(mean, scale, logistic.fit((x - mean) / scale, y))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.shift = 1.0, 0.0
        beta = logistic.fit(self.margin(x)[:, None], y, ridge=0.1)
        self.slope, self.shift = max(0.0, float(beta[0])), float(beta[1])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * logistic.margin(self.standard(x), self.beta) + self.shift, -15, 15)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What a Newton step needs of these rows: their number, gradient and curvature, in one array."""
        full = logistic.with_constant(self.standard(x))
        p = logistic.probability(full @ self.beta)
        curvature = (full * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ full
        return np.concatenate([[len(y)], full.T @ (p - y), curvature.ravel()])

    def step(self, sums: np.ndarray, ridge: float = 1.0) -> None:
        """Move by one Newton step, no further than a standardized unit or five."""
        size = len(self.beta)
        penalty = np.full(size, ridge)
        penalty[-1] = 1e-6
        gradient = sums[1:size + 1] + penalty * self.beta
        move = np.linalg.solve(sums[size + 1:].reshape(size, size) + np.diag(penalty), gradient)
        self.beta = self.beta - move * min(1.0, 5.0 / max(float(np.abs(move).max()), 1e-12))


@dataclass
class Model:
    """Both views and how they are weighed; without views every document has the score ``base``."""

    base: float
    text: View | None = None
    metadata: View | None = None
    weights: np.ndarray | None = None

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            flat = np.full(len(text), self.base)
            return flat, flat, flat
        a, b = self.text.margin(text), self.metadata.margin(metadata)
        both = logistic.margin(np.stack([a, b], axis=1), self.weights)
        return logistic.probability(a), logistic.probability(b), logistic.probability(both)


@dataclass
class Turn:
    """Within a round: the views as they learn, and as they stood when it began, which is how they teach."""

    learn: dict[str, View]
    teach: dict[str, View]

    def sums(self, x: dict[str, np.ndarray], confidence: float = CONFIDENCE) -> np.ndarray:
        """Of rows without label: for each view, and there for each class, the sums of those that the other view is sure of."""
        out = []
        for name, other in (("text", "metadata"), ("metadata", "text")):
            p = logistic.probability(self.teach[other].margin(x[other]))
            for label, sure in ((0.0, p <= 1 - confidence), (1.0, p >= confidence)):
                out.append(self.learn[name].sums(x[name][sure], np.full(int(sure.sum()), label)))
        return np.concatenate(out)


def co_train(
    text: np.ndarray, metadata: np.ndarray, y: np.ndarray, held: np.ndarray, pool: Callable[[Turn], np.ndarray],
    rounds: int = ROUNDS, steps: int = STEPS,
) -> Model:
    """Fit both views. ``held`` marks labelled rows that only calibrate; ``y`` is 0 or 1.

    ``pool`` gives ``Turn.sums`` over all rows without label.
    """
    base = float(y.mean()) if len(y) else 1.0
    held = held if 0 < y[held].sum() < held.sum() else np.zeros(len(y), bool)
    fit_y, check = y[~held], held if held.any() else ~held
    if not 0 < fit_y.sum() < len(fit_y):
        return Model(base)
    sides = {"text": text, "metadata": metadata}
    views = {name: View.fitted(x[~held], fit_y) for name, x in sides.items()}
    most = np.array([len(fit_y) - fit_y.sum(), fit_y.sum()])
    for _ in range(rounds):
        for name, x in sides.items():
            views[name].calibrate(x[check], y[check])
        # Who is sure of what holds for the round; the learners move within it.
        teachers = {name: replace(view) for name, view in views.items()}
        for _ in range(steps):
            found = pool(Turn(views, teachers))
            at = 0
            for name, x in sides.items():
                size = len(views[name].beta)
                width = 1 + size + size * size
                total = views[name].sums(x[~held], fit_y)
                for label in (0, 1):
                    part, at = found[at:at + width], at + width
                    # Pseudo-labels of a class weigh as much as its labelled rows at most.
                    total = total + part * min(1.0, most[label] / max(part[0], 1.0))
                views[name].step(total)
    for name, x in sides.items():
        views[name].calibrate(x[check], y[check])
    margins = np.stack([views["text"].margin(text[check]), views["metadata"].margin(metadata[check])], axis=1)
    return Model(base, views["text"], views["metadata"], logistic.fit(margins, y[check], ridge=0.1))


def _features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and both views' features, from columns ``text``, ``source``, ``lang``, ``n_chars``."""
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, metadata = _views(batch)
            arrays = [pa.array([row.tobytes() for row in v.astype(np.float32)], pa.binary()) for v in (text, metadata)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays], names=[*keep, "text_x", "metadata_x"])

    return rows.mapInArrow(run, f"{kept}, text_x binary, metadata_x binary")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(t.as_py()) for t in batch.column("text")], np.float32).astype(float)
    others = zip(*[batch.column(c) for c in ("source", "lang", "n_chars")])
    metadata = np.array([metadata_features(s.as_py(), g.as_py(), n.as_py()) for s, g, n in others], np.float32).astype(float)
    return text, metadata


def _inputs(docs: DataFrame) -> list:
    return [F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, space: Workspace, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, quality) and from all other rows of ``docs``, null ids and repeated rows included.

    Of the labelled rows about ``labelled_rows`` different ones reach the driver, as features. A label counts for every
    different row of its doc_id.
    """
    known = labelled(labels, "quality")
    featured = space.keep(_features(docs.select("doc_id", *_inputs(docs)), ["doc_id"]), "features")
    taught = featured.join(known, "doc_id").distinct().withColumn("hash", F.xxhash64("doc_id", "text_x", "metadata_x"))
    ours = sampled(taught, "hash", labelled_rows).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0)
    mine = ours.orderBy("doc_id", "hash").toPandas()
    n = {"text": len(text_features("")), "metadata": SOURCES + LANGUAGES + 2}
    # Null ids have no label and stay.
    others = space.keep(featured.join(known, "doc_id", "left_anti").select("text_x", "metadata_x"), "unlabelled")

    def table(values, name: str) -> np.ndarray:
        return np.frombuffer(b"".join(values), np.float32).reshape(-1, n[name]).astype(float)

    def pool(turn: Turn) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                x = {name: table(batch.column(f"{name}_x").to_pylist(), name) for name in n}
                total = total + turn.sums(x)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

        summed = others.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "value"))
        found = np.zeros(sum(2 * (1 + (k + 1) + (k + 1) ** 2) for k in n.values()))
        for row in summed.groupBy("at").agg(F.sum("value").alias("total")).toLocalIterator():
            found[row["at"]] = row["total"]
        return found

    return co_train(
        table(mine["text_x"], "text"), table(mine["metadata_x"], "metadata"), mine["label"].to_numpy(float),
        mine["held"].to_numpy(bool), pool,
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (every input column), ``text_score``, ``metadata_score``, ``score`` (each from 0 to 1) of every document.

    Null and empty texts have features of their own; null source, language or length are values like others. Rows are
    kept one for one, in any number; repeated rows score alike, an empty table gives no rows, texts of any length are read
    whole, and further columns may have any names. Labels that are missing, or all of one class, give
    every document that class's share as its score (1 without labels), so nothing is rejected for want of labels.
    """
    spark: SparkSession = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), *_inputs(docs))
    names = ["text_score", "metadata_score", "score"]
    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shipped.value.scores(*_views(batch))
                yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, found)], names=["row", *names])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score is below ``threshold``; columns as they are."""
    return score(docs, fit(docs, labels, Workspace(docs.sparkSession))).filter(F.col("score") >= threshold).select("row.*")
