"""Language by nearest centroid: n-gram vectors, TF-IDF weighted and normalised, against several centroids a language.

A text's letter n-grams (runs of letters, lower case, with their word's ends) are counted in a fixed number of hashed
buckets. Document frequencies come from all learning documents. A language's documents fall into clusters, each with a
centroid and the distance within which its own members lie; a text belongs to the centroid of highest cosine, and is
rejected where it is farther away than that centroid's members are.

Learning passes over the documents once for the frequencies and clusters a sample of bounded size per language; the
centroids, of a size set by languages, clusters and buckets, are shipped to the tasks. Prediction is one pass without a
shuffle over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: n-gram lengths, and hashed buckets of all of them together.
GRAMS = (1, 2, 3)
BUCKETS = 1 << 13
#: Clusters per language, rounds of clustering, learning documents per language that are clustered.
CLUSTERS = 4
ROUNDS = 8
CLUSTERED_ROWS = 400
#: A text is rejected beyond so many times the distance within which nearly all members of its centroid lie.
SLACK = 1.25
#: Letters handled at a time, which bounds the memory a very long text takes.
BLOCK = 1 << 18

UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """The lower-case code point of each letter of the basic plane, 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint32)
    for point in range(1 << 16):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


_LETTERS: list[np.ndarray] = []


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts of the whole text in ``BUCKETS`` buckets; None for a text without letters."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    found = False
    for at in range(0, len(points), BLOCK):
        # Blocks overlap by an n-gram's length less one; the first block has a word's end before it.
        block = points[max(0, at - max(GRAMS) + 1) : at + BLOCK]
        ahead = at - max(0, at - max(GRAMS) + 1)
        letters = _LETTERS[0][np.minimum(block, 0xFFFF)]
        beyond = block > 0xFFFF
        if beyond.any():
            letters[beyond] = [ord(chr(p).lower()[0]) if chr(p).isalpha() else 0 for p in block[beyond]]
        found = found or bool(letters.any())
        # Runs of anything else count as one gap.
        kept = np.concatenate(([True], (letters[1:] != 0) | (letters[:-1] != 0))) if len(letters) else np.zeros(0, bool)
        kept[:ahead] = True
        letters = letters[kept].astype(np.uint64)
        if not at:
            letters, ahead = np.concatenate((np.zeros(1, np.uint64), letters)), 1
        if at + BLOCK >= len(points):
            letters = np.concatenate((letters, np.zeros(1, np.uint64)))
        code = np.zeros(len(letters), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            # Of the n-gram that ends at each place.
            code = np.concatenate((np.zeros(1, np.uint64), code[:-1])) * np.uint64(0x100000001B3) + letters + np.uint64(1)
            if n in GRAMS:
                ends = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS
                inside = letters != 0 if n == 1 else np.concatenate((np.zeros(1, bool), (letters[1:] != 0) | (letters[:-1] != 0)))
                inside[: max(ahead, n - 1)] = False
                total += np.bincount(ends[inside], minlength=BUCKETS)
    return total if found else None


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, one a row, and which texts have letters (others' rows are zero)."""
    rows = np.zeros((len(texts), BUCKETS), np.float32)
    lettered = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        found = counts(text)
        if found is not None:
            weighted = np.sqrt(found) * idf
            size = np.linalg.norm(weighted)
            rows[i] = weighted / size if size > 0 else 0
            lettered[i] = True
    return rows, lettered


def cluster(rows: np.ndarray, clusters: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each one's reach: the cosine distance within which 99% of its members lie."""
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(clusters, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        owner = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[owner == k].sum(axis=0) if (owner == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosines = rows @ centres.T
    owner = np.argmax(cosines, axis=1)
    overall = np.quantile(1 - cosines.max(axis=1), 0.99)
    reach = np.array([np.quantile(1 - cosines[owner == k, k], 0.99) if (owner == k).any() else 0.0 for k in range(len(centres))])
    return centres.astype(np.float32), np.maximum(reach, overall)


@dataclass
class Model:
    idf: np.ndarray
    centres: np.ndarray
    reach: np.ndarray
    langs: list[str]


def fit(docs: DataFrame, clusters: int = CLUSTERS, clustered_rows: int = CLUSTERED_ROWS) -> Model:
    """Learn from the text and lang of ``docs`` (rows whose lang is null or whose text has no letters teach nothing)."""
    spark: SparkSession = docs.sparkSession
    taught = docs.select("text", F.col("lang").cast("string").alias("lang")).filter("lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                found = counts(text.as_py())
                if found is not None:
                    seen += found > 0
                    number += 1
        bucket = np.append(np.nonzero(seen)[0], -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(np.append(seen[bucket[:-1]], number))], names=["bucket", "n"]
        )

    # One row per bucket reaches the driver.
    totals = taught.mapInArrow(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(BUCKETS)
    by_bucket = totals[totals["bucket"] >= 0]
    seen[by_bucket["bucket"].to_numpy(int)] = by_bucket["n"]
    number = totals.loc[totals["bucket"] < 0, "n"].sum()
    idf = (np.log((1 + number) / (1 + seen)) + 0.1).astype(np.float32)

    shares = {r["lang"]: min(1.0, 2.0 * clustered_rows / r["n"]) for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Model(idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0), [])
    chance = F.pmod(F.xxhash64("text", F.lit(21)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    shipped = spark.sparkContext.broadcast(idf)

    def vectorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                rows, lettered = vectors([text.as_py()], shipped.value)
                if lettered[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang.as_py()]), pa.array([rows[0].tobytes()], pa.binary())], names=["lang", "vector"]
                    )

    def clustered(group: pd.DataFrame) -> pd.DataFrame:
        # Copies teach once; the order does not depend on how rows arrive.
        unique = sorted(set(group["vector"]))
        unique = unique[:: -(-len(unique) // clustered_rows)]
        centres, reach = cluster(np.stack([np.frombuffer(v, np.float32) for v in unique]), clusters)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "reach": reach})

    sample = taught.filter(chance < share).mapInArrow(vectorised, "lang string, vector binary")
    found = sample.groupBy("lang").applyInPandas(clustered, "lang string, centre binary, reach double").toPandas()
    found = found.sort_values(["lang", "reach", "centre"])
    centres = np.stack([np.frombuffer(c, np.float32) for c in found["centre"]]) if len(found) else np.zeros((0, BUCKETS), np.float32)
    return Model(idf, centres, found["reach"].to_numpy(float), list(found["lang"]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (every input column), ``nearest``, ``lang_pred``, ``score``, ``rejected`` of every document's whole text.

    ``nearest`` is the language of the nearest centroid; ``rejected`` says that the text lies beyond its reach, and
    ``lang_pred`` is then ``und``. A null text or one without a letter is ``und`` with score 0 and rejected, as is every
    text if nothing was learnt. ``score`` is the cosine, from 0 to 1. Equal cosines go to the language first in order of
    name. Rows are kept one for one, repeated ones alike; an empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, nearest string, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = shipped.value
        for batch in batches:
            texts, nearest, score, rejected = batch.column("text"), [], [], []
            for at in range(0, len(texts), 64):
                unit, lettered = vectors(texts.slice(at, 64).to_pylist(), known.idf)
                if not len(known.langs):
                    lettered[:] = False
                cosines = unit @ known.centres.T if len(known.langs) else np.zeros((len(unit), 1))
                best = np.argmax(cosines, axis=1)
                for i, k in enumerate(best):
                    cosine = float(cosines[i, k])
                    nearest.append(known.langs[k] if lettered[i] else UNKNOWN)
                    score.append(min(1.0, max(0.0, cosine)) if lettered[i] else 0.0)
                    rejected.append(not lettered[i] or 1 - cosine > SLACK * known.reach[k])
            label = [UNKNOWN if r else n for n, r in zip(nearest, rejected)]
            arrays = [pa.array(nearest, pa.string()), pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=["row", "nearest", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)
