"""Repeated spans of words across documents, by compaction of a de Bruijn graph of word windows.

An edge is a window of ``width`` words, a node the ``width - 1`` words that two neighbouring windows share. Only edges that
occur in two different texts are kept. Nodes with one such edge in and one out do not branch; edges joined at them form
paths, which are compacted twice: runs of neighbouring places of one source text by one ordered pass over them, then these
runs across sources by doubling joins. A path's edges know their source, the first place where the window occurs, so a
document's walk along a path is one span beside a span of the source; both are cut out of their texts by their
coordinates and compared by a strong digest. Where hashes of different windows met, the windows concerned are told apart
one by one by the same digests.

What travels is kept small. Whole copies are found by a digest first and one text stands for them. Every window holds the
least hash of its short word runs; such anchors, a twentieth of the places, tell which texts can share a window at
all, and only those texts and only windows with a shared anchor enter the graph. An edge occurrence is three numbers, and
equal ones are combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import hot_join, numbered, packed
from tidemark.workspace import Workspace

#: Words of a window.
WIDTH = 50
#: Words of the runs whose least hash is a window's anchor.
ANCHOR = 16
#: Bytes of a text that are taken apart at once, and edges or spans that a row or batch carries at most.
BLOCK = 1 << 20
ROWS = 1 << 15
SPANS = 1000
#: The rank of a row without doc_id: after all others.
LAST = (1 << 63) - 1
_SEED = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            size = max(size, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b)])) for b in self.bases)
        return self.up[:size], self.down[:size]


_BYTES, _WORDS = _Powers(0xD6E8FEB86659FD93), _Powers(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and where they end."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, the text taken apart in blocks that end between words."""
    data, found, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        block = data[at:end]
        begins, ends = _places(block)
        up, down = _BYTES.of(len(block) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((block.astype(np.uint64) + np.uint64(_SEED)) * up[:len(block)], dtype=np.uint64)])
        found.append(_mixed((sums[ends] - sums[begins]) * down[begins]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.of(len(words) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:len(words)], dtype=np.uint64)])
    return _mixed((sums[width:] - sums[:-width]) * down[:len(words) - width + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def anchors(words: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window: the least hash of its runs of ``ANCHOR`` words (of all words in a narrower window)."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    short = min(ANCHOR, width)
    return _least(run_hashes(words, short), width - short + 1)


def _keys(text: Column) -> list[Column]:
    """120 bits of a text's SHA-256 as two numbers."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint").alias(name) for at, name in ((1, "k1"), (16, "k2"))]


def _rank(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(LAST))


def _scanned(docs: DataFrame, width: int) -> DataFrame:
    """Per row: ``doc_id``, ``rank``, ``k1``, ``k2``, ``n_words``, ``whole`` (digest of all words), ``anchors`` (each once)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _rank(F.col("doc_id")).alias("rank"), *_keys(F.col("text")), "text")
    schema = f"doc_id {kind}, rank bigint, k1 bigint, k2 bigint, n_words bigint, whole string, anchors array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole, found = [], [], []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                words = word_hashes(data)
                n.append(len(words))
                whole.append(hashlib.sha256(b" ".join(data.split())).hexdigest())
                found.append(np.unique(anchors(words, width)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "rank", "k1", "k2")), pa.array(n, pa.int64()), pa.array(whole, pa.string()),
                 pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "rank", "k1", "k2", "n_words", "whole", "anchors"],
            )

    return rows.mapInArrow(run, schema)


def _candidates(docs: DataFrame, reps: DataFrame, space: Workspace) -> DataFrame:
    """``t``, ``rank``, ``k1``, ``k2``, ``text``, ``shared``: the texts that share an anchor, numbered by rank, with those anchors."""
    held = reps.select("k1", "k2", "rank", F.explode("anchors").alias("anchor"))
    shared = space.keep(held.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    met = hot_join(held, shared.select("anchor"), ["anchor"], ["k1", "k2"], shared)
    met = met.groupBy("k1", "k2", "rank").agg(F.collect_list("anchor").alias("shared"))
    met = numbered(met.withColumn("all", F.lit(0)), "all", ["rank", "k1", "k2"], space, "candidates")
    texts = docs.select(_rank(F.col("doc_id")).alias("rank"), *_keys(F.col("text")), "text")
    joined = texts.join(met.select("rank", "k1", "k2", "shared", F.col("place").alias("t")), ["rank", "k1", "k2"])
    return space.keep(joined, "texts")


def _edges(texts: DataFrame, width: int, bits: int, mask: int) -> DataFrame:
    """Occurrences ``left``, ``right`` (nodes) and ``place`` (text number and word, packed) of windows with a shared anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, text, shared in zip(batch.column("t").to_pylist(), batch.column("text"), batch.column("shared")):
                words = word_hashes((text.as_py() or "").encode())
                known = np.sort(shared.values.to_numpy().view(np.uint64))
                least = anchors(words, width)
                near = np.searchsorted(known, least).clip(max=max(len(known) - 1, 0))
                at = np.flatnonzero(known[near] == least) if len(known) else np.zeros(0, np.int64)
                nodes = (run_hashes(words, width - 1) & np.uint64(mask)).view(np.int64)
                for k in range(0, len(at), ROWS):
                    part = at[k:k + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[part]), pa.array(nodes[part + 1]), pa.array((t << bits) + part)], names=["left", "right", "place"]
                    )

    return texts.select("t", "text", "shared").mapInArrow(run, "left bigint, right bigint, place bigint")


def compacted(occurrences: DataFrame, bits: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """The repeated edges ``left``, ``right``, ``source``, ``piece``, ``n`` (occurrences) and the pieces' ``path`` and ``at``.

    ``source`` is the least place of the window and names the edge. A ``piece`` is a run of edges joined at nodes that do
    not branch whose sources are neighbouring places of one text; it is named by its first edge. The second table
    has the pieces that follow another on their path: the path's first piece, and how many edges lie before. A
    path is cut where its sources fall, which opens circles too.
    """
    met = occurrences.groupBy("left", "right").agg(F.min("place").alias("source"), F.max("place").alias("last"), F.count("*").alias("n"))
    text = lambda place: F.shiftright(place, bits)
    repeated = space.keep(met.filter(text(F.col("source")) != text(F.col("last"))).select("left", "right", "source", "n"), "repeated")
    ins = repeated.groupBy(F.col("right").alias("node")).agg(F.count("*").alias("n"), F.min("source").alias("comes")).filter("n = 1")
    outs = repeated.groupBy(F.col("left").alias("node")).agg(F.count("*").alias("n"), F.min("source").alias("goes")).filter("n = 1")
    links = space.keep(ins.join(outs, "node").filter("goes > comes").select("comes", "goes"), "links")
    inner = links.filter((F.col("goes") == F.col("comes") + 1) & (text(F.col("goes")) == text(F.col("comes"))))
    edges = repeated.join(inner.select(F.col("goes").alias("source"), F.lit(True).alias("follows")), "source", "left")
    along = Window.partitionBy(text(F.col("source"))).orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    edges = space.keep(
        edges.select("left", "right", "source", "n", F.max(F.when(F.col("follows").isNull(), F.col("source"))).over(along).alias("piece")), "edges"
    )
    outer = links.join(inner, ["comes", "goes"], "left_anti")
    follow = edges.select(F.col("source").alias("comes"), "piece").join(outer, "comes").select(
        F.col("goes").alias("piece"), F.col("piece").alias("path"), (F.col("comes") - F.col("piece") + 1).alias("at")
    )
    follow = space.keep(follow, "follow")
    # Each round a piece points twice as far back, until all point to the first piece of their path.
    while True:
        back = follow.select(F.col("piece").alias("path"), F.col("path").alias("_path"), F.col("at").alias("_at"))
        # No two pieces that still move point to the same one.
        joined = space.keep(follow.join(back, "path", "left"), "follow")
        moved = joined.filter("_path is not null").isEmpty()
        follow = joined.select("piece", F.coalesce("_path", "path").alias("path"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"))
        if moved:
            return edges, follow


def _walks(occurrences: DataFrame, edges: DataFrame, bits: int) -> DataFrame:
    """``t``, ``start``, ``n``, ``source_t``, ``source_start``, ``piece``: unbroken walks of ``n`` windows along a piece of an earlier text."""
    text = lambda place: F.shiftright(place, bits)
    # One number for both nodes is enough here: what else it lets through is told apart by its words.
    edge = F.xxhash64("left", "right").alias("edge")
    known = edges.select(edge, "source", "piece")
    counts = edges.groupBy(edge).agg(F.sum("n").alias("n"))
    met = hot_join(occurrences.select(edge, "place"), known, ["edge"], ["place"], counts)
    met = met.filter(text(F.col("source")) < text(F.col("place")))
    met = met.select(text(F.col("place")).alias("t"), "piece", "place", (F.col("place") - F.col("source")).alias("lead"))
    order = Window.partitionBy("t", "piece", "lead").orderBy("place")
    # One place may stand there twice where a row of the table is repeated.
    runs = met.withColumn("run", F.col("place") - F.dense_rank().over(order))
    walks = runs.groupBy("t", "piece", "lead", "run").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    word = lambda place: place.bitwiseAND(F.lit((1 << bits) - 1))
    source = F.col("first") - F.col("lead")
    return walks.select(
        "t", word(F.col("first")).alias("start"), (F.col("last") - F.col("first") + 1).alias("n"),
        text(source).alias("source_t"), word(source).alias("source_start"), "piece",
    )


def _digested(spans: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``t``, ``start``, ``n``, ``rank``, ``digest`` of the words that ``n`` windows from word ``start`` of text ``t`` cover."""
    asked = spans.select("t", "start", "n").distinct()
    counted = asked.groupBy("t").agg(F.expr(f"(count(*) + {SPANS - 1}) div {SPANS}").alias("lists"))
    lists = asked.join(counted, "t").groupBy("t", F.pmod(F.xxhash64("start", "n"), F.col("lists")).alias("list")).agg(
        F.collect_list(F.struct("start", "n")).alias("spans")
    )
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = row["text"].encode().split()
                starts, ns = [s["start"] for s in row["spans"]], [s["n"] for s in row["spans"]]
                digests = [hashlib.sha256(b" ".join(words[s:s + n + width - 1])).digest() for s, n in zip(starts, ns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["t"]] * len(ns), pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()),
                     pa.array([row["rank"]] * len(ns), pa.int64()), pa.array(digests, pa.binary())],
                    names=["t", "start", "n", "rank", "digest"],
                )

    # A text stands in the table more than once if its row is repeated.
    met = lists.select("t", "spans").join(texts.select("t", "rank", "text"), "t")
    return met.mapInArrow(run, "t bigint, start bigint, n bigint, rank bigint, digest binary").distinct()


def _verified(walks: DataFrame, occurrences: DataFrame, edges: DataFrame, texts: DataFrame, width: int, bits: int, space: Workspace) -> DataFrame:
    """``t``, ``start``, ``n`` of the walks whose words equal their source's, and of the single windows of the others that
    equal those of another earlier text."""
    sources = walks.select(F.col("source_t").alias("t"), F.col("source_start").alias("start"), "n")
    digests = space.keep(_digested(walks.select("t", "start", "n").unionByName(sources), texts, width), "digests")
    theirs = digests.select(
        F.col("t").alias("source_t"), F.col("start").alias("source_start"), "n", F.col("rank").alias("source_rank"), F.col("digest").alias("source_digest")
    )
    asked = walks.withColumnRenamed("n", "windows").groupBy("source_t", "source_start", "windows").agg(F.count("*").alias("n"))
    both = hot_join(
        walks.withColumnRenamed("n", "windows"), theirs.withColumnRenamed("n", "windows"), ["source_t", "source_start", "windows"], ["t", "start"], asked
    ).withColumnRenamed("windows", "n").join(digests, ["t", "start", "n"])
    compared = space.keep(both.select("t", "start", "n", "piece", "source_t", "source_start", "rank", "source_rank", (F.col("digest") == F.col("source_digest")).alias("equal")), "compared")
    # Texts of one doc_id do not count as earlier than each other.
    found = compared.filter("equal and source_rank < rank").select("t", "start", "n")
    unlike = compared.filter("not equal")
    if unlike.isEmpty():
        return found
    source = F.shiftleft("source_t", bits) + F.col("source_start")
    doubtful = unlike.select(F.explode(F.sequence(source, source + F.col("n") - 1)).alias("source")).distinct()
    doubted = space.keep(edges.join(doubtful, "source").select("left", "right", "source", "n"), "doubted")
    places = hot_join(occurrences, doubted.drop("n"), ["left", "right"], ["place"], doubted.select("left", "right", "n"))
    single = space.keep(places.select(
        "source", F.shiftright("place", bits).alias("t"), F.col("place").bitwiseAND(F.lit((1 << bits) - 1)).alias("start"), F.lit(1).cast("bigint").alias("n")
    ).distinct(), "doubtful")
    told = space.keep(single.join(_digested(single, texts, width), ["t", "start", "n"]), "told")
    firsts = told.groupBy("source", "digest").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    apart = hot_join(told, firsts.drop("n"), ["source", "digest"], ["t", "start"], firsts.select("source", "digest", "n"))
    apart = apart.filter("first < rank").select("t", "start", "n")
    return found.unionByName(apart)


def _kept(found: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``k1``, ``k2``, ``removed`` (word ranges ``first`` to ``last`` from 0), ``n_removed``, ``kept`` of each text that loses words."""
    per_text = found.groupBy("t").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    schema = "k1 bigint, k2 bigint, removed array<struct<first: bigint, last: bigint>>, n_removed bigint, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            for row in batch.to_pylist():
                words = row["text"].encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                for span in row["spans"]:
                    step[span["start"]] += 1
                    step[span["start"] + span["n"] + width - 1] -= 1
                gone = np.cumsum(step)[:-1] > 0
                edge = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
                ranges = [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["k1"]], pa.int64()), pa.array([row["k2"]], pa.int64()), pa.array([ranges], kind),
                     pa.array([int(gone.sum())], pa.int64()), pa.array([kept], pa.string())],
                    names=["k1", "k2", "removed", "n_removed", "kept"],
                )

    return per_text.join(texts.select("t", "k1", "k2", "text"), "t").mapInArrow(run, schema).dropDuplicates(["k1", "k2"])


def repeats(docs: DataFrame, space: Workspace, width: int = WIDTH, mask: int = (1 << 64) - 1) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``k1``, ``k2`` (of the text), ``n_words``, ``n_removed``, ``removed``, ``kept``, ``whole``.

    Words stand between ASCII blanks. A word goes if a window of ``width`` words over it also starts in a document of smaller
    doc_id; windows are judged on the texts as they come. ``removed`` lists the ranges of words that go, ``first`` to ``last`` from 0;
    ``kept`` is the words that stay, joined by one blank, null where none go, and ``whole`` the SHA-256 of all words so joined.
    Null and empty texts have no words; texts of fewer words than ``width`` lose nothing; texts of any length are taken whole.
    Repeats within a document, and between rows of one doc_id, stay. A null doc_id ranks after all others (as the
    largest bigint), and such rows remove nothing from each other. Repeated rows give repeated results; an empty table
    gives none. Other columns may have any names. ``mask`` leaves bits of node hashes out, to test what collisions do.
    """
    scan = space.keep(_scanned(docs, width), "scan")
    reps = scan.groupBy("k1", "k2").agg(F.min("rank").alias("rank"), F.count("*").alias("n"), F.max("n_words").alias("n_words"), F.first("anchors").alias("anchors"))
    reps = space.keep(reps, "distinct")
    texts = _candidates(docs, reps, space)
    # A place is a text's number and a word's, side by side in 63 bits.
    size = texts.agg(F.max("t")).first()[0] or 0
    bits = (reps.agg(F.max("n_words")).first()[0] or 0).bit_length()
    if size.bit_length() + bits > 63:
        raise OverflowError(f"{size} texts of up to 2^{bits} words do not fit 63 bits")
    occurrences = _edges(texts, width, bits, mask)
    edges, _ = compacted(occurrences, bits, space)
    walks = space.keep(_walks(occurrences, edges, bits), "walks")
    found = _verified(walks, occurrences, edges, texts, width, bits, space)
    kept = space.keep(_kept(found, texts, width), "kept")
    classes = reps.select("k1", "k2", F.col("rank").alias("first")).join(kept, ["k1", "k2"], "left")
    rows = hot_join(scan.drop("anchors"), classes, ["k1", "k2"], ["rank"], reps.select("k1", "k2", "n"))
    # A copy of a text of smaller id is covered by its windows from end to end, if it has one.
    copy = (F.col("rank") > F.col("first")) & (F.col("n_words") >= width)
    none = F.array().cast("array<struct<first: bigint, last: bigint>>")
    all_words = F.array(F.struct(F.lit(0).cast("bigint").alias("first"), (F.col("n_words") - 1).alias("last")))
    return rows.select(
        "doc_id", "k1", "k2", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, all_words).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"), "whole",
    )


def without_repeats(docs: DataFrame, space: Workspace, **parameters: int) -> DataFrame:
    """``row`` (every input column), ``text`` without repeated spans, ``n_words``, ``n_removed``, ``removed``; see ``repeats``.

    A text that loses nothing stays as it is, white space included; null stays null.
    """
    rows = packed(docs).select("row", F.col("row.doc_id").alias("_id"), *_keys(F.col("row.text")))
    found = repeats(docs, space, **parameters).select(F.col("doc_id").alias("_of"), "k1", "k2", "n_words", "n_removed", "removed", "kept").dropDuplicates(["_of", "k1", "k2"])
    same = rows["_id"].eqNullSafe(found["_of"]) & (rows["k1"] == found["k1"]) & (rows["k2"] == found["k2"])
    return rows.join(found, same).select("row", F.coalesce("kept", "row.text").alias("text"), "n_words", "n_removed", "removed")
