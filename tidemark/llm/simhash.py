"""SimHash near-duplicates: a segment-popcount embedding, a grid range join under Manhattan distance, an exact check.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment is mapped to its number of set bits. The
Manhattan distance of two such count vectors never exceeds the number of differing bits, so pairs beyond the limit can
be left out unseen. The counts are written in unary (0, 1, 2 as 00, 01, 11), which makes the Manhattan distance the
popcount of an exclusive or.

Grid: the segments form ``limit + 3`` groups. Two vectors within the limit agree in at least three groups, so each vector
stands in one cell for every choice of three groups, and only vectors that share a cell are compared. No pair is lost.

Copies share a fingerprint and are handled once. A cell of many fingerprints is cut into chunks of bounded size that are
compared two and two, and a comparison yields no more links than connect what it has found, so that a group of n near
copies never becomes n * n rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import hot_join, packed, salted_join, text_key
from tidemark.llm.components import components
from tidemark.workspace import Workspace

SHINGLE_SEED = 42
#: Shingles whose bits are summed at a time, which bounds the memory a very long text takes.
BLOCK = 1 << 15
#: About so many fingerprints stand in one chunk of a grid cell.
CHUNK = 512
#: Bytes of shingle sets in one chunk of texts that are compared in full.
CHUNK_BYTES = 4 << 20
#: Bands of minimum hashes by which similar texts are found, and hashes in a band.
BANDS, BAND_ROWS = 16, 7

_FACTORS, _SHIFTS = np.random.default_rng(SHINGLE_SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
_FACTORS |= np.uint64(1)
_FIELDS = 0x5555555555555555


def _shingles(text: str | None, width: int) -> tuple[bytes, list[int], list[int]]:
    """The words of the whole text (A-Z lowered) in one, and where its ``width``-word shingles begin and end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return b"", [], []
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return joined, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The hashes of the different ``width``-word shingles of the whole text, in order; none without words."""
    joined, first, last = _shingles(text, width)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SHINGLE_SEED) for a, b in zip(first, last)), np.uint64, len(first)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two shingle sets; empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash over the ``width``-word shingles of the whole text (A-Z lowered); 0 without words."""
    joined, first, last = _shingles(text, width)
    if not first:
        return 0
    digest, totals = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = [digest(joined[a:b], SHINGLE_SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64)
        totals += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * totals > len(first), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``key`` (which text of that id), ``fp`` (the fingerprint as a signed bigint) of every document."""
    rows = docs.select("doc_id", text_key().alias("key"), "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key bigint, fp bigint"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(found)], names=["doc_id", "key", "fp"]
            )

    return rows.mapInArrow(run, schema)


def embedded(fp: str = "fp"):
    """The unary counts of the two-bit segments: bit by bit 'any' and, above it, 'both'."""
    shifted = F.shiftrightunsigned(F.col(fp), 1)
    anyone = F.col(fp).bitwiseOR(shifted).bitwiseAND(F.lit(_FIELDS))
    both = F.col(fp).bitwiseAND(shifted).bitwiseAND(F.lit(_FIELDS))
    return anyone.bitwiseOR(F.shiftleft(both, 1))


def cell_masks(limit: int) -> list[int]:
    """For each choice of three out of ``limit + 3`` groups of segments, the bits of the chosen groups (signed)."""
    groups = np.array_split(np.arange(32), limit + 3)
    bits = [sum(3 << (2 * int(s)) for s in group) for group in groups]
    masks = [sum(chosen) for chosen in combinations(bits, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, limit: int, space: Workspace) -> DataFrame:
    """Links ``a``, ``b`` that join exactly the fingerprints a chain of pairs within ``limit`` bits joins.

    ``distinct`` holds each fingerprint once, as bigint ``fp``.
    """
    met = _meetings(distinct, ["fp"], limit, space)
    return met.mapInPandas(lambda b: _connect(b, limit), "a bigint, b bigint").distinct()


def unlike_pairs(labelled: DataFrame, limit: int, space: Workspace) -> DataFrame:
    """Every pair ``a``, ``b`` of keys of unequal labels whose fingerprints differ in at most ``limit`` bits, once.

    ``labelled`` holds each ``key`` once, with ``fp`` and ``label``, all bigint.
    """
    met = _meetings(labelled, ["fp", "key", "label"], limit, space)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, other in zip(batch["fps"], batch["others"]):
                (fp, key, label), (fp2, key2, label2) = (
                    [np.array([r[c] for r in rows], np.int64) for c in ("fp", "key", "label")] for rows in (one, other)
                )
                near = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp2.view(np.uint64)[None, :]) <= limit
                rows, columns = np.nonzero(near & (label[:, None] != label2[None, :]))
                a, b = key[rows], key2[columns]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return met.mapInPandas(run, "a bigint, b bigint").distinct()


def _meetings(distinct: DataFrame, columns: list[str], limit: int, space: Workspace) -> DataFrame:
    """``fps`` and ``others``: chunks of rows that share a cell of the grid, every two of a cell in some row.

    The chunks hold ``columns``; of a single one its values, else structs.
    """
    masks = cell_masks(limit)
    whole = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    placed = distinct.select("fp", whole.alias("whole"), embedded().alias("u")).select(
        "fp", "whole", F.posexplode(F.array(*[F.col("u").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "cell")
    )
    placed = placed.select("fp", "whole", F.col("choice").cast("int").alias("choice"), "cell")
    # Cells with a single fingerprint, nearly all of them, end here: the counts are combined before the shuffle.
    shared = (
        placed.groupBy("choice", "cell").agg(F.count("*").alias("n")).filter("n > 1")
        .select("choice", "cell", F.expr(f"cast((n + {CHUNK - 1}) div {CHUNK} as int)").alias("chunks"))
    )
    chunked = (
        placed.join(shared, ["choice", "cell"])
        .withColumn("chunk", F.pmod(F.xxhash64("whole"), F.col("chunks")).cast("int"))
        .groupBy("choice", "cell", "chunks", "chunk")
        .agg(F.collect_list("whole").alias("fps"))
    )
    # A chunk meets every other chunk of its cell once: the one so many places on, around the circle.
    meetings = space.keep(chunked, "chunks")
    alone = meetings.filter("chunks = 1").select("fps", F.col("fps").alias("others"))
    many = meetings.filter("chunks > 1")
    met = (
        many.withColumn("step", F.explode(F.sequence(F.lit(0), F.expr("chunks div 2"))))
        .withColumn("with", F.expr("pmod(chunk + step, chunks)"))
        .join(
            many.select("choice", "cell", F.col("chunk").alias("with"), F.col("fps").alias("others")),
            ["choice", "cell", "with"],
        )
        .select("fps", "others")
    )
    return alone.unionByName(met)


def _connect(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        left, right = [], []
        for fps, others in zip(batch["fps"], batch["others"]):
            for a, b in _forest(np.asarray(fps, np.int64).view(np.uint64), np.asarray(others, np.int64).view(np.uint64), limit):
                left.append(a)
                right.append(b)
        yield pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})


def _forest(fps: np.ndarray, others: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``limit`` between two chunks (which may be one and the same)."""
    near = np.bitwise_count(_unary(fps)[:, None] ^ _unary(others)[None, :]) <= limit
    rows, columns = np.nonzero(near)
    exact = np.bitwise_count(fps[rows] ^ others[columns]) <= limit
    rows, columns = rows[exact], columns[exact]
    signed, signed_others = fps.view(np.int64).tolist(), others.view(np.int64).tolist()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for i, j in zip(rows.tolist(), columns.tolist()):
        a, b = signed[i], signed_others[j]
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _unary(fps: np.ndarray) -> np.ndarray:
    fields, one = np.uint64(_FIELDS), np.uint64(1)
    shifted = fps >> one
    return ((fps | shifted) & fields) | ((fps & shifted & fields) << one)


def near_duplicates(docs: DataFrame, space: Workspace, width: int = 5, limit: int = 3) -> DataFrame:
    """``doc_id``, ``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    Documents whose fingerprints differ in at most ``limit`` bits are linked; ``component_id`` is the smallest doc_id
    that links reach, the document itself included. Null and empty texts have fingerprint zero and are linked like any
    other. Repeated rows give repeated results. Rows with a null doc_id take part; where a component has no other
    rows, its id is null. An empty table gives an empty result. ``docs`` may have further columns of any name.
    """
    members = space.keep(fingerprints(docs, width), "members")
    distinct = members.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = space.keep(distinct, "distinct")
    roots = components(links(distinct.select("fp"), limit, space), space)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = space.keep(salted_join(rooted, names, ["root"], ["fp"]).select("fp", "component_id"), "classes")
    return salted_join(members, named, ["fp"], ["doc_id", "key"]).select(
        "doc_id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def similar_documents(docs: DataFrame, space: Workspace, width: int, limit: int, least: float) -> DataFrame:
    """``doc_id``, ``key``, ``component_id`` of every document, linked by verified pairs only.

    A link is a pair of texts whose fingerprints differ in at most ``limit`` bits and whose sets of ``width``-word shingles have a
    Jaccard similarity of ``least`` or more; all such pairs count. Texts are compared first with the root of the
    component that fingerprints alone give, which joins groups of near copies at once; then every pair within the limit
    that this has not joined. Null and empty texts are alike. Ids as in ``near_duplicates``.
    """
    members = space.keep(fingerprints(docs, width), "members")
    texts = space.keep(members.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "distinct")
    by_fp = texts.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    roots = components(links(by_fp.select("fp"), limit, space), space).withColumnRenamed("node", "fp")
    rooted = by_fp.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    # A component goes by the text of its root; only those of two texts and more are compared.
    groups = rooted.groupBy("root").agg(
        F.sum("n").alias("size"), F.max(F.when(F.col("fp") == F.col("root"), F.col("first"))).alias("head")
    ).filter("size > 1")
    groups = space.keep(groups, "groups")
    grouped = space.keep(rooted.select("fp", "root"), "rooted").join(groups, "root").select("fp", "size", "head")
    linked = space.keep(texts.join(space.keep(grouped, "grouped"), "fp").select("key", "fp", "size", "head"), "linked")
    sets = space.keep(_shingle_sets(docs, linked, width), "sets")
    # A head's set goes to one task for every so many texts of its group.
    parts = F.expr(f"cast((size + {CHUNK - 1}) div {CHUNK} as int)")
    heads = groups.join(sets.withColumnRenamed("key", "head"), "head").select(
        "head", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("shingles").alias("others")
    )
    compared = (
        linked.filter("key <> head").withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
        .join(sets, "key").select(F.col("key").alias("a"), F.col("head").alias("b"), "part", "shingles")
        .join(heads.withColumnRenamed("head", "b"), ["b", "part"]).select("a", "b", "shingles", "others")
    )
    met = space.keep(compared.mapInPandas(lambda b: _alike(b, least), "a bigint, b bigint, alike boolean"), "met")
    joined = met.filter("alike").select("a", "b")
    # Groups with texts unlike their head: all pairs within the limit, but those with the head, which are known.
    mixed = met.groupBy("b").agg(F.count("*").alias("n"), F.min("alike").alias("whole")).filter("not whole and n > 1").select("b")
    open_ = met.join(space.keep(mixed, "mixed"), "b", "left_semi").select(F.col("a").alias("key"), F.when(F.col("alike"), F.col("b")).otherwise(F.col("a")).alias("label"))
    open_ = space.keep(open_.join(linked.select("key", "fp"), "key"), "open")
    pairs = space.keep(unlike_pairs(open_, limit, space), "pairs")
    paired = (
        pairs.join(sets.withColumnRenamed("key", "a"), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("others")), "b").select("a", "b", "shingles", "others")
    )
    more = paired.mapInPandas(lambda b: _alike(b, least), "a bigint, b bigint, alike boolean").filter("alike").select("a", "b")
    alike = components(joined.unionByName(more), space).withColumnRenamed("node", "key")
    named = texts.join(alike, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    names = space.keep(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    classes = space.keep(space.keep(named, "named").join(names, "root").select("key", "component_id"), "classes")
    return members.join(classes, "key").select("doc_id", "key", "component_id")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``key`` and ``shingles`` (a shingle set as bytes) of the wanted texts, each once."""
    rows = docs.select(text_key().alias("key"), "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [shingle_set(t.as_py(), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], names=["key", "shingles"])

    texts = rows.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return texts.mapInArrow(run, "key bigint, shingles binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """``key`` and ``shingles`` (a shingle set as bytes) of the wanted texts, each once; ``counts``: rows by ``key``."""
    rows = docs.select("doc_id", text_key().alias("key"), "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [shingle_set(t.as_py(), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], names=["key", "shingles"])

    texts = hot_join(rows, wanted, ["key"], ["doc_id"], counts).groupBy("key").agg(F.first("text").alias("text"))
    return texts.mapInArrow(run, "key bigint, shingles binary")


def all_similar_documents(docs: DataFrame, space: Workspace, width: int, limit: int, least: float) -> DataFrame:
    """``doc_id``, ``key``, ``component_id`` of every document, linked by verified pairs only.

    A link is a pair of texts whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more. Two
    searches find them: texts whose fingerprints a chain of pairs within ``limit`` bits joins, and texts that share one of
    ``BANDS`` bands of minimum hashes (a pair at 0.8 does so in 97.7 of 100 cases, one at 0.85 in 99.8). Each finding is
    compared by the whole sets. A group of texts found together is compared with its first text, and where that leaves
    it in parts, all texts of different parts are compared with each other inside the tasks, which yield only the links
    that join parts. Null and empty texts are alike. Repeated rows give repeated results, an empty table an empty one;
    ids and further columns as in ``near_duplicates``.
    """
    members = space.keep(_sketches(docs, width), "members")
    texts = members.groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.count("*").alias("n")
    )
    texts = space.keep(texts, "distinct")
    by_fp = space.keep(texts.groupBy("fp").agg(F.count("*").alias("n")), "fps")
    roots = components(links(by_fp.select("fp"), limit, space), space).withColumnRenamed("node", "fp")
    rooted = hot_join(texts.select("key", "fp"), by_fp.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), ["fp"], ["key"], by_fp)
    found = texts.select("key", F.posexplode("bands").alias("band", "cell"))
    found = found.unionByName(rooted.select("key", F.lit(-1).alias("band"), F.col("root").alias("cell")))
    groups = found.groupBy("band", "cell").agg(F.count("*").alias("n"), F.min("key").alias("head")).filter("n > 1")
    groups = space.keep(groups, "groups")
    cell = ["band", "cell"]
    grouped = space.keep(hot_join(found, groups, cell, ["key"], groups.select(*cell, "n")), "grouped")
    pairs = grouped.filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    pairs = space.keep(pairs, "pairs")
    sets = space.keep(_sets_of(docs, grouped.select("key").distinct(), texts.select("key", "n"), width), "sets")
    joined = space.keep(_verified(pairs, sets, least), "joined")
    first = space.keep(components(joined, space), "first")
    more = _across(grouped.join(first.withColumnRenamed("node", "key"), "key", "left"), sets, least, space)
    # The stars of the verified pairs join what those pairs join, with the same smallest node: fewer rounds than the pairs.
    stars = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    alike = components(stars.unionByName(more), space).withColumnRenamed("node", "key")
    named = texts.join(alike, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = space.keep(named, "named")
    names = space.keep(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "names")
    classes = hot_join(named, names.select("root", "component_id"), ["root"], ["key"], names.select("root", "n"))
    classes = space.keep(classes.select("key", "component_id"), "classes")
    return hot_join(members.select("doc_id", "key"), classes, ["key"], ["doc_id"], texts.select("key", "n"))


def band_hashes(shingles: np.ndarray) -> list[int]:
    """One signed hash for each of ``BANDS`` bands of ``BAND_ROWS`` minimum hashes of a shingle set; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        spread = _FACTORS[:, None] * shingles[None, at : at + 1024] + _SHIFTS[:, None]
        np.minimum(least, spread.min(axis=1), out=least)
    digests = [xxhash.xxh64_intdigest(band.tobytes(), SHINGLE_SEED) for band in least.reshape(BANDS, BAND_ROWS)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """As ``fingerprints``, with ``bands``, the band hashes of the text."""
    rows = docs.select("doc_id", text_key().alias("key"), "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key bigint, fp bigint, bands array<bigint>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            bands = pa.array([band_hashes(shingle_set(t, width)) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(fps), bands], names=["doc_id", "key", "fp", "bands"]
            )

    return rows.mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets are alike; a ``b`` may stand in any share of the pairs, an ``a`` in few."""
    # The set of a text in many pairs goes to one task for every so many of them.
    parts = F.expr(f"cast((n + {CHUNK - 1}) div {CHUNK} as int)")
    heads = pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", parts.alias("parts"))
    shared = heads.join(sets.withColumnRenamed("key", "b"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("others")
    )
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    dealt = hot_join(pairs, heads, ["b"], ["a"], counts).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    compared = (
        dealt.join(sets.withColumnRenamed("key", "a"), "a").select("a", "b", "part", "shingles")
        .join(shared, ["b", "part"]).select("a", "b", "shingles", "others")
    )
    return compared.mapInPandas(lambda batches: _alike(batches, least), "a bigint, b bigint, alike boolean").filter("alike").select("a", "b")


def _across(grouped: DataFrame, sets: DataFrame, least: float, space: Workspace) -> DataFrame:
    """Links ``a``, ``b`` between parts of one group that hold two alike texts.

    ``grouped`` has ``band``, ``cell``, ``n``, ``key`` and ``root``, the part a text is in (null: its own). A group is cut
    into chunks bounded in texts and in bytes of their sets, and every two chunks are compared.
    """
    cell = ["band", "cell"]
    labelled = space.keep(grouped.filter("n > 2").select(*cell, "key", F.coalesce("root", "key").alias("label")), "labelled")
    mixed = labelled.groupBy(*cell).agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = space.keep(mixed.filter("low <> high").select(*cell, "n"), "mixed")
    opened = hot_join(labelled, mixed.select(*cell), cell, ["key"], mixed).join(sets, "key")
    opened = space.keep(opened.select(*cell, "key", "label", "shingles"), "opened")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.length("shingles")) / CHUNK_BYTES)).cast("int")
    sizes = space.keep(opened.groupBy(*cell).agg(chunks.alias("chunks"), F.count("*").alias("n")), "sizes")
    chunked = (
        hot_join(opened, sizes.select(*cell, "chunks"), cell, ["key"], sizes.select(*cell, "n"))
        .withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        .groupBy(*cell, "chunks", "chunk").agg(F.collect_list(F.struct("label", "shingles")).alias("ones"))
    )
    met = _chunk_pairs(space.keep(chunked, "parts"), cell, "ones")
    return met.mapInPandas(lambda batches: _join_parts(batches, least), "a bigint, b bigint").distinct()


def _chunk_pairs(chunked: DataFrame, cell: list[str], column: str) -> DataFrame:
    """``column`` and ``others``: every two chunks of a cell in one row, and each chunk with itself."""
    # A chunk meets every other chunk of its cell once: the one so many places on, around the circle.
    met = chunked.withColumn("step", F.explode(F.sequence(F.lit(0), F.expr("chunks div 2"))))
    met = met.withColumn("with", F.expr("pmod(chunk + step, chunks)"))
    alone = met.filter("step = 0").select(column, F.col(column).alias("others"))
    others = chunked.filter("chunks > 1").select(*cell, F.col("chunk").alias("with"), F.col(column).alias("others"))
    return alone.unionByName(met.filter("step > 0").join(others, [*cell, "with"]).select(column, "others"))


def _join_parts(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for ones, others in zip(batch["ones"], batch["others"]):
            labels, labels2 = ([r["label"] for r in side] for side in (ones, others))
            near = alike_sets(*([np.frombuffer(r["shingles"], np.uint64) for r in side] for side in (ones, others)), least)
            near &= np.array(labels, np.int64)[:, None] != np.array(labels2, np.int64)[None, :]
            rows += _spanning((labels[i], labels2[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(near))))
        yield pd.DataFrame({"a": np.array([a for a, _ in rows], np.int64), "b": np.array([b for _, b in rows], np.int64)})


def alike_sets(ones: list[np.ndarray], others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of ``ones`` and of ``others`` have a similarity of ``least`` or more, all at once as a table of booleans."""
    sizes, sizes2 = (np.array([len(s) for s in side], np.int64) for side in (ones, others))
    hashes, hashes2 = np.concatenate(ones), np.concatenate(others)
    both = np.intersect1d(hashes, hashes2)
    tables = []
    for values, lengths in ((hashes, sizes), (hashes2, sizes2)):
        kept = np.isin(values, both)
        tables.append((np.repeat(np.arange(len(lengths)), lengths)[kept], np.searchsorted(both, values[kept])))
    common = np.zeros((len(ones), len(others)), np.float64)
    for at in range(0, len(both), 4096):
        sides = []
        for (row, column), n in zip(tables, (len(ones), len(others))):
            here = (column >= at) & (column < at + 4096)
            side = np.zeros((n, min(4096, len(both) - at)), np.float32)
            side[row[here], column[here] - at] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    union = sizes[:, None] + sizes2[None, :] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0) >= least


def _spanning(pairs) -> list[tuple[int, int]]:
    """Those of the pairs that join what the ones before have not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _alike(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        alike = [
            jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= least
            for a, b in zip(batch["shingles"], batch["others"])
        ]
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "alike": np.array(alike, bool)})


def representatives(docs: DataFrame, space: Workspace, width: int = 5, limit: int = 3, least: float | None = None, bands: bool = False) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the one with the smallest doc_id.

    With ``least``, only pairs of that Jaccard similarity are linked (``similar_documents``), else all within ``limit``; with
    ``bands`` too, those pairs are also found whose fingerprints lie further apart (``all_similar_documents``).

    Columns and their names stay as they are. Documents without an id are kept. Rows that repeat the id of the document
    that stays are reduced to the one whose text has the smallest hash; exact repeats of that row stay one row.
    """
    if least is None:
        classes = near_duplicates(docs, space, width, limit).select("doc_id", "key", "component_id")
    else:
        search = all_similar_documents if bands else similar_documents
        classes = search(docs, space, width, limit, least)
    staying = classes.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.min("key").alias("key"))
    rows = packed(docs).withColumns({"doc_id": F.col("row.doc_id"), "key": text_key("row.text")})
    kept = rows.join(staying, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    return kept.select("row.*").unionByName(rows.filter("doc_id is null").select("row.*"))
