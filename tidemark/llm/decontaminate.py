"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every run of ``gram`` words has a hash, and of each ``window`` neighbouring hashes the least is kept (the leftmost of
equal ones) with its place. Two texts that share a span of ``gram + window - 1`` words hold the same window of hashes
there and therefore keep the same hash at the same place of the span, so joining kept hashes finds every shared span of
that length. A hit is extended along its alignment and counts where so many words agree.

Benchmark items shorter than that are one window of their own length. They are looked up by the hash of their whole word
sequence, for those lengths that occur.

The documents' kept hashes meet the benchmark's in a join that carries no text. Alignments that it finds are counted once
per document, the items' texts once per distinct word sequence, and only then the words are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import packed, salted_join, settled, text_key
from tidemark.workspace import Workspace

#: Words of a span whose every occurrence is found, and words of a hash.
SPAN = 10
GRAM = 5

# What is a word, and which letters are lowered.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: What ``WORD`` leaves out of the lower half of the code, without the blank.
BETWEEN = "".join(c for c in map(chr, range(128)) if c not in UPPER + LOWER + "0123456789 ")


def words_of(text: Column) -> Column:
    """The words of a whole text in order (runs of ``WORD``); null has none."""
    spaced = F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def with_kept_hashes(rows: DataFrame, span: int, gram: int, short: list[int]) -> DataFrame:
    """Add ``kept``: distinct structs of ``hash`` and 0-based ``place``, from an array ``words``.

    ``short``: lengths below ``span`` whose every run of words is hashed as well, under that length.
    """
    window = span - gram + 1
    last = lambda length: F.size("words") - length
    hashed = settled(
        settled(rows, "codes", F.transform("words", lambda w: F.xxhash64(w))),
        "hashes",
        F.when(
            F.size("words") >= span,
            F.transform(F.sequence(F.lit(0), last(gram)), lambda i: F.xxhash64(*[F.get("codes", i + n) for n in range(gram)])),
        ),
    )
    # The place of each window's least hash; neighbouring windows mostly agree.
    least = F.transform(
        F.sequence(F.lit(1), F.size("hashes") - window + 1),
        lambda i: i - 2 + F.array_position(F.slice("hashes", i, window), F.array_min(F.slice("hashes", i, window))).cast("int"),
    )
    placed = settled(hashed, "least", F.when(F.col("hashes").isNotNull(), F.array_distinct(least)))
    winnowed = F.transform(
        "least", lambda p: F.struct(F.get("hashes", p).alias("hash"), p.cast("int").alias("place"))
    )
    runs = [_runs(length, last(length)) for length in short]
    nothing = F.array().cast("array<struct<hash:bigint,place:int>>")
    return placed.withColumn(
        "kept", reduce(lambda a, b: F.concat(a, b), [F.coalesce(x, nothing) for x in [winnowed, *runs]])
    ).drop("codes", "hashes", "least")


def _runs(length: int, last: Column) -> Column:
    """Hash and place of every run of ``length`` words."""
    return F.when(
        F.size("words") >= length,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(F.xxhash64(F.lit(length), F.slice("codes", i + 1, length)).alias("hash"), i.cast("int").alias("place")),
        ),
    )


def _alignments(docs: DataFrame, sequences: DataFrame, short: list[int], span: int, gram: int, space: Workspace) -> DataFrame:
    """``doc_id``, ``key`` and ``met``: distinct structs of ``sequence`` and ``shift`` (its start in the document)."""
    known = with_kept_hashes(sequences, span, gram, [])
    # A short sequence has one hash, of its whole length.
    whole = F.array(F.struct(F.xxhash64(F.size("words"), F.transform("words", lambda w: F.xxhash64(w))).alias("hash"), F.lit(0).alias("place")))
    known = known.select("sequence", F.explode(F.when(F.size("words") < span, whole).otherwise(F.col("kept"))).alias("at"))
    known = known.groupBy(F.col("at.hash").alias("hash")).agg(
        F.collect_set(F.struct("sequence", F.col("at.place").alias("start"))).alias("items")
    )
    known = space.keep(known, "known")
    rows = settled(docs.select("doc_id", text_key().alias("key"), "text"), "words", words_of(F.col("text"))).drop("text")
    kept = with_kept_hashes(rows, span, gram, short).select("doc_id", "key", F.explode("kept").alias("at"))
    # The planner broadcasts the benchmark's hashes where their measured size is within its limit, and shuffles otherwise.
    met = (
        kept.select("doc_id", "key", F.col("at.hash").alias("hash"), F.col("at.place").alias("place"))
        .join(known, "hash")
        .select("doc_id", "key", "place", F.explode("items").alias("item"))
        .select("doc_id", "key", F.col("item.sequence").alias("sequence"), (F.col("place") - F.col("item.start")).alias("shift"))
    )
    return met.groupBy("doc_id", "key").agg(F.collect_set(F.struct("sequence", "shift")).alias("met"))


def contamination(docs: DataFrame, benchmark: DataFrame, space: Workspace, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``row`` (every input column), ``n_words``, ``hit`` (sorted places of hit words, from 0), ``item_ids`` (sorted strings).

    A window is ``span`` consecutive words of a benchmark item, or a whole item of fewer words. Words of a document
    inside any occurrence of a window are hit; ``item_ids`` are the items with an occurring window. Null and empty
    texts have no words, items without words have no windows, and a null item_id is not listed though its words hit.
    Items of equal words are compared once and all listed. Rows of equal doc_id and text are one document, each row
    comes back. Empty tables give an empty result or one without hits; further columns of either table may have any
    names.
    """
    items = settled(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), "words", words_of(F.col("text"))
    )
    sequences = items.filter(F.size("words") > 0).groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    sequences = space.keep(
        sequences.select(F.sha2(F.array_join("words", " "), 256).alias("sequence"), "words", "item_ids"), "sequences"
    )
    # At most ``span - 1`` numbers, whatever the benchmark's size.
    short = sorted(r[0] for r in sequences.select(F.size("words").alias("n")).filter(F.col("n") < span).distinct().collect())
    met = space.keep(_alignments(docs, sequences, short, span, gram, space), "alignments")
    # The items' words reach each alignment by the sequence's name; a sequence that many documents hold is dealt out.
    aligned = met.select("doc_id", "key", F.explode("met").alias("at")).select("doc_id", "key", "at.*")
    aligned = salted_join(
        aligned, sequences.withColumnRenamed("words", "item_words"), ["sequence"], ["doc_id", "key"]
    )
    found = aligned.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_list(F.struct("item_words", "item_ids", "shift")).alias("met")
    )
    rows = packed(docs).withColumns({"doc_id": F.col("row.doc_id"), "key": text_key("row.text")})
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & rows["key"].eqNullSafe(found["_key"]), "left")
    worded = settled(joined.select("row", "met"), "words", words_of(F.col("row.text")))
    # Each alignment's windows: those starts from which all words agree.
    checked = settled(worded, "occurring", F.transform("met", lambda m: _occurring(m, span)))
    checked = settled(checked, "found", F.filter("occurring", lambda f: F.size(f["starts"]) > 0))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: F.flatten(
        F.transform(f["starts"], lambda s: F.sequence(s, s + f["length"] - 1))
    )))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: f["item_ids"]))))
    return settled(checked, "places", hit).select(
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.coalesce("places", F.array().cast("array<int>")).alias("hit"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("item_ids"),
    )


def _occurring(met: Column, span: int) -> Column:
    """For one alignment: the document places where a window of the item begins and agrees, its length, the item ids."""
    length = F.least(F.size(met["item_words"]), F.lit(span))
    starts = F.sequence(F.lit(0), F.size(met["item_words"]) - length)
    agreeing = F.filter(
        starts,
        lambda s: (s + met["shift"] >= 0)
        & (s + met["shift"] + length <= F.size("words"))
        & (
            F.slice(met["item_words"], s + 1, length)
            == F.slice("words", F.greatest(s + met["shift"], F.lit(0)) + 1, length)
        ),
    )
    return F.struct(
        F.transform(agreeing, lambda s: s + met["shift"]).alias("starts"),
        length.alias("length"),
        met["item_ids"].alias("item_ids"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, space: Workspace, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; columns and all other rows as they are."""
    found = contamination(docs, benchmark, space, span, gram)
    return found.filter(F.size("hit") == 0).select("row.*")
