"""Line dedup by repeated passages and content-defined chunks of lines, in DataFrame operations only.

A passage is a run of whole lines with at least ``PASSAGE_WORDS`` words. From every line its shortest passage is taken
that begins there, and the shortest that ends there. A shared run of so many words, however many lines it spans and
whatever surrounds it, is covered by those of them that lie inside: the one from a line, or, where too few words of the
run follow, the one up to the run's last line. So the lines of all maximal shared runs are found, and no others.

A text is also cut into chunks of whole lines. A cut falls after a line where the rolling hash over the last lines'
hashes is less than one line before and one line after, and around every line that alone is long enough to count as a
passage. Both depend on the lines at the place only, so the same passage is cut alike wherever it stands, and lines
inserted before it shift nothing. Being a least value also keeps cuts at least two lines apart; they are three apart on
average, and none leaves a single line at a text's top or end. Chunks find shared lines of fewer words, though not all.

Pieces (passages, chunks of several lines) that occur more than once anywhere are repeated: short marks tell which may
be, and those are compared by the SHA-256 of their whole text. The first occurrence (smallest doc_id, then place) stays, the others' lines go.

The grouping combines equal pieces before the shuffle, so a passage that a third of all documents share is a few rows
per task; the list of occurrences that meets it again holds digests only and is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import hot_join, packed, settled, text_key
from tidemark.workspace import Workspace

#: Lines in the rolling window.
WINDOW = 2
#: A single line of so many words is a chunk of its own; a chunk of several lines needs so many words to count.
LINE_WORDS = 50
CHUNK_WORDS = 10
#: Words of a run of lines whose every repetition is found; 0 leaves it at chunks.
PASSAGE_WORDS = 50
#: A word: anything between blanks.
WORD = "[^\\t-\\r ]+"


def with_lines(rows: DataFrame, text: Column) -> DataFrame:
    """Add arrays: ``lines`` and their ``words`` (numbers of words)."""
    facts = settled(rows, "lines", F.split(text, "\n"))
    return settled(facts, "words", F.transform("lines", lambda line: F.regexp_count(line, F.lit(WORD))))


def with_chunks(facts: DataFrame, text: Column, window: int, line_words: int) -> DataFrame:
    """Add to what ``with_lines`` gives an array ``chunks`` (``first`` line, from 1, and ``size``)."""
    facts = settled(facts, "hashes", F.transform("lines", lambda line: F.md5(line)))

    def rolled(i: Column) -> Column:
        # Over the window's hashes in order; fewer at the top of a text.
        first = F.greatest(F.lit(1), i - window + 2)
        digest = F.md5(F.array_join(F.slice("hashes", first, i + 2 - first), ""))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")

    # A line ends a chunk where the window's hash is a least one, where it is long, or where a long one follows.
    size = F.size("lines")
    facts = settled(facts, "rolled", F.when(text.isNotNull(), F.transform(F.sequence(F.lit(0), size - 1), rolled)))
    least = lambda i, other: F.get("rolled", i) < F.coalesce(F.get("rolled", other), F.lit(1 << 62))
    ends = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == size - 1)
        | (F.get("words", i) >= line_words)
        | (F.coalesce(F.get("words", i + 1), F.lit(0)) >= line_words)
        | (least(i, i - 1) & least(i, i + 1) & (i > 0) & (i < size - 2)),
    )
    cut = settled(facts, "ends", F.when(text.isNotNull(), ends))
    return settled(
        cut,
        "chunks",
        F.transform(
            "ends",
            lambda end, k: F.struct(
                (F.coalesce(F.get("ends", k - 1), F.lit(-1)) + 2).alias("first"),
                (end - F.coalesce(F.get("ends", k - 1), F.lit(-1))).alias("size"),
            ),
        ),
    ).drop("ends", "hashes", "rolled")


def _words(chunk: Column) -> Column:
    return F.aggregate(F.slice("words", chunk["first"], chunk["size"]), F.lit(0), lambda a, b: a + b)


def _counted(chunk: Column, line_words: int, chunk_words: int) -> Column:
    return _words(chunk) >= F.when(chunk["size"] > 1, chunk_words).otherwise(line_words)


def _text(chunk: Column) -> Column:
    return F.array_join(F.slice("lines", chunk["first"], chunk["size"]), "\n")


def with_pieces(facts: DataFrame, chunks: Column, passage_words: int) -> DataFrame:
    """Add an array ``pieces`` (``first`` line, from 1, and ``size``): the given chunks and all shortest passages, each once."""
    span = lambda first, size: F.shiftleft(first.cast("bigint"), 32) + size
    spans = F.transform(chunks, lambda c: span(c["first"], c["size"]))
    if passage_words:
        # The line of every word, and the place of every line's first word; lines without words have none.
        owners = F.flatten(F.transform("words", lambda n, i: F.array_repeat(i + 1, n)))
        facts = settled(facts, "owners", owners)
        total = F.size("owners")
        places = F.sequence(F.lit(0), total - 1)
        starts = F.filter(places, lambda p: ~F.get("owners", p).eqNullSafe(F.get("owners", p - 1)))
        facts = settled(facts, "starts", F.when(total >= passage_words, starts))
        owned = lambda a, b: span(F.get("owners", a), F.get("owners", b) - F.get("owners", a) + 1)
        forward = F.transform("starts", lambda p: owned(p, p + passage_words - 1))
        # Where the next line starts, the passage before ends.
        backward = F.transform(F.concat("starts", F.array(total)), lambda p: owned(p - passage_words, p - 1))
        passages = F.array_compact(F.concat(forward, backward))
        spans = F.concat(spans, F.coalesce(passages, F.array().cast("array<bigint>")))
    facts = settled(facts, "spans", F.array_distinct(spans))
    pieces = F.transform("spans", lambda s: F.struct(
        F.shiftright(s, 32).cast("int").alias("first"), s.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("size")
    ))
    return settled(facts, "pieces", pieces)


def repeated_lines(
    docs: DataFrame,
    space: Workspace,
    window: int = WINDOW,
    line_words: int = LINE_WORDS,
    chunk_words: int = CHUNK_WORDS,
    passage_words: int = PASSAGE_WORDS,
) -> DataFrame:
    """``doc_id``, ``key`` and ``spare``: structs of the lines ``first`` to ``last`` (from 1) that repeat earlier ones."""
    rows = docs.select("doc_id", text_key().alias("key"), "text")
    facts = with_chunks(with_lines(rows, F.col("text")), F.col("text"), window, line_words)
    counted = F.filter("chunks", lambda c: _counted(c, line_words, chunk_words))
    facts = settled(with_pieces(facts, counted, passage_words), "marks", F.transform("lines", lambda line: F.xxhash64(line)))
    mark = lambda c: F.xxhash64(F.slice("marks", c["first"], c["size"]))
    # A short mark of each piece, made of marks of its lines, leaves those that may repeat; equal ones of a task are combined.
    marks = facts.select(F.explode(F.transform("pieces", mark)).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))
    marks = space.keep(marks.filter("n > 1"), "marks")
    pieces = facts.select("doc_id", "key", F.explode(
        F.transform(
            "pieces",
            lambda c: F.struct(
                c["first"].alias("first"), c["size"].alias("size"), mark(c).alias("mark"), F.unhex(F.sha2(_text(c), 256)).alias("digest"),
            ),
        )
    ).alias("piece")).select("doc_id", "key", "piece.*")
    likely = space.keep(hot_join(pieces, marks.select("mark"), ["mark"], ["doc_id", "key"], marks), "likely")
    # Whether they do is told by their whole text.
    texts = likely.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))
    repeated = space.keep(texts.filter("n > 1"), "repeated")
    found = hot_join(likely, repeated.select("digest", "keeper"), ["digest"], ["doc_id", "key"], repeated.select("digest", "n"))
    # Within the document that keeps a text its first place stays; a null keeper means that no occurrence has an id.
    first = found.filter("doc_id = keeper").groupBy("doc_id", "digest").agg(
        F.min_by(F.struct("key", "first"), F.struct("key", "first")).alias("stays")
    )
    joined = found.filter("keeper is not null").join(first, ["doc_id", "digest"], "left")
    # A piece may overlap the one that stays, where lines repeat at once; what they share stays.
    begins = F.when(
        F.col("stays.key") == F.col("key"), F.greatest("first", F.col("stays.first") + F.col("size"))
    ).otherwise(F.col("first"))
    spare = joined.filter(F.col("stays").isNull() | (F.struct("key", "first") != F.col("stays"))).select(
        "doc_id", "key", F.struct(begins.alias("first"), (F.col("first") + F.col("size") - 1).alias("last")).alias("span")
    ).filter("span.first <= span.last")
    return spare.groupBy("doc_id", "key").agg(F.collect_set("span").alias("spare"))


def without_repeats(docs: DataFrame, space: Workspace, **parameters: int) -> DataFrame:
    """``row`` (every input column), ``text`` without repeated lines, ``removed_lines``, ``removed_words``, ``n_lines``.

    Lines end at a line feed. Every run of lines with at least ``passage_words`` words that occurs more than once stays
    only where it first occurs, and so do chunks of several lines with at least ``chunk_words`` words and single lines
    with at least ``line_words``. Nothing else of a text changes; a text all of whose lines go becomes empty. Null texts
    stay null, empty ones empty. Rows of equal doc_id and text are one document and are treated alike. Rows without
    doc_id count as later than all others; a run that only such rows have stays everywhere. Every row comes back once;
    an empty table gives an empty result; other columns may have any names.
    """
    rows = packed(docs).withColumns({"doc_id": F.col("row.doc_id"), "key": text_key("row.text")})
    spare = repeated_lines(docs, space, **parameters)
    spare = spare.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spare")
    joined = rows.join(spare, rows["doc_id"].eqNullSafe(spare["_id"]) & (rows["key"] == spare["_key"]), "left")
    untouched = F.col("spare").isNull()
    # Only the texts that lose something are split again.
    facts = with_lines(joined, F.when(~untouched, F.col("row.text")))
    gone = F.array_distinct(F.flatten(F.transform("spare", lambda s: F.sequence(s["first"], s["last"]))))
    facts = settled(facts, "gone", gone)
    facts = settled(facts, "kept", F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone"))
    text = F.array_join(F.transform("kept", lambda i: F.get("lines", i - 1)), "\n")
    words = F.aggregate("gone", F.lit(0).cast("bigint"), lambda total, i: total + F.get("words", i - 1))
    return facts.select(
        "row",
        F.when(untouched, F.col("row.text")).otherwise(text).alias("text"),
        F.when(untouched, F.lit(0)).otherwise(F.size("gone")).cast("bigint").alias("removed_lines"),
        F.when(untouched, F.lit(0).cast("bigint")).otherwise(words).alias("removed_words"),
        F.coalesce(F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"))) + 1, F.lit(0))
        .cast("bigint").alias("n_lines"),
    )
