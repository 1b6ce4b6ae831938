"""Records of JSON documents of any size, cut by many tasks.

A document is read by byte ranges. Whether a place lies inside a string depends on the quotes before it, and its depth on the
brackets outside strings, so each range first tells its number of quotes and its change of depth for either case; running
sums over a table of one row per range then give every range its true start. A second reading cuts the records that begin
in a range: objects that open directly in the document's list. What stands between two records must be a comma; what
stands before the first and after the last, put together around an empty record, must be a document with a list of one, and
every record must be JSON itself. Then, and only then, the whole is a document of these records; any other file is left to be
taken as one text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.sources import appended
from tidemark.workspace import Workspace

RANGE_BYTES = 64 * 1024 * 1024
#: Bytes read beyond a range at first for a record that ends there; doubled as needed.
BEYOND = 1 << 20
#: Bytes that may stand before the first record and after the last.
FRAME = 1 << 20
# Stores whose files tasks open by Arrow under the same address.
SCHEMES = frozenset(("file", "hdfs", "s3", "gs"))
_QUOTE, _ESCAPE = ord('"'), ord("\\")
_OPEN = np.isin(np.arange(256), [ord("["), ord("{")])
_CLOSE = np.isin(np.arange(256), [ord("]"), ord("}")])


def _read(file, begin: int, end: int) -> bytes:
    file.seek(begin)
    return file.read(max(0, end - begin))


def settled_start(file, begin: int) -> int:
    """The first place from ``begin`` that no backslash stands before, so that no range begins with half of an escape."""
    while begin > 0 and _read(file, begin - 1, begin) == b"\\":
        begin += 1
    return begin


def _brackets(data: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the brackets outside strings, their steps of depth, and the number of quotes that begin or end strings."""
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == _QUOTE)
    if len(quotes):
        escapes = raw == _ESCAPE
        # A quote behind an odd run of backslashes is part of its string.
        runs = np.flatnonzero(~np.concatenate([[False], escapes]))
        before = quotes - runs[np.searchsorted(runs, quotes, side="right") - 1]
        quotes = quotes[before % 2 == 0]
    places = np.flatnonzero(_OPEN[raw] | _CLOSE[raw])
    outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
    places = places[outside]
    return places, np.where(_OPEN[raw[places]], 1, -1), len(quotes)


def _facts(file, begin: int, end: int) -> tuple[int, int, int]:
    """Quotes of a range, and its change of depth if it begins outside and if it begins inside a string."""
    data = _read(file, begin, end)
    _, steps, quotes = _brackets(data, 0)
    return quotes, int(steps.sum()), int(_brackets(data, 1)[1].sum())


def records_of(file, begin: int, end: int, size: int, inside: int, depth: int, level: int) -> Iterator[tuple[int, bytes, bytes | None, bytes | None]]:
    """Records that begin in a range at ``level``: place, text, and what stands before the first and after the last of the document.

    None for those two where a comma stands between this record and its neighbour; an empty text where something else does.
    """
    reach, data = end, _read(file, begin, end)
    places, steps, _ = _brackets(data, inside)
    depths = depth + np.cumsum(steps)
    raw = np.frombuffer(data, np.uint8)
    starts = places[(steps > 0) & (depths == level + 1) & (raw[places] == ord("{"))]
    if not len(starts):
        return
    beyond = BEYOND
    while True:
        ends = places[(steps < 0) & (depths == level)] + 1
        last = ends[ends > starts[-1]]
        behind = data[last[0]:].lstrip(b" \t\r\n") if len(last) else b""
        if reach >= size or len(last) and behind and (behind[:1] != b"," or behind[1:].lstrip(b" \t\r\n")):
            break
        reach, beyond = min(size, reach + beyond), 2 * beyond
        data = _read(file, begin, reach)
        places, steps, _ = _brackets(data, inside)
        depths = depth + np.cumsum(steps)
    for n, start in enumerate(starts.tolist()):
        close = ends[np.searchsorted(ends, start, side="right"):][:1]
        if not len(close):
            yield begin + start, data[start:], b"", b""
            return
        stop = int(close[0])
        head = tail = None
        if begin + start <= FRAME and depth_before(file, begin + start, level):
            head = _read(file, 0, begin + start)
        rest = data[stop:stop + FRAME]
        gap = rest.lstrip(b" \t\r\n")
        if gap[:1] != b"," or gap[1:].lstrip(b" \t\r\n")[:1] != b"{":
            tail = _read(file, begin + stop, size) if size - begin - stop <= FRAME else b""
        yield begin + start, data[start:stop], head, tail


def depth_before(file, place: int, level: int) -> bool:
    """Whether no record begins before ``place``: nothing opens beyond ``level`` there."""
    _, steps, _ = _brackets(_read(file, 0, place), 0)
    return bool(np.cumsum(steps).max(initial=0) <= level)


def _frame_is_whole(head: bytes, tail: bytes) -> bool:
    document = _parsed(head + b"{}" + tail)
    return document == [{}] or isinstance(document, dict) and document.get("Records") == [{}]


def _parsed(text: bytes):
    def unknown(name):
        raise ValueError(name)

    try:
        return json.loads(text.decode("utf-8", "replace"), parse_constant=unknown)
    except (ValueError, RecursionError):
        return None


def cut(spark: SparkSession, sources: list[str], workspace: Workspace, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, list[str]]:
    """``(source, line_number, line)``, the records of the documents in order, and the files that are no such documents.

    ``sources`` are addresses of files that Arrow opens. A record longer than a range is read by one task; no other
    limit is set on files or records. The text is read by ranges, once for each step, and written nowhere.
    """
    sizes = {source: appended.size_of(source) for source in sources}
    ranges = [(s, at, min(at + range_bytes, n), n) for s, n in sizes.items() for at in range(0, n, range_bytes)]
    # Small files share tasks.
    parts = max(1, min(len(ranges), max(spark.sparkContext.defaultParallelism, sum(sizes.values()) // range_bytes)))
    asked = spark.createDataFrame(ranges, "source STRING, begin BIGINT, end BIGINT, size BIGINT").repartition(parts, "source", "begin")
    facts = workspace.keep(asked.mapInArrow(_measure, _schema(_FACTS)), "ranges")
    before = Window.partitionBy("source").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    entered = facts.withColumn("within", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    step = F.when(F.col("within") == 0, F.col("outside")).otherwise(F.col("inside"))
    entered = entered.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)))
    entered = workspace.keep(entered.select("source", "begin", "end", "size", "within", "depth", "level"), "entered")
    cuts = entered.repartition(parts, "source", "begin").mapInArrow(_record, _schema(_CUTS))
    # One row a range, with the little that stands around all records.
    counts = workspace.keep(cuts.groupBy("source", "begin").agg(
        F.count("*").alias("n"), F.min("sound").alias("sound"), F.count_if(F.col("head").isNotNull()).alias("heads"),
        F.count_if(F.col("tail").isNotNull()).alias("tails"), F.max("head").alias("head"), F.max("tail").alias("tail"),
    ), "counts")
    frames = counts.groupBy("source").agg(
        F.min("sound").alias("sound"), F.sum("heads").alias("heads"), F.sum("tails").alias("tails"), F.max("head").alias("head"), F.max("tail").alias("tail")
    )
    whole = frames.filter("sound and heads = 1 and tails = 1").select("source", "head", "tail")
    clean = {r["source"] for r in whole.toLocalIterator() if _frame_is_whole(r["head"], r["tail"])}
    good = spark.createDataFrame([(s,) for s in sorted(clean)], "source STRING")
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    offsets = counts.join(good, "source", "left_semi").select("source", "begin", offset)
    records = cuts.select("source", "begin", "at", "line").join(offsets, ["source", "begin"])
    # Spelt as Spark spells the items of a list it takes apart, without blanks.
    line = F.get(F.from_json(F.concat(F.lit("["), "line", F.lit("]")), "array<string>"), F.lit(0)).alias("line")
    return records.select("source", (F.col("offset") + F.col("at") + 1).alias("line_number"), line), sorted(set(sizes) - clean)


_FACTS = {"source": "string", "begin": "bigint", "end": "bigint", "size": "bigint", "quotes": "bigint", "outside": "bigint", "inside": "bigint", "level": "bigint"}
_CUTS = {"source": "string", "begin": "bigint", "at": "bigint", "line": "string", "sound": "boolean", "head": "binary", "tail": "binary"}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    values = zip(*rows) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(list(v), _ARROW[kind]) for v, kind in zip(values, columns.values())], names=list(columns))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            system, name = appended.opened(row["source"])
            with system.open_input_file(name) as file:
                begin, end = (settled_start(file, row[c]) if row[c] < row["size"] else row["size"] for c in ("begin", "end"))
                first = _read(file, 0, 4096).lstrip(b" \t\r\n")[:1]
                out.append((row["source"], begin, end, row["size"], *_facts(file, begin, end), 2 if first == b"{" else 1))
        yield _batch(out, _FACTS)


def _record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, name = appended.opened(row["source"])
            rows, held = [], 0
            with system.open_input_file(name) as file:
                found = records_of(file, row["begin"], row["end"], row["size"], row["within"], row["depth"], row["level"])
                for at, (_, text, head, tail) in enumerate(found):
                    rows.append((row["source"], row["begin"], at, text.decode("utf-8", "replace"), isinstance(_parsed(text), dict), head, tail))
                    held += len(text)
                    if len(rows) >= appended.BATCH_LINES or held >= appended.BATCH_BYTES:
                        yield _batch(rows, _CUTS)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, _CUTS)
