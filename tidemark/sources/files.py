"""Log files: numbered text lines, audit documents and custody hashes."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.settings import Settings
from tidemark.sources import documents, normalize
from tidemark.workspace import Workspace

# Above this size, names of files included, the table of line offsets is no longer sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def path_list(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def raw_splits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with their file, the start of their split and a counter that grows along each split.

    Lines end at ``\\n``, ``\\r`` or ``\\r\\n``; bytes that are not UTF-8 are replaced.
    """
    return spark.read.text(path_list(paths)).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("counter"),
        F.make_valid_utf8("value").alias("line"),
    )


def with_line_numbers(
    stored: DataFrame, workspace: Workspace, split_order: tuple[str, ...] = ("split_start",)
) -> DataFrame:
    """Turn the place of each line in its split into ``line_number``, counted from 1 over each whole source.

    A split is read from front to back by one task, so the counter's distance from the split's first line is the place
    within it, and the lines of the splits before are a sum over a table with one row per split. ``stored`` must be a
    written table: the counter is not the same from one read of a text file to the next.
    """
    split = ["source", *split_order]
    offsets = _offsets(stored, split, workspace)
    number = F.col("counter") - F.col("first_counter") + F.col("offset") + 1
    return (
        stored.join(_hinted(offsets), split)
        .withColumn("line_number", number)
        .drop(*split_order, "counter", "first_counter", "n_lines", "offset")
    )


def _offsets(lines: DataFrame, split: list[str], workspace: Workspace) -> DataFrame:
    """Per split its first counter, its number of lines and those of the splits before it in its source."""
    per_split = lines.groupBy(*split).agg(F.min("counter").alias("first_counter"), F.count(F.lit(1)).alias("n_lines"))
    before = Window.partitionBy("source").orderBy(*split[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("offset")
    return workspace.keep(per_split.select(*split, "first_counter", "n_lines", offset), "line_offsets")


def _hinted(offsets: DataFrame) -> DataFrame:
    size = offsets.agg(F.sum(F.octet_length("source") + 40)).first()[0] or 0
    return F.broadcast(offsets) if size <= BROADCAST_BYTES else offsets


def read_text_lines(spark: SparkSession, paths: str | list[str], workspace: Workspace) -> DataFrame:
    """``(source, line_number, line)`` over all lines of all files, blank ones included.

    The text is read twice and written nowhere: once to count the lines of each split, once to number them. Spark cuts
    the same files alike both times; should that ever fail, because files or the cluster's size changed between the two, the run ends
    with an error, as a line then has no place in the counts.
    """
    raw = raw_splits(spark, paths)
    split = ["source", "split_start"]
    numbered = raw.join(_hinted(_offsets(raw, split, workspace)), split, "left")
    place = F.col("counter") - F.col("first_counter")
    counted = F.coalesce(place.between(0, F.col("n_lines") - 1), F.lit(False))
    number = F.when(counted, place + F.col("offset") + 1).otherwise(
        F.raise_error(F.concat(F.lit("cut otherwise than when its lines were counted: "), F.col("source"))).cast("bigint")
    )
    return numbered.select("source", number.alias("line_number"), "line")


def read_normalized(
    spark: SparkSession, paths: str | list[str], settings: Settings, workspace: Workspace, normalizer: normalize.Normalizer
) -> DataFrame:
    """Read and normalize in one pass over the text; numbering works on the narrow written result."""
    raw = raw_splits(spark, paths)
    if normalizer in (normalize.normalize_text, normalize.normalize_audit):
        return with_line_numbers(workspace.keep(normalizer(raw, settings), "lines"), workspace)
    return normalizer(read_text_lines(spark, paths, workspace), settings)


def raw_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Each file as one text: ``(source, document)``."""
    return spark.read.text(path_list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.make_valid_utf8("value").alias("document")
    )


def is_multi_line(document: Column) -> Column:
    """A document rather than one record per line, judged by its first line as the strict mode does."""
    first = F.trim(F.regexp_extract(document, r"^([^\r\n]*)", 1))
    return (first == "{") | (F.startswith(first, F.lit("{")) & ~F.endswith(first, F.lit("}")))


def by_form(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[str]]:
    """The files that are one JSON document each, and those of one record a line, judged by their first lines.

    Only the files' names reach the driver, which has listed them anyway.
    """
    firsts = (
        raw_splits(spark, paths)
        .filter(F.col("split_start") == 0)
        .groupBy("source")
        .agg(F.min_by("line", "counter").alias("line"))
        .select("source", is_multi_line(F.col("line")).alias("is_document"))
    )
    documents, lines = [], []
    for row in firsts.orderBy("source").toLocalIterator():
        (documents if row["is_document"] else lines).append(unquote(row["source"]))
    return documents, lines


def unpack_records(documents: DataFrame, strict: bool = False) -> DataFrame:
    """``(source, line_number, line)``: the records of JSON documents, numbered in order.

    A document is an object with a non-empty ``Records`` list, a list of records, or one record. One that cannot be
    parsed gives a single line numbered 0 with its whole text, which every normalizer rejects. ``strict`` unpacks objects
    only, gives nothing for a document that cannot be parsed, and writes each record anew in Python's JSON spelling.
    """
    body = F.trim(F.col("document"), F.lit(" \t\r\n"))
    whole = F.when(F.endswith(body, F.lit("}")), F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<struct<Records: variant>>", normalize.STRICT))
    as_object = F.from_json(body, "struct<Records: array<string>>", normalize.STRICT)
    as_list = F.from_json(body, "array<string>", normalize.STRICT)
    usable = F.startswith(body, F.lit("{")) & F.coalesce(F.size(whole) == 1, F.lit(False))
    records = F.when(
        usable,
        F.when(F.size(as_object["Records"]) > 0, as_object["Records"]).otherwise(F.array(body)),
    )
    if not strict:
        records = records.when(F.startswith(body, F.lit("[")), as_list)
    unpacked = documents.withColumn("_records", records)
    lines = unpacked.select("source", F.posexplode("_records").alias("_at", "line")).select(
        "source", (F.col("_at") + 1).cast("bigint").alias("line_number"), "line"
    )
    if strict:
        return lines.withColumn("line", _python_spelling()("line"))
    failed = unpacked.filter(F.col("_records").isNull()).select(
        "source", F.lit(0).cast("bigint").alias("line_number"), F.col("document").alias("line")
    )
    return lines.unionByName(failed)


def document_records(spark: SparkSession, paths: str | list[str], workspace: Workspace) -> DataFrame:
    """``(source, line_number, line)``: the records of JSON documents of any size, as ``unpack_records`` gives them.

    Files that tasks can read by ranges and that are a list of objects, alone or under ``Records``, are cut by many tasks; any
    other, broken ones among them, is taken as one text.
    """
    names = [row["source"] for row in file_names(spark, paths).toLocalIterator()]
    addressed = {re.sub("^file:/+", "file:///", name): name for name in names}
    ranged = [a for a in addressed if a.split(":", 1)[0] in documents.SCHEMES]
    found, odd = documents.cut(spark, ranged, workspace) if ranged else (None, [])
    if found is not None:
        # Files are named as a scan names them.
        found = found.withColumn("source", F.regexp_replace("source", "^file:///", "file:/"))
    rest = [unquote(a) for a in [*odd, *(a for a in addressed if a not in set(ranged))]]
    parts = ([found] if found is not None else []) + ([unpack_records(raw_documents(spark, rest))] if rest else [])
    return reduce(DataFrame.unionByName, parts) if parts else unpack_records(raw_documents(spark, paths))


def _python_spelling():
    def rewrite(lines):
        import json

        return lines.map(lambda line: json.dumps(json.loads(line)), na_action="ignore")

    import pandas as pd

    rewrite.__annotations__ = {"lines": pd.Series, "return": pd.Series}
    return F.pandas_udf(rewrite, "string")


def read_audit_documents(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """The audit records of multi-line JSON files, normalized."""
    return normalize.normalize_audit(unpack_records(raw_documents(spark, paths), strict))


# Files up to this size are hashed from one binary column; larger ones are read in chunks.
WHOLE_FILE_BYTES = 64 * 1024 * 1024
# Stores whose files can be read in chunks by the tasks, by the scheme of their address.
CHUNKED_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def file_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``source``: the names of the files, from their listing alone."""
    # A scan passes over files without content; the listing still names them.
    names = [re.sub("^file:///", "file:/", name) for name in spark.read.text(path_list(paths)).inputFiles()]
    return spark.createDataFrame([(name,) for name in names], "source STRING")


def custody_hashes(spark: SparkSession, paths: str | list[str], whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """``(source, sha256)`` of each file's bytes, files in parallel; ``N/A`` for one that is gone or closed to the reader.

    Files of stores that tasks can not read in chunks are hashed whole whatever their size. Any other failure to read
    ends the run.
    """
    files = spark.read.format("binaryFile").load(path_list(paths))
    source = F.col("_metadata.file_path").alias("source")
    scheme = F.regexp_extract(F.col("_metadata.file_path"), "^([a-z0-9]+):", 1)
    chunked = (F.col("length") > whole_file_bytes) & scheme.isin(list(CHUNKED_SCHEMES))
    small = files.filter(~chunked).select(source, F.sha2("content", 256).alias("sha256"))

    def hash_in_chunks(frames):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        for frame in frames:
            rows = []
            for path in frame["source"]:
                scheme, rest = path.split(":", 1)
                uri = f"{CHUNKED_SCHEMES[scheme]}:" + (rest if rest.startswith("//") else f"//{rest}")
                try:
                    if scheme == "file":
                        system, name = fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
                    else:
                        system, name = fs.FileSystem.from_uri(uri)
                    digest = hashlib.sha256()
                    with system.open_input_stream(name) as stream:
                        while chunk := stream.read(4 * 1024 * 1024):
                            digest.update(chunk)
                    rows.append((path, digest.hexdigest()))
                except (FileNotFoundError, PermissionError):
                    rows.append((path, "N/A"))
            yield pd.DataFrame(rows, columns=["source", "sha256"])

    large = files.filter(chunked).select(source).mapInPandas(hash_in_chunks, "source STRING, sha256 STRING")
    hashed = small.unionByName(large)
    listed = file_names(spark, paths)
    empty = listed.join(files.select(source), "source", "left_anti").withColumn("sha256", F.sha2(F.lit(b""), 256))
    return hashed.unionByName(empty)


def existing_paths(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Split paths (globs allowed) into those that exist and those that do not."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found, missing = [], []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        try:
            matches = target.getFileSystem(conf).globStatus(target)
            present = matches is not None and len(matches) > 0
        except Exception:
            present = False
        (found if present else missing).append(path)
    return found, missing
