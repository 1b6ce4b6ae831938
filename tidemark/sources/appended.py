"""Lines of text files by byte ranges: a data source for files that are written to while they are read.

As a stream, an offset is the number of bytes taken from each file, always up to the end of a line; what follows it, a
line still being written, is held back. As a batch, files are read whole, a last line without an end included. Either
way the new bytes are cut into ranges that are read side by side; a range gives the lines that begin in it, so where
the cuts fall changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "appended_lines"
SCHEMA = "source STRING, seq BIGINT, line STRING"
PARTITION_BYTES = 64 * 1024 * 1024
CHUNK = 1 << 20
#: Lines and bytes of a batch handed to Spark.
BATCH_LINES, BATCH_BYTES = 10_000, 8 << 20


class AppendedLines(DataSource):
    """``source`` (the file), ``seq`` (the byte at which the line begins) and ``line``.

    Options: ``path``, a folder, a file or a pattern for the last part of the path; ``partitionBytes``; ``start``, for streams:
    ``earliest`` or ``latest``, which passes over the lines that the files hold at the start.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WholeFiles:
        return WholeFiles(dict(self.options))

    def streamReader(self, schema) -> GrowingFiles:
        return GrowingFiles(dict(self.options))


class _Ranges:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options.get("partitionbytes") or options.get("partitionBytes") or PARTITION_BYTES)
        self.start = options.get("start", "earliest")
        if self.start not in ("earliest", "latest"):
            raise ValueError(f"start must be earliest or latest, not {self.start}")

    def cut(self, source: str, begin: int, end: int) -> list[InputPartition]:
        return [InputPartition((source, at, min(at + self.size, end), end)) for at in range(begin, end, self.size)]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        source, begin, end, limit = partition.value
        at, lines, held = [], [], 0
        kinds = [pa.string(), pa.int64(), pa.string()]

        def batch():
            columns = [pa.array(c, k) for c, k in zip(([source] * len(at), at, lines), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["source", "seq", "line"])

        system, name = opened(source)
        with system.open_input_file(name) as file:
            for position, line in lines_between(file, begin, end, limit):
                at.append(position)
                lines.append(line.decode("utf-8", "replace"))
                held += len(line)
                if len(at) >= BATCH_LINES or held >= BATCH_BYTES:
                    yield batch()
                    at, lines, held = [], [], 0
        if at:
            yield batch()


class WholeFiles(_Ranges, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        cuts = [cut for source, size in sorted(listed(self.path).items()) for cut in self.cut(source, 0, size)]
        return cuts or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator:
        return super().read(partition) if partition.value else iter(())


class GrowingFiles(_Ranges, DataSourceStreamReader):
    """A file that became shorter than what was taken from it was replaced, and is read from its beginning."""

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.start == "latest" else {}

    def latestOffset(self) -> dict:
        ends = {}
        for source, size in listed(self.path).items():
            system, name = opened(source)
            with system.open_input_file(name) as file:
                ends[source] = last_line_end(file, min(size, file.size()))
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        cuts = []
        for source, upto in sorted(end.items()):
            taken = start.get(source, 0)
            cuts += self.cut(source, taken if taken <= upto else 0, upto)
        return cuts

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def opened(source: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(source)


def size_of(source: str) -> int:
    system, name = opened(source)
    return system.get_file_info(name).size or 0


def listed(path: str) -> dict[str, int]:
    """Address and size of each file; names that begin with ``_`` or ``.`` are passed over, as Spark does."""
    from pyarrow import fs

    folder, pattern = path.rstrip("/"), None
    if any(c in folder.rsplit("/", 1)[-1] for c in "*?["):
        folder, pattern = folder.rsplit("/", 1)
    # An absolute path is not an address yet: signs like % in it mean themselves.
    system, name = (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)
    scheme = "file" if isinstance(system, fs.LocalFileSystem) else folder.split(":", 1)[0]
    entry = system.get_file_info(name)
    if entry.type == fs.FileType.NotFound:
        return {}
    entries = [entry] if entry.is_file else system.get_file_info(fs.FileSelector(name))
    wanted = [e for e in entries if e.is_file and e.base_name[0] not in "_." and (pattern is None or fnmatch(e.base_name, pattern))]
    return {address(scheme, e.path): e.size for e in wanted}


def address(scheme: str, path: str) -> str:
    from urllib.parse import quote

    return f"{scheme}://{quote(path)}" if scheme == "file" else f"{scheme}://{path.lstrip('/')}"


def last_line_end(file, size: int) -> int:
    """The byte after the last whole line; a carriage return that ends the file may be half of a line's end."""
    end = size
    while end > 0:
        begin = max(0, end - CHUNK)
        file.seek(begin)
        data = file.read(end - begin)
        found = max(data.rfind(b"\n"), data.rfind(b"\r", 0, len(data) - (end == size)))
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def lines_between(file, begin: int, end: int, limit: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the lines that begin in ``begin`` to ``end`` of a file of which ``limit`` bytes are read.

    Lines end at ``\\n``, ``\\r`` or ``\\r\\n``. Memory is a chunk or the longest line.
    """
    # The byte before the range tells whether a line begins with it; what that byte belongs to is left to another range.
    at = max(begin - 1, 0)
    skip = begin > 0
    file.seek(at)
    rest, wanted = b"", CHUNK
    while at < end:
        data = file.read(min(wanted, limit - at - len(rest)))
        whole = not data
        data = rest + data
        if not data:
            return
        pieces = data.splitlines(keepends=True)
        ended = pieces[-1].endswith(b"\n")
        rest = b"" if whole or ended else pieces.pop()
        # A line longer than what is held is read in growing steps, so that it is not joined too often.
        wanted = CHUNK if pieces else 2 * len(rest)
        for piece in pieces:
            if at >= end:
                return
            if skip:
                skip = False
            else:
                yield at, piece.rstrip(b"\n").removesuffix(b"\r") if piece.endswith(b"\n") else piece.removesuffix(b"\r")
            at += len(piece)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendedLines)
