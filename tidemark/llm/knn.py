"""Exact top-k by inner product as a Voronoi join.

Data and queries are grouped by their nearest pivot. Of each group of data the number, and the radius around its pivot,
are known; of each query a score that at least k candidates reach is known from a bounded sample of the data. No vector
of a group scores more than the pivot's score plus the query's length times the radius, so a group of data goes only to
those groups of queries of which some query could find a better candidate in it.

Rows travel packed in chunks. Groups of data make up parts and groups of queries blocks, large groups several of them, and
each meeting of a part and a block is one stretch of a task's sorted input: the block is held, of bounded size, while the
part's chunks pass by. Neither side is ever broadcast or gathered whole, and both are copied once a meeting only. A meeting
yields k candidates a query, and the best of these are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import sampled
from tidemark.workspace import Workspace

#: Vectors of the sample that pivots and bounds come from; queries per pivot aimed at, and the most pivots of one dimension.
SAMPLE = 2_000
QUERIES_PER_PIVOT = 256
MOST_PIVOTS = 256
#: At most so many vectors stand in a chunk of queries and in one of data, and so many components in either.
QUERY_CHUNK = 256
DATA_CHUNK = 4_096
CHUNK_VALUES = 1 << 21
#: Vectors that a task holds back to fill its chunks, of at most so many components.
HELD = 131_072
HELD_VALUES = 1 << 23
#: Most queries of one block, and their components, and most vectors of one part of the data.
QUERY_BLOCK = 65_536
BLOCK_VALUES = 1 << 23
DATA_BLOCK = 262_144
#: Products of one meeting aimed at; more where that would give more than so many meetings.
PRODUCTS = 1 << 28
MEETINGS = 96
#: Most tasks that meetings are dealt over.
MOST_TASKS = 4_096
#: Queries and vectors whose products are made at once, and candidates a query of these that are taken as they are.
TILE = 512
FEW = 64

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def scaled(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of each component as bigint; null for a null vector or one with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("bigint"))
    return F.when(F.col(vector).isNotNull() & finite, whole)


def _matrix(vectors, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), dim)


def _largest(a: np.ndarray) -> float:
    return max(float(a.max(initial=0)), -float(a.min(initial=0)))


def _exact(high: float) -> type:
    """The fastest type in which sums of products of whole numbers are exact, if no such sum leaves -high to high."""
    return np.float32 if high < 2.0**24 else np.float64 if high < 2.0**52 else np.int64


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where no sum can leave its exact range."""
    kind = _exact(_largest(a) * _largest(b) * max(1, a.shape[1]))
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Bounds:
    """Pivots, the groups' radii and the sample, of vectors of one dimension."""

    def __init__(self, sample_ids: np.ndarray, sample: np.ndarray, pivots: int):
        self.ids, self.sample = sample_ids, sample
        chosen = [0]
        nearest = ((sample - sample[0]).astype(float) ** 2).sum(axis=1)
        while len(chosen) < min(pivots, len(sample)):  # each the farthest from those before
            chosen.append(int(np.argmax(nearest)))
            nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]).astype(float) ** 2).sum(axis=1))
        self.pivots = sample[chosen].astype(float)
        self.radius = np.full(len(chosen), -np.inf)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and the distance to it."""
        rows = rows.astype(float)
        squares = (rows**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * rows @ self.pivots.T
        best = np.argmin(squares, axis=1)
        return best, np.sqrt(((rows - self.pivots[best]) ** 2).sum(axis=1))

    def needed(self, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """For each query and pivot: whether the pivot's group may hold one of the query's best k."""
        return self.above(rows, self.reached(ids, rows, k))

    def reached(self, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k other ids of the sample reach; the least number where it has fewer."""
        # An id counts once.
        if len(np.unique(self.ids)) < len(self.ids) or len(self.ids) <= k:
            return np.full(len(rows), LEAST)
        reached = np.zeros(len(rows), np.int64)
        for at in range(0, len(rows), TILE):
            scores = _products(rows[at : at + TILE], self.sample)
            scores[ids[at : at + TILE, None] == self.ids[None, :]] = LEAST
            reached[at : at + TILE] = np.partition(scores, -k, axis=1)[:, -k]
        return reached

    def above(self, rows: np.ndarray, reached: np.ndarray) -> np.ndarray:
        """For each query and pivot: whether a vector of the pivot's group may score ``reached``."""
        rows, reached = rows.astype(float), np.where(reached == LEAST, -np.inf, reached.astype(float))
        above = rows @ self.pivots.T + np.linalg.norm(rows, axis=1)[:, None] * np.maximum(self.radius, 0)[None, :]
        # Room for rounding, so that no group is left out for it.
        slack = 1.0 + 1e-9 * (np.abs(above) + np.where(np.isfinite(reached), np.abs(reached), 0.0)[:, None])
        return (above + slack >= reached[:, None]) & np.isfinite(self.radius)[None, :]


def top_k(data: DataFrame, queries: DataFrame, k: int, space: Workspace) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` best, ties to the smaller vec_id.

    ``data`` and ``queries`` have ``vec_id`` and ``vector`` (array of bigint). Null vectors and null ids take no part.
    An id is never its own candidate and counts once, with its best score, however many rows it has; a repeated query
    gives one result. Vectors meet only vectors of equal length. Fewer candidates give fewer ranks; empty tables an
    empty result. Products must fit 64 bits. Other columns may have any names.
    """
    spark: SparkSession = data.sparkSession
    rows = space.keep(_usable(data), "data")
    asked = space.keep(_usable(queries), "queries")
    sample = _sample(rows)
    n_queries = asked.count()
    pivots = max(1, min(MOST_PIVOTS, -(-n_queries // QUERIES_PER_PIVOT)))
    bounds: dict[int, Bounds] = {}
    dims = {r["dim"] for r in rows.select("dim").distinct().collect()}
    for dim in sorted(dims):
        part = sample[sample["dim"] == dim]
        if not len(part):  # a rare length that the sample missed
            part = rows.filter(F.col("dim") == dim).orderBy("vec_id").limit(1).toPandas()
        bounds[dim] = Bounds(part["vec_id"].to_numpy(np.int64), _matrix(part["vector"], dim), pivots)
    data_chunks = space.keep(_chunks(rows, spark.sparkContext.broadcast(bounds)), "data_chunks")
    # One row per pivot.
    groups = data_chunks.groupBy("dim", "pivot").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    for r in groups:
        bounds[r["dim"]].radius[r["pivot"]] = r["radius"]
    shipped = spark.sparkContext.broadcast(bounds)
    asked = asked.filter(F.col("dim").isin(sorted(dims))) if dims else asked.limit(0)
    query_chunks = space.keep(_chunks(asked, shipped, k), "query_chunks")
    # One row per pivot, with pivots.
    askers = query_chunks.groupBy("dim", "pivot").agg(
        F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("needs"))).alias("needs")
    ).collect()
    plan = _Plan(groups, askers)
    given = data_chunks.drop("radius", "needs", "mask").join(F.broadcast(plan.given(spark)), ["dim", "pivot"])
    given = given.select(
        "dim", _one("first", "parts").alias("part"), F.explode("blocks").alias("block"), F.lit(1).alias("side"), "pivot", "n", "ids",
        "vectors", "width", F.lit(None).cast("binary").alias("floors"), F.lit(None).cast("binary").alias("mask"),
    )
    held = query_chunks.drop("radius").join(F.broadcast(plan.held(spark)), ["dim", "pivot"])
    held = held.join(F.broadcast(plan.parts(spark)), "dim")
    parts = F.flatten(F.transform("needs", lambda p: F.sequence(F.get("firsts", p), F.get("lasts", p))))
    held = held.select(
        "dim", F.explode(F.array_distinct(parts)).alias("part"), _one("first", "blocks").alias("block"), F.lit(0).alias("side"), "pivot",
        "n", "ids", "vectors", "width", "floors", "mask",
    )
    meeting = ["dim", "part", "block"]
    met = given.unionByName(held).repartition(plan.tasks, *meeting).sortWithinPartitions(*meeting, "side", "pivot")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            of = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                key = tuple(of[name][i].as_py() for name in meeting)
                if key != at:
                    if block is not None:
                        yield from block.found()
                    at, block = key, _Block(key[0], k)
                ids, vectors = _unpacked(of, i, key[0])
                if of["side"][i].as_py():
                    block.meet(of["pivot"][i].as_py(), ids, vectors)
                else:
                    block.add(ids, vectors, np.frombuffer(of["floors"][i].as_py(), np.int64), of["mask"][i].as_py())
        if block is not None:
            yield from block.found()

    each = met.mapInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _usable(vectors: DataFrame) -> DataFrame:
    known = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "vector").dropna()
    return known.select("vec_id", "vector", F.size("vector").alias("dim"))


def _sample(rows: DataFrame):
    """A sample of ids, each with one of its vectors; in the driver's memory, so bounded even if an id has most of the rows."""
    found = sampled(rows, "vec_id", SAMPLE).orderBy("dim", "vec_id").limit(4 * SAMPLE).toPandas()
    return found.drop_duplicates(["dim", "vec_id"])


def _one(first: str, number: str) -> Column:
    """One of ``number`` places from ``first`` on, by the chunk."""
    return (F.col(first) + F.pmod(F.xxhash64("chunk"), F.col(number))).cast("int")


def _packed(ids: np.ndarray, rows: np.ndarray) -> dict:
    """Columns of a chunk: ids in order, vectors in the narrowest type that holds them."""
    order = np.argsort(ids, kind="stable")
    high = _largest(rows)
    kind = next((t for t in (np.int8, np.int16, np.int32) if high <= np.iinfo(t).max), np.int64)
    return {"n": len(ids), "ids": ids[order].tobytes(), "vectors": rows[order].astype(kind).tobytes(), "width": np.dtype(kind).itemsize}


def _unpacked(of: dict, i: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(of["ids"][i].as_buffer(), np.int64)
    vectors = np.frombuffer(of["vectors"][i].as_buffer(), f"i{of['width'][i].as_py()}") if dim else np.zeros(0, np.int8)
    return ids, vectors.reshape(len(ids), dim)


def _chunks(rows: DataFrame, shipped, k: int | None = None) -> DataFrame:
    """Chunks of rows of one length and nearest ``pivot``: data with its largest distance, or, given ``k``, queries.

    Chunks of queries have each query's score that ``k`` others reach and the pivots that any of them ``needs``, as a list
    and as bits. A task packs its own rows, so no group is gathered in one place.
    """
    size = DATA_CHUNK if k is None else QUERY_CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = defaultdict(list)
        numbers: dict[tuple[int, int], int] = defaultdict(int)
        made, held, values = TaskContext.get().partitionId() << 32, 0, 0

        def packed(dim: int, pivot: int, whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, held, values
            columns = [np.concatenate(c) for c in zip(*waiting.pop((dim, pivot)))]
            most = max(1, min(size, CHUNK_VALUES // max(dim, 1)))
            rest = 0 if whole else len(columns[0]) % most
            numbers[dim, pivot] = rest
            upto = len(columns[0]) - rest
            if rest:
                waiting[dim, pivot].append([c[upto:] for c in columns])
            held, values = held - upto, values - upto * dim
            for at in range(0, upto, most):
                ids, vectors, extra = (c[at : min(at + most, upto)] for c in columns)
                row = {"dim": dim, "pivot": pivot, "chunk": made} | _packed(ids, vectors)
                if k is None:
                    row |= {"radius": float(extra.max())}
                else:
                    needed = shipped.value[dim].above(vectors, extra).any(axis=0)
                    row |= {"floors": extra[np.argsort(ids, kind="stable")].tobytes(), "mask": np.packbits(needed).tobytes()}
                    row |= {"needs": np.nonzero(needed)[0].tolist()}
                made += 1
                yield pa.RecordBatch.from_pylist([row], CHUNK)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                known: Bounds = shipped.value[dim]
                part = batch.filter(pa.array(dims == dim))
                ids = part.column("vec_id").to_numpy()
                matrix = part.column("vector").flatten().to_numpy().reshape(len(ids), dim)
                pivot, distance = known.nearest(matrix)
                extra = distance if k is None else known.reached(ids, matrix, k)
                order = np.argsort(pivot, kind="stable")
                starts = np.concatenate(([0], np.nonzero(np.diff(pivot[order]))[0] + 1, [len(order)])).tolist()
                for a, b in zip(starts, starts[1:]):
                    key, own = (dim, int(pivot[order[a]])), order[a:b]
                    waiting[key].append([ids[own], matrix[own], extra[own]])
                    numbers[key] += b - a
                    held, values = held + b - a, values + (b - a) * dim
                    if numbers[key] >= size or numbers[key] * dim >= CHUNK_VALUES:
                        yield from packed(*key, whole=False)
            if held > HELD or values > HELD_VALUES:
                for key in list(waiting):
                    yield from packed(*key, whole=True)
        for key in list(waiting):
            yield from packed(*key, whole=True)

    return rows.mapInArrow(
        run, "dim int, pivot int, chunk bigint, n bigint, ids binary, vectors binary, width int, radius double, floors binary, mask binary, "
        "needs array<int>",
    )


INT, LONG = pa.int32(), pa.int64()
CHUNK = pa.schema([
    ("dim", INT), ("pivot", INT), ("chunk", LONG), ("n", LONG), ("ids", pa.binary()), ("vectors", pa.binary()), ("width", INT),
    ("radius", pa.float64()), ("floors", pa.binary()), ("mask", pa.binary()), ("needs", pa.list_(INT)),
])


def _spread(groups: list[tuple[int, int]], most: int) -> tuple[dict[int, tuple[int, int]], int]:
    """First place and number of places of each group of (pivot, rows), and all places: about ``most`` rows go to a place."""
    places, at, filled = {}, -1, most
    for pivot, n in sorted(groups):
        if n >= most:
            places[pivot] = (at + 1, -(-n // most))
            at, filled = at + places[pivot][1], most
            continue
        if filled + n > most:
            at, filled = at + 1, 0
        places[pivot] = (at, 1)
        filled += n
    return places, at + 1


class _Plan:
    """Parts of the data and blocks of queries. ``groups``, ``askers``: a row per pivot, at most ``MOST_PIVOTS`` of a length."""

    def __init__(self, groups: list, askers: list):
        given, asking = defaultdict(list), defaultdict(list)
        for r in groups:
            given[r["dim"]].append((r["pivot"], r["n"]))
        for r in askers:
            asking[r["dim"]].append(r)
        self._given, self._held, self._parts, meetings = [], [], [], 0
        for dim, asks in asking.items():
            n, m = sum(n for _, n in given[dim]), sum(r["n"] for r in asks)
            blocks, n_blocks = _spread([(r["pivot"], r["n"]) for r in asks], max(1, min(QUERY_BLOCK, BLOCK_VALUES // max(dim, 1))))
            products = max(PRODUCTS, n * m // MEETINGS)
            parts, n_parts = _spread(given[dim], max(1, min(DATA_BLOCK, products // -(-m // n_blocks))))
            needing = defaultdict(set)
            for r in asks:
                first, number = blocks[r["pivot"]]
                self._held.append((dim, r["pivot"], first, number))
                for p in r["needs"]:
                    needing[p].update(range(first, first + number))
            self._given += [(dim, p, *parts[p], sorted(needing[p])) for p, _ in given[dim] if needing[p]]
            ends = [parts.get(p, (0, 1)) for p in range(max(parts) + 1)]
            self._parts.append((dim, [a for a, _ in ends], [a + number - 1 for a, number in ends]))
            meetings += n_blocks * n_parts
        self.tasks = max(1, min(MOST_TASKS, meetings))

    def given(self, spark: SparkSession) -> DataFrame:
        """For each pivot's data the parts they are dealt to and the blocks that need them."""
        return _rows(spark, self._given, dim=INT, pivot=INT, first=INT, parts=INT, blocks=pa.list_(INT))

    def held(self, spark: SparkSession) -> DataFrame:
        """For each pivot's queries the blocks they are dealt to."""
        return _rows(spark, self._held, dim=INT, pivot=INT, first=INT, blocks=INT)

    def parts(self, spark: SparkSession) -> DataFrame:
        """For each length the first and last part of each pivot's data."""
        return _rows(spark, self._parts, dim=INT, firsts=pa.list_(INT), lasts=pa.list_(INT))


def _rows(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A table that the driver holds, read without tasks of its own."""
    schema = pa.schema(list(kinds.items()))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds, r)) for r in rows], schema))


class _Block:
    """A block of queries and the best k candidates of each so far, while chunks of data pass by."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k, self.added, self.rows = dim, k, [], None

    def add(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, mask: bytes) -> None:
        """Hold a chunk of queries; ``mask`` has a bit for each pivot."""
        self.added.append((ids, vectors, floors, np.unpackbits(np.frombuffer(mask, np.uint8)).astype(bool)))

    def _settle(self) -> None:
        self.ids = np.concatenate([a[0] for a in self.added])
        self.rows = np.concatenate([a[1] for a in self.added])
        self.high = _largest(self.rows)
        self.typed: dict[type, np.ndarray] = {}
        # The score and id to be beaten: of the k-th best so far, or of no known id what the sample reaches.
        self.least = np.concatenate([a[2] for a in self.added])
        self.last = np.full(len(self.ids), MOST)
        self.lengths, self.needs = [len(a[0]) for a in self.added], np.stack([a[3] for a in self.added])
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple] = []
        self.n_new, self.added = 0, []
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting, self.of = 0, None

    def meet(self, pivot: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take the candidates of a chunk of a pivot's data."""
        if self.rows is None:
            if not self.added:
                return
            self._settle()
        need = self.needs[:, pivot]
        if self.waiting and not np.array_equal(need, self.of):
            self._meet()
        self.of = need
        self.waiting.append((ids, vectors))
        self.n_waiting += len(ids)
        if self.n_waiting >= DATA_CHUNK or self.n_waiting * self.dim >= CHUNK_VALUES:
            self._meet()

    def _meet(self) -> None:
        """Candidates of the chunks that wait, which the same queries need."""
        if not self.waiting:
            return
        ids, vectors = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        kind = _exact(self.high * _largest(vectors) * max(1, self.dim))
        if kind not in self.typed:
            self.typed[kind] = self.rows.astype(kind)
        vectors = np.ascontiguousarray(vectors.astype(kind).T)
        unique = bool((ids[1:] != ids[:-1]).all())
        # The places of the queries, unless all need the group.
        chosen = None if self.of.all() else np.nonzero(np.repeat(self.of, self.lengths))[0]
        n = len(self.ids) if chosen is None else len(chosen)
        for at in range(0, n, TILE):
            places = np.arange(at, min(at + TILE, n)) if chosen is None else chosen[at : at + TILE]
            rows = self.typed[kind][at : at + TILE] if chosen is None else self.typed[kind][places]
            self._take(places, rows @ vectors, ids, unique)
            if self.n_new > max(self.k * len(self.ids), 1 << 16):
                self._reduce()

    def _take(self, places: np.ndarray, scores: np.ndarray, ids: np.ndarray, unique: bool) -> None:
        # Where all ids are larger than the k-th best's, its score does not do.
        least = self.least[places]
        least = np.where(self.last[places] < ids[0], np.minimum(least, MOST - 1) + 1, least)
        good = scores >= least.astype(scores.dtype)[:, None]
        own = self.ids[places]
        first, after = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for r in np.nonzero(first < after)[0].tolist():
            good[r, first[r] : after[r]] = False
        if np.count_nonzero(good) > FEW * len(places):
            for r in np.nonzero(np.count_nonzero(good, axis=1) > FEW)[0].tolist():
                near, mine = _best(ids[good[r]], scores[r][good[r]], self.k, unique)
                good[r] = False
                self._keep(np.full(len(near), places[r]), near, mine)
            self._keep(*self._where(places, good, ids, scores))
            self._reduce()
        else:
            self._keep(*self._where(places, good, ids, scores))

    @staticmethod
    def _where(places: np.ndarray, good: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple:
        row, column = np.divmod(np.flatnonzero(good), good.shape[1])
        return places[row], ids[column], scores[row, column]

    def _keep(self, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            self.new.append((places, ids, scores.astype(np.int64)))
            self.n_new += len(ids)

    def _reduce(self) -> None:
        """The best k of each query, an id once, out of those before and the new candidates."""
        if not self.new:
            return
        place, ids, scores = (np.concatenate(c) for c in zip(self.best, *self.new))
        self.new, self.n_new = [], 0
        # ~x orders as -x does, and has no number that it cannot hold.
        order = np.lexsort((~scores, ids, place))
        place, ids, scores = place[order], ids[order], scores[order]
        once = np.ones(len(ids), bool)
        once[1:] = (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])
        place, ids, scores = place[once], ids[once], scores[once]
        order = np.lexsort((ids, ~scores, place))
        place, ids, scores = place[order], ids[order], scores[order]
        starts = np.nonzero(np.concatenate(([True], place[1:] != place[:-1])))[0]
        rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.append(starts, len(place))))
        kept = rank < self.k
        self.best = place[kept], ids[kept], scores[kept]
        full = rank == self.k - 1
        self.least[place[full]], self.last[place[full]] = scores[full], ids[full]

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.rows is None:
            return
        self._meet()
        self._reduce()
        place, ids, scores = self.best
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (self.ids[place], ids, scores)], names=["query_id", "vec_id", "score"]
        )


def _best(ids: np.ndarray, scores: np.ndarray, k: int, unique: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k best of candidates in the order of their ids, an id once, ties to the smaller id."""
    if not unique:
        starts = np.nonzero(np.concatenate(([True], ids[1:] != ids[:-1])))[0]
        ids, scores = ids[starts], np.maximum.reduceat(scores, starts)
    if len(ids) > k:
        near = np.nonzero(scores >= np.partition(scores, -k)[-k])[0]
        # In place of -scores, which has no room for the least number.
        order = np.lexsort((near, ~scores[near].astype(np.int64)))[:k]
        ids, scores = ids[near[order]], scores[near[order]]
    return ids, scores
