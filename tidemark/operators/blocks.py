"""Ordered computations over logs of any size.

A window over a whole log would put that log into one task. Here a log is cut into blocks of neighbouring lines (or
of neighbouring times); each block is ordered by itself, and what a block needs to know about the blocks before it is
worked out on a small table with one row per block and handed to the block by (log, block), the key the rows are
already partitioned by. Nothing depends on a table being small enough to broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = "_blk"
CARRIED = "_carried"



def with_block(df: DataFrame, position: str, width: int) -> DataFrame:
    # Integer arithmetic: a division in doubles would misplace positions beyond 2^53.
    return df.withColumn(BLOCK, F.expr(f"(`{position}` - pmod(`{position}`, {int(width)}L)) div {int(width)}L"))


def previous_values(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: list[str],
    width: int,
    initial: DataFrame | None = None,
) -> DataFrame:
    """``keys``, ``order`` and ``values`` with ``prev_<name>`` for the latter two: what the row before had, within ``keys``.

    ``initial`` holds one row per key with the same columns, standing before every row of ``df``.
    """
    taken = [order, *values]
    # One shuffle that both the rows and the blocks' last values are read from. Keys and order are never null; saying so
    # for both readers keeps their plans alike, which is what lets the second one reuse the first one's shuffle.
    present = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in [*keys, order]])
    rows = with_block(df.select(*keys, *taken).filter(present), order, width).repartition(*keys, BLOCK)
    tails = last_values(rows, [*keys, BLOCK], order, values)
    if initial is not None:
        tails = tails.unionByName(initial.select(*keys, F.lit(-1).cast("bigint").alias(BLOCK), *taken))
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    heads = (
        tails.withColumn("_next", F.lead(BLOCK).over(along))
        .filter(F.col("_next").isNotNull())
        .select(*keys, F.col("_next").alias(BLOCK), *[F.col(name).alias(f"_head_{name}") for name in taken])
    )
    local = Window.partitionBy(*keys, BLOCK).orderBy(order)
    lagged = rows.select("*", *[F.lag(name).over(local).alias(f"_lag_{name}") for name in taken])
    first_of_block = F.col(f"_lag_{order}").isNull()
    return lagged.join(heads, [*keys, BLOCK], "left").select(
        *keys,
        *taken,
        *[
            F.when(first_of_block, F.col(f"_head_{name}")).otherwise(F.col(f"_lag_{name}")).alias(f"prev_{name}")
            for name in taken
        ],
    )


def last_values(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The last row's values per key, as a partial aggregate (no ordering of the rows)."""
    return df.groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(name, order).alias(name) for name in values]
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: Column,
    name: str,
    how: str = "sum",
) -> DataFrame:
    """Add the running ``sum`` or ``max`` of ``value`` up to and including each row, within ``keys``.

    ``df`` carries its block number in ``_blk``; blocks must follow the same order as ``order``.
    """
    total = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("_value", value)
    totals = rows.groupBy(*keys, BLOCK).agg(total("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        totals.select(*keys, BLOCK, total("_total").over(before).alias("_value"), F.lit(True).alias(CARRIED))
        .filter(F.col("_value").isNotNull())
    )
    together = rows.withColumn(CARRIED, F.lit(False)).unionByName(heads, allowMissingColumns=True)
    local = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(F.col(CARRIED).desc(), *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        together.withColumn(name, total("_value").over(local)).filter(~F.col(CARRIED)).drop(CARRIED, "_value")
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], width: int, name: str) -> DataFrame:
    """Add the 1-based position of each row within ``keys``; ``order[0]`` is the line number that forms the blocks."""
    rows = with_block(df, order[0], width)
    return running(rows, keys, [F.col(c) for c in order], F.lit(1).cast("bigint"), name).drop(BLOCK)


def attach(facts: DataFrame, position: str, per_key: DataFrame, key: str, width: int) -> DataFrame:
    """Join one row of ``per_key`` to every fact of its key without sending a whole key to one task.

    The row is repeated for each block of ``position`` that holds facts, of any sign and size, and the join is on
    (key, block).
    """
    placed = with_block(facts, position, width)
    copies = placed.select(key, BLOCK).distinct().join(per_key, key)
    return placed.join(copies, [key, BLOCK]).drop(BLOCK)
