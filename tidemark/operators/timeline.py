"""Running totals along time, cut where the rows are.

Blocks of equal time would be as uneven as time is: a busy minute is one block, ten sparse years are millions. Here the
rows are range-partitioned by their instants, which Spark does by quantiles of a sample, so that a block holds about
half of ``block_lines`` rows wherever they lie. What a block needs of those before it is a total of one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import blocks
from tidemark.operators.blocks import BLOCK
from tidemark.settings import Settings
from tidemark.workspace import Workspace

#: Tasks that the rows of one key are dealt over when they read a value of that key.
SALTS = 256


def placed(line: DataFrame, keys: list[str], order: list[str], settings: Settings, workspace: Workspace) -> DataFrame:
    """``line`` with block numbers that follow ``keys`` and ``order``, a block holding about half of ``block_lines`` rows.

    The blocks are written before they are read twice: a second partitioning need not draw the same sample.
    """
    stored = workspace.keep(line, "line")
    parts = -(-2 * stored.count() // settings.block_lines)
    if parts <= 1:
        return stored.withColumn(BLOCK, F.lit(0).cast("bigint"))
    cut = stored.repartitionByRange(parts, *keys, *order).withColumn(BLOCK, F.spark_partition_id().cast("bigint"))
    return workspace.keep(cut, "blocks")


def running(
    line: DataFrame, keys: list[str], order: list[str], value: str, name: str, how: str, settings: Settings, workspace: Workspace
) -> DataFrame:
    """Add the running ``sum`` or ``max`` of ``value`` along ``order`` (which has no ties), within ``keys`` if there are any."""
    cut = placed(line, keys, order, settings, workspace)
    return blocks.running(cut, keys, [F.col(c) for c in order], F.col(value), name, how)


def read_off(facts: DataFrame, on: dict[str, str], values: DataFrame, spread_by: list[str]) -> DataFrame:
    """Join to each fact the row of ``values`` whose columns (the names in ``on``) equal the fact's, nulls included.

    Facts that share a key are dealt over many tasks by ``spread_by``. A value gets a copy for each of those that has facts, so a
    key with one fact costs one. The key columns of ``values`` are dropped.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(SALTS)).cast("int")
    placed = facts.withColumn("_salt", salt)
    asked = placed.select(*[F.col(mine).alias(f"_of_{mine}") for mine in on], F.col("_salt").alias("_at_salt")).distinct()
    met = asked.join(values, _same(asked, {f"_of_{mine}": theirs for mine, theirs in on.items()}, values)).drop(*on.values())
    joined = placed.join(met, _same(placed, {mine: f"_of_{mine}" for mine in on}, met) & (placed["_salt"] == met["_at_salt"]))
    return joined.drop("_salt", "_at_salt", *[f"_of_{mine}" for mine in on])


def _same(left: DataFrame, on: dict[str, str], right: DataFrame) -> Column:
    condition = F.lit(True)
    for mine, theirs in on.items():
        condition = condition & left[mine].eqNullSafe(right[theirs])
    return condition
