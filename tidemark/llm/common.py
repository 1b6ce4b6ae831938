"""What several of the operators share: reading tables, row identity, joins that stand hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.workspace import Workspace

#: Copies of the small side in a salted join; a key that holds a third of all rows then meets in this many tasks.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """Tells rows of one document id apart: rows of equal id and equal text are one document."""
    return F.xxhash64(F.col(text))


def packed(docs: DataFrame) -> DataFrame:
    """``row`` holds all columns, so that nothing an operator adds can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, whatever reads it.

    The optimizer puts a column's expression in the place that reads it, also within a function that runs for every
    element of an array; a generator of one row keeps it apart.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def remainder(spark_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: the fold of a document (null for a null id)."""
    return F.expr(f"crc32(cast(cast(`{spark_id}` as string) as binary)) % {int(modulus)}")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join with the rows of one key of ``left`` dealt over ``SALTS`` tasks; ``right`` has few rows a key.

    Nulls in the key never match. ``how``: inner or left.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(SALTS)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def hot_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], counts: DataFrame, how: str = "inner", total: int | None = None
) -> DataFrame:
    """As ``salted_join``, with copies only for the keys that hold more than a thousandth of the rows of ``left``.

    ``counts`` has ``on`` and ``n``, rows of ``left`` by key. There are fewer than a thousand such keys whatever the data,
    so the list of them is broadcast; all other keys are joined as they are. ``total`` is the number of rows of ``left`` or more,
    where it is known.
    """
    known = total is not None
    total = total if known else counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(total // 1000, 1000)).select(*on, F.lit(True).alias("_hot"))
    if not known and hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    copied = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")


def sampled(df: DataFrame, key: str, rows: int, seed: int = 11) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more), chosen by a hash of ``key``, whatever the table's size."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 40))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) < share)


def labelled(labels: DataFrame, name: str) -> DataFrame:
    """``doc_id``, ``label`` (0 or 1): one row per labelled document; equal halves of contrary labels count as 1."""
    known = labels.select("doc_id", F.col(name).cast("double").alias("label")).dropna()
    return known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def numbered(nodes: DataFrame, group: str, order: list[str], space: Workspace, name: str) -> DataFrame:
    """Add ``place`` (from 0 along ``order``, nulls first) and ``n``, the number of rows, both within ``group``.

    Equal rows get different places in any order. No task sorts more than a range of the rows, whatever the groups' sizes.
    """
    # A row's own number, last in the order, lets a range end between rows that are equal otherwise.
    keyed = nodes.withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    counted = (
        keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select(*nodes.columns, F.monotonically_increasing_id().alias("_counter"))
    )
    # The upper bits of the counter are the partition's number; written, since it need not be the same in a second run.
    stored = space.keep(counted, name).withColumn("_part", F.shiftright("_counter", 33))
    parts = stored.groupBy(group, "_part").agg(F.min("_counter").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = parts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_of"), "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"),
    )
    joined = stored.join(offsets, stored[group].eqNullSafe(offsets["_group"]) & (stored["_part"] == offsets["_of"]))
    return joined.select(*nodes.columns, (F.col("_counter") - F.col("_first") + F.col("_before")).alias("place"), "n")
