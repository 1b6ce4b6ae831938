"""A Merkle manifest of a table of documents, by slot pivots.

Leaves are numbered within their source, so the parent of a node and its slot there are a division by the fanout. A
level is one conditional aggregate: it spreads the children of each parent into ``fanout`` columns, one per slot.
The columns joined are what the parent hashes; the columns joined without a child's own slot are that child's siblings.
So one pivot gives both the level above and the proofs below, and each level has a sixteenth of the rows of the one
under it. The roots of the sources are the leaves of one more tree of the same kind.

Numbering does not gather a source in one task: rows are range-partitioned by source and order, counted along each
partition, and a table with one row per partition and source gives the offsets. Proofs go down the levels from parents to
children; only pivots, one row per parent, are joined, and the leaves come out of the lowest pivot's columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import numbered
from tidemark.workspace import Workspace

FANOUT = 16
#: The values a leaf is hashed from, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two lists of values read alike; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(values[name]) for name in FIELDS]), 256)


def pivoted(nodes: DataFrame, group: str, payload: list[str], fanout: int) -> DataFrame:
    """One row per parent of nodes ``(group, place, n, *payload)``: ``c0`` to the last slot, each a struct of ``payload``.

    ``digest`` is the parent's own, from the children's ``digest``; ``n`` the number of parents in the group.
    """
    slot = F.pmod("place", F.lit(fanout))
    slots = [F.max(F.when(slot == s, F.struct(*payload))).alias(f"c{s}") for s in range(fanout)]
    parents = nodes.groupBy(F.col(group), F.expr(f"place div {fanout}").alias("place")).agg(
        F.first("n").alias("_n"), *slots
    )
    return parents.withColumns({
        "digest": F.sha2(_joined([F.col(f"c{s}.digest") for s in range(fanout)]), 256),
        "n": F.expr(f"(_n + {fanout - 1}) div {fanout}"),
    }).drop("_n")


def _joined(digests: list[Column]) -> Column:
    return F.concat_ws("", *digests) if digests else F.lit("")


def _children(parents: DataFrame, group: str, carried: list[str], fanout: int) -> DataFrame:
    """The nodes under pivoted ``parents``, with ``steps`` (their siblings here, then the parents' ``steps``) and ``carried``."""
    digests = [F.col(f"c{s}.digest") for s in range(fanout)]

    def child(s: int) -> Column:
        step = F.struct(_joined(digests[:s]).alias("before"), _joined(digests[s + 1:]).alias("after"))
        return F.when(F.col(f"c{s}").isNotNull(), F.struct(
            (F.col("place") * fanout + s).alias("place"), F.col(f"c{s}").alias("node"),
            F.concat(F.array(step), "steps").alias("steps"),
        ))

    children = F.array_compact(F.array(*[child(s) for s in range(fanout)]))
    spread = parents.select(group, *carried, F.explode(children).alias("child"))
    return spread.select(group, *carried, "child.place", "child.node.*", "child.steps")


def tree(nodes: DataFrame, group: str, payload: list[str], fanout: int, space: Workspace) -> tuple[DataFrame, list[DataFrame]]:
    """``(group, digest)`` of each group's top, and the pivots from the lowest level up.

    ``nodes`` hold ``group``, ``place``, ``n`` and ``payload``, of which ``digest`` is one. A group of one node is its own top.
    """
    tops, pivots = [nodes.filter("n = 1").select(group, "digest")], []
    while True:
        level = nodes.filter("n > 1")
        parents = space.keep(pivoted(level, group, payload, fanout), "pivot")
        if parents.isEmpty():
            return reduce(DataFrame.unionByName, tops), pivots
        pivots.append(parents)
        payload = ["digest"]
        nodes = parents.select(group, "place", "n", "digest")
        tops.append(nodes.filter("n = 1").select(group, "digest"))


def paths(pivots: list[DataFrame], group: str, ends: DataFrame, fanout: int) -> DataFrame:
    """The lowest pivots' nodes with ``steps``, their siblings before and after, level by level, and then those of ``ends``.

    ``ends`` has one row per ``group``: the ``steps`` above the group's top and columns to carry down. Groups that are a
    single node have no pivot and no row. Every join meets one row per parent with one row per parent.
    """
    carried = [c for c in ends.columns if c not in (group, "steps")]
    ends = ends.withColumnRenamed(group, "_group")
    upper = None
    for parents in reversed(pivots):
        parents = parents.alias("p")
        above = parents.filter("n = 1").join(ends, F.col(f"p.{group}").eqNullSafe(F.col("_group"))).drop("_group")
        if upper is not None:
            known = upper.select(F.col(group).alias("_group"), F.col("place").alias("_place"), *carried, "steps")
            same = F.col(f"p.{group}").eqNullSafe(F.col("_group")) & (F.col("p.place") == F.col("_place"))
            above = above.unionByName(parents.filter("n > 1").join(known, same).drop("_group", "_place"))
        upper = _children(above, group, carried, fanout)
    return upper


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_hash(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, space: Workspace, altered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """``doc_id``, ``source``, ``leaf``, ``altered_leaf``, ``subroot``, ``root`` and ``steps`` of every document.

    ``docs`` needs the columns of ``FIELDS``; others, whatever their names, are left out of the hashes and of the result.
    ``altered`` is the text as found later (default: unchanged) and decides ``altered_leaf`` only. Leaves of a source
    follow doc_id, null first, and then their hash, so equal rows stand side by side in any order. A null source is a
    source of its own, the first one. Every row counts, repeated ones too. ``steps`` lists the siblings ``before`` and
    ``after`` the node, from the leaf up; a table of one row has none and its leaf is the root. An empty table gives no rows.
    Texts of any length are hashed whole.
    """
    values = {name: F.col(f"`{name}`") for name in FIELDS}
    changed = values | {"text": values["text"] if altered is None else altered}
    leaves = docs.select(
        values["doc_id"].alias("doc_id"), values["source"].alias("source"),
        leaf_hash(values).alias("digest"), leaf_hash(changed).alias("altered_leaf"),
    )
    payload = ["digest", "doc_id", "altered_leaf"]
    nodes = numbered(leaves, "source", ["doc_id", "digest", "altered_leaf"], space, "leaves")
    subroots, pivots = tree(nodes, "source", payload, fanout, space)
    subroots = space.keep(subroots, "subroots")
    # The sources' tops are numbered together: one group of a constant.
    tops = numbered(subroots.withColumn("all", F.lit(0)), "all", ["source"], space, "tops")
    roots, upper = tree(tops, "all", ["digest", "source"], fanout, space)
    none = F.array().cast(_STEPS)
    ends = roots.select("all", F.col("digest").alias("root"), none.alias("steps"))
    if upper:
        above = paths(upper, "all", ends, fanout)
    else:
        above = tops.join(ends, "all")
    above = space.keep(above.select("source", F.col("digest").alias("subroot"), "root", "steps"), "above")
    named = above.withColumnRenamed("source", "_source")
    found = nodes.filter("n = 1").join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "n")
    if pivots:
        found = found.unionByName(paths(pivots, "source", above, fanout))
    return found.select("doc_id", "source", F.col("digest").alias("leaf"), "altered_leaf", "subroot", "root", "steps")
