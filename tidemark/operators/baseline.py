"""Entropy collapse: events whose payload is far more uniform than the log's running baseline.

The baseline ``r`` is a running mean that skips the events it flags, so each event depends on the decisions before it.
Within one block that is a short fold. What a block does to the baseline is a rising map of straight branches, each for a
range of incoming values (``branches.py``). All blocks' maps are made at once, for a range around an estimate. Maps of
neighbours are composed, first within groups of ``GROUP`` blocks, then along the groups of a log; reading the known
first value through them gives every block its true ``r_in``. A block does not wait for the one before it to be settled: its map holds for
whatever enters, as long as that is among its branches. Only blocks whose branches the true value misses are taken again, around it.
The first such block of a log has its true value already, so every round settles at least one more block and the end
result is the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import text
from tidemark.operators import blocks, branches
from tidemark.operators.blocks import BLOCK
from tidemark.settings import Settings
from tidemark.workspace import Workspace

# Events before judging starts (0-based position above this), payload length above which an event is
# judged, share of the baseline and absolute entropy below which it is forged.
WARM_UP = 50
MIN_CHARS = 20
SHARE = 0.75
FLOOR = 3.0

# Stamps cross into pandas as text: its nanosecond clock does not reach every year a log can name.
FORGERIES = "source STRING, line_number BIGINT, ts STRING, entropy DOUBLE, baseline DOUBLE, raw_text STRING"
# Blocks whose maps are composed in one task, and branches that a block's and a group's map keep.
GROUP = 512
#: Groups composed or walked in one task, on average: their work is in Python and far larger than their bytes, by which
#: shuffles would otherwise be coalesced into a few tasks that hold all groups.
GROUPS_PER_TASK = 1
BRANCHES, GROUP_BRANCHES = 64, 4096
# How far around the estimate a map reaches: a share of it and a constant.
REACH, AROUND = 0.25, 0.25
MAPS = "source STRING, _blk BIGINT, _group BIGINT, n_in BIGINT, n_rows BIGINT, r_in DOUBLE, map ARRAY<DOUBLE>"
STATES = "source STRING, _blk BIGINT, n_in BIGINT, r_in DOUBLE, n_out BIGINT, r_out DOUBLE, unsettled BOOLEAN"


def measured(events: DataFrame) -> DataFrame:
    """Entropy and length of each payload, and the text kept as evidence."""
    body = text.payload_body(F.col("raw_payload"))
    return events.select(
        "source",
        "line_number",
        F.col("ts").cast("string").alias("ts"),
        text.entropy(body).alias("entropy"),
        F.length(body).alias("chars"),
        text.evidence(F.col("raw_payload")).alias("raw_text"),
    )


def _fold():
    """The fold over one block: (entropies, lengths, n, r) to flags, the baseline at each event and the one they end with."""
    warm_up, min_chars, share, floor = WARM_UP, MIN_CHARS, SHARE, FLOOR

    def fold(entropies, lengths, n, r):
        flags, levels = [], []
        for e, chars in zip(entropies, lengths):
            levels.append(r)
            forged = n > warm_up and chars > min_chars and (e < floor or e < r * share)
            if not forged:
                r = (r * n + e) / (n + 1)
            flags.append(forged)
            n += 1
        return flags, levels, r

    return fold


def _forgeries_of_block():
    fold = _fold()

    def forgeries(table, n, r):
        """The forged rows with their baseline, and the (n, r) that the rows end with."""
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table["line_number"]))
        flags, levels, r_out = fold(table["entropy"].to_pylist(), table["chars"].to_pylist(), n, r)
        forged = [i for i, flag in enumerate(flags) if flag]
        found = table.select(["source", "line_number", "ts", "entropy"]).take(pa.array(forged, pa.int64()))
        found = found.append_column("baseline", pa.array([levels[i] for i in forged], pa.float64()))
        found = found.append_column("raw_text", table["raw_text"].take(pa.array(forged, pa.int64())))
        return found, n + len(flags), r_out

    return forgeries


def entropy_collapse(
    events: DataFrame, settings: Settings, workspace: Workspace, initial: DataFrame | None = None
) -> DataFrame:
    """Forged events with their entropy, the baseline at that point and the start of their text."""
    return collapse_and_state(events, settings, workspace, initial, want_state=False)[0]


def collapse_and_state(
    events: DataFrame,
    settings: Settings,
    workspace: Workspace,
    initial: DataFrame | None = None,
    want_state: bool = True,
    on_round: Callable[[int], None] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Forgeries and, if asked for, the baseline (source, n, r) that each log ends with.

    ``initial`` (source, n, r) continues baselines of earlier events; a log without a row starts afresh. ``on_round`` is
    told after each round over all blocks how many are left to settle.
    """
    rows = blocks.with_block(measured(events), "line_number", settings.block_lines)
    if initial is None and not want_state and not _any_log_beyond_one_block(events, settings):
        alone = _forgeries_of_block()

        def whole_log(table):
            return alone(table, 0, 0.0)[0]

        return _stamped(rows.drop(BLOCK).groupBy("source").applyInArrow(whole_log, FORGERIES)), None

    rows = workspace.keep(rows, "entropy")
    if _longest_run(rows) <= settings.block_lines:
        return _short_runs(rows, initial, workspace)
    maps = _maps(rows, workspace.keep(_first_estimates(rows, initial), "estimates"))
    guesses = None
    while True:
        maps = workspace.keep(maps, "maps")
        states, groups = _states(maps, guesses, workspace)
        unsettled = states.filter("unsettled")
        left = unsettled.count()
        if on_round is not None:
            on_round(left)
        if not left and (groups is None or groups.filter("not known").isEmpty()):
            break
        guesses = states
        again = unsettled.select("source", BLOCK, "n_in", "r_in")
        redone = _maps(rows.join(again.select("source", BLOCK), ["source", BLOCK], "left_semi"), again)
        maps = maps.join(again.select("source", BLOCK), ["source", BLOCK], "left_anti").unionByName(redone)
    found = _stamped(_forgeries(rows, states))
    state = None
    if want_state:
        state = states.groupBy("source").agg(
            F.max_by("n_out", BLOCK).alias("n"), F.max_by("r_out", BLOCK).alias("r")
        )
    return found, state


def _stamped(found: DataFrame) -> DataFrame:
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _any_log_beyond_one_block(events: DataFrame, settings: Settings) -> bool:
    last = events.agg(F.max("line_number")).first()[0]
    return last is not None and last >= settings.block_lines


def _longest_run(rows: DataFrame) -> int:
    return rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0


def _short_runs(rows: DataFrame, initial: DataFrame | None, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """Logs that add no more events than a block holds: one fold each, from the baseline they are known to have."""
    judge = _forgeries_of_block()

    def run(table, known):
        import pyarrow as pa

        n, r = (known["n"][0].as_py(), known["r"][0].as_py()) if known.num_rows else (0, 0.0)
        found, n, r = judge(table, n, r)
        nothing = pa.nulls(found.num_rows)
        found = found.append_column("n", nothing.cast(pa.int64())).append_column("r", nothing.cast(pa.float64()))
        if table.num_rows == 0:
            return found
        end = {name: [None] for name in found.column_names} | {"source": [table["source"][0].as_py()], "n": [n], "r": [r]}
        return pa.concat_tables([found, pa.table(end, schema=found.schema)])

    start = initial if initial is not None else rows.sparkSession.createDataFrame([], "source STRING, n BIGINT, r DOUBLE")
    folded = workspace.keep(
        rows.drop(BLOCK)
        .groupBy("source")
        .cogroup(start.select("source", "n", "r").groupBy("source"))
        .applyInArrow(run, f"{FORGERIES}, n BIGINT, r DOUBLE"),
        "folded",
    )
    found = _stamped(folded.filter(F.col("n").isNull()).drop("n", "r"))
    return found, folded.filter(F.col("n").isNotNull()).select("source", "n", "r")


def _first_estimates(rows: DataFrame, initial: DataFrame | None) -> DataFrame:
    """Per block the exact number of events before it, and a guess at the baseline: the mean of the unsuspicious ones."""
    plain = (F.col("entropy") >= FLOOR) | (F.col("chars") <= MIN_CHARS)
    per_block = rows.groupBy("source", BLOCK).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(plain, F.col("entropy"))).alias("total"),
        F.count_if(plain).alias("counted"),
    )
    if initial is not None:
        known = initial.select(
            "source", F.lit(-1).cast("bigint").alias(BLOCK), F.col("n").alias("n_rows"),
            (F.col("r") * F.col("n")).alias("total"), F.col("n").alias("counted"),
        )
        per_block = per_block.unionByName(known)
    before = Window.partitionBy("source").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    total, counted = F.sum("total").over(before), F.sum("counted").over(before)
    return per_block.select(
        "source",
        BLOCK,
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("n_in"),
        F.coalesce(F.try_divide(total, counted), F.lit(0.0)).alias("r_in"),
    ).filter(F.col(BLOCK) >= 0)


def _maps(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Each block's map around the estimate in ``starts``."""
    warm_up, min_chars, share, floor, limit, reach, around, group = WARM_UP, MIN_CHARS, SHARE, FLOOR, BRANCHES, REACH, AROUND, GROUP

    def mapped(table, start):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["source", "_blk", "_group", "n_in", "n_rows", "r_in", "map"]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.float64(), pa.list_(pa.float64())]
        out = []
        if table.num_rows and start.num_rows:
            table = table.take(pc.sort_indices(table["line_number"]))
            n, r = start["n_in"][0].as_py(), start["r_in"][0].as_py()
            entropies, chars = table["entropy"].to_numpy(), table["chars"].to_numpy()
            judged = (n + np.arange(len(entropies)) > warm_up) & (chars > min_chars)
            found = branches.of_block(entropies, judged, n, r * (1 - reach) - around, r * (1 + reach) + around, r, limit, share, floor)
            block = table["_blk"][0].as_py()
            out = [(table["source"][0].as_py(), block, block // group, n, len(entropies), r, found.ravel().tolist())]
        return pa.table([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names=names)

    narrow = rows.select("source", BLOCK, "line_number", "entropy", "chars")
    return narrow.groupBy("source", BLOCK).cogroup(starts.groupBy("source", BLOCK)).applyInArrow(mapped, MAPS)


def _states(maps: DataFrame, guesses: DataFrame | None, workspace: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """Per block the baseline it starts and ends with, and whether its map misses it; and per group of a log with several
    the baseline it starts with, and whether the map of the group before knew it."""
    # A log's first block starts from its known baseline, which is what its map was made around.
    group = ["source", "_group"]
    first = maps.groupBy(*group).agg(F.min(BLOCK).alias(BLOCK), F.min_by("r_in", BLOCK).alias("r_in"))
    if guesses is not None:
        # The last round's value is closer than the one the map was made around.
        later = guesses.select("source", BLOCK, F.col("r_in").alias("_later"))
        first = first.join(later, ["source", BLOCK], "left").withColumn("r_in", F.coalesce("_later", "r_in"))
    # A table of its own: it meets the maps that it was made from.
    starts = workspace.keep(first.drop(BLOCK), "starts")
    tasks = max(1, -(-starts.count() // GROUPS_PER_TASK))
    several = starts.groupBy("source").agg(F.count("*").alias("groups")).filter("groups > 1")
    if several.isEmpty():
        return workspace.keep(_walked(maps, starts, tasks), "states"), None
    chained = maps.join(several.select("source"), "source", "left_semi").repartition(tasks, *group)
    begun = starts.join(several.select("source"), "source", "left_semi").repartition(tasks, *group)
    composed = chained.groupBy(*group).cogroup(begun.groupBy(*group)).applyInArrow(_compose_group(), f"{MAPS}, leads DOUBLE")
    groups = workspace.keep(
        composed.groupBy("source").applyInArrow(_chain_groups(), "source STRING, _group BIGINT, r_in DOUBLE, known BOOLEAN"), "groups"
    )
    true = groups.select(*group, F.col("r_in").alias("_true"))
    starts = starts.join(true, group, "left").select(*group, F.coalesce("_true", "r_in").alias("r_in"))
    return workspace.keep(_walked(maps, starts, tasks), "states"), groups


def _in_order(table):
    import numpy as np
    import pyarrow.compute as pc

    table = table.take(pc.sort_indices(table["_blk"]))
    return table, [np.array(m, float).reshape(-1, 4) for m in table["map"].to_pylist()]


def _compose_group():
    limit = GROUP_BRANCHES

    def compose(table, start):
        import pyarrow as pa

        table, maps = _in_order(table)
        r = leads = start["r_in"][0].as_py()
        whole = maps[0]
        for n, one in enumerate(maps):
            leads = branches.applied(one, leads)[0]
            whole = one if n == 0 else branches.nearest(branches.composed(whole, one), r, limit)
        row = table.slice(0, 1).drop_columns(["map", "r_in"])
        row = row.append_column("r_in", pa.array([r])).append_column("map", pa.array([whole.ravel().tolist()], pa.list_(pa.float64())))
        return row.append_column("leads", pa.array([leads])).select([*table.column_names, "leads"])

    return compose


def _chain_groups():
    def chain(table):
        import pyarrow as pa

        leads = dict(zip(table["_blk"].to_pylist(), table["leads"].to_pylist()))
        table, maps = _in_order(table)
        r, known, at, knew = table["r_in"][0].as_py(), True, [], []
        for block, one in zip(table["_blk"].to_pylist(), maps):
            at.append(r)
            knew.append(known)
            out, known = branches.applied(one, r)
            r = out if known else leads[block]
        kinds = [("r_in", at, pa.float64()), ("known", knew, pa.bool_())]
        out = table.select(["source", "_group"])
        for name, values, kind in kinds:
            out = out.append_column(name, pa.array(values, kind))
        return out

    return chain


def _walked(maps: DataFrame, starts: DataFrame, tasks: int) -> DataFrame:
    """Read each group's first baseline through the maps of its blocks, the groups dealt over ``tasks`` tasks."""
    def walk(table, start):
        import pyarrow as pa

        table, maps = _in_order(table)
        r = start["r_in"][0].as_py()
        r_in, r_out, missed = [], [], []
        for one in maps:
            r_in.append(r)
            r, known = branches.applied(one, r)
            r_out.append(r)
            missed.append(not known)
        n_out = [n + rows for n, rows in zip(table["n_in"].to_pylist(), table["n_rows"].to_pylist())]
        out = table.select(["source", "_blk", "n_in"])
        columns = {"r_in": (r_in, pa.float64()), "n_out": (n_out, pa.int64()), "r_out": (r_out, pa.float64()), "unsettled": (missed, pa.bool_())}
        for name, (values, kind) in columns.items():
            out = out.append_column(name, pa.array(values, kind))
        return out

    group = ["source", "_group"]
    spread_maps, spread_starts = maps.repartition(tasks, *group), starts.repartition(tasks, *group)
    return spread_maps.groupBy(*group).cogroup(spread_starts.groupBy(*group)).applyInArrow(walk, STATES)


def _forgeries(rows: DataFrame, states: DataFrame) -> DataFrame:
    judge = _forgeries_of_block()

    def forged_rows(table, start):
        if table.num_rows == 0 or start.num_rows == 0:
            return judge(table.slice(0, 0), 0, 0.0)[0]
        return judge(table, start["n_in"][0].as_py(), start["r_in"][0].as_py())[0]

    return (
        rows.groupBy("source", BLOCK).cogroup(states.groupBy("source", BLOCK)).applyInArrow(forged_rows, FORGERIES)
    )
