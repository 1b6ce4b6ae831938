from __future__ import annotations

from tests import test_operators
from tidemark.operators import baseline


def test_groups_of_blocks_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    # Groups of two blocks of ten lines: over a hundred groups, whose maps are a few bytes each. By bytes alone their
    # shuffles were coalesced into the few tasks of the session, which then held every group of every log.
    monkeypatch.setattr(baseline, "GROUP", 2)
    seen, walked = [], baseline._walked

    def spy(*args):
        out = walked(*args)
        seen.append((out.select("source", "_blk").distinct().count(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(baseline, "_walked", spy)
    test_operators.test_baseline_in_blocks_equals_the_fold(spark, monkeypatch, 1, 10)
    assert seen
    for blocks, tasks in seen:
        groups = -(-blocks // 2)
        assert tasks >= -(-groups // baseline.GROUPS_PER_TASK) > 8
