"""What a block of events does to an entropy baseline, whatever the baseline was before it.

The map of one block, from the baseline it starts with to the one it leaves, rises, and it is a straight line as long as
the block's decisions stay the same. So it is a list of branches: ranges of incoming values, each with its line. Two
maps in a row are again such a list. Composing is associative: any number of neighbouring blocks can be put together
before the value that enters the first of them is known.

A map is an array of shape (branches, 4) with columns low, high, slope, shift, in rising order; a branch holds for
``low < r <= high``. Values outside all branches are not known to the map.
"""

from __future__ import annotations

import numpy as np

LOW, HIGH, SLOPE, SHIFT = range(4)
#: Events looked at together between two that a decision might turn on.
STRIDE = 4096


def of_block(
    entropies: np.ndarray, judged: np.ndarray, n: int, low: float, high: float, guess: float, limit: int, share: float, floor: float
) -> np.ndarray:
    """The map of a block that has ``n`` events before it, for values in ``low`` to ``high``.

    ``judged`` tells whether an event may be forged at all (length, warm-up). At most ``limit`` branches are kept, those
    next to ``guess``. Between events on which a decision might turn all branches move alike, so those stretches are
    sums over arrays; only the others are taken one by one.
    """
    branches = np.array([[low, high, 1.0, 0.0]])
    certain = judged & (entropies < floor)
    doubtful = judged & ~certain
    at, stride, size = 0, 64, len(entropies)
    while at < size:
        # The first event of a log sets the baseline whatever it was.
        end = at + 1 if n == 0 else min(at + stride, size)
        shrink, gain = _unforged(entropies[at:end], ~certain[at:end], n)
        # The highest value that any branch has before each event, if none of the doubtful ones from here on is forged.
        top = shrink[:-1] * (branches[-1, SLOPE] * branches[-1, HIGH] + branches[-1, SHIFT]) + gain[:-1]
        turning = doubtful[at:end] & (entropies[at:end] < top * share)
        stop = int(turning.argmax()) if turning.any() else end - at
        branches[:, SHIFT] = branches[:, SHIFT] * shrink[stop] + gain[stop]
        branches[:, SLOPE] *= shrink[stop]
        if at + stop == end:
            at, n, stride = end, n + stop, min(2 * stride, STRIDE)
            continue
        branches = _decided(branches, float(entropies[at + stop]), n + stop, share)
        if len(branches) > limit:
            branches = nearest(branches, guess, limit)
        at, n, stride = at + stop + 1, n + stop + 1, max(16, min(2 * stop, STRIDE))
    return branches


def _unforged(entropies: np.ndarray, counted: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """After none, one, two, ... of the events r has become shrink * r + gain; those not ``counted`` leave it as it is."""
    places = n + np.arange(len(entropies))
    shrink = np.concatenate([[1.0], np.cumprod(np.where(counted, places / (places + 1), 1.0))])
    if n == 0:
        return shrink, np.concatenate([[0.0], entropies])
    steps = np.where(counted, entropies / (places + 1), 0.0)
    return shrink, shrink * np.concatenate([[0.0], np.cumsum(steps / shrink[1:])])


def _decided(branches: np.ndarray, entropy: float, n: int, share: float) -> np.ndarray:
    """One event on which decisions may turn: the branch that holds the turning point is split there."""
    slope, shift = branches[:, SLOPE], branches[:, SHIFT]
    with np.errstate(divide="ignore", invalid="ignore"):
        # Forged above the value at which entropy = share * r; a level branch is on one side altogether.
        turn = np.where(slope > 0, (entropy / share - shift) / slope, np.where(entropy < shift * share, -np.inf, np.inf))
    below, above = branches.copy(), branches
    below[:, HIGH] = np.minimum(below[:, HIGH], turn)
    above[:, LOW] = np.maximum(above[:, LOW], turn)
    below[:, SHIFT] = (below[:, SHIFT] * n + entropy) / (n + 1)
    below[:, SLOPE] = below[:, SLOPE] * n / (n + 1)
    both = np.concatenate([below, above])
    both = both[both[:, LOW] < both[:, HIGH]]
    return both[np.argsort(both[:, LOW], kind="stable")]


def nearest(branches: np.ndarray, guess: float, limit: int) -> np.ndarray:
    """The ``limit`` branches next to the one that holds ``guess``."""
    middle = int(np.searchsorted(branches[:, HIGH], guess))
    begin = min(max(0, middle - limit // 2), max(0, len(branches) - limit))
    return branches[begin:begin + limit]


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The map of two neighbours; a value is known to it if both know it."""
    out = []
    for low, high, slope, shift in first:
        if slope <= 0:
            line = _holding(then, shift)
            if line is not None:
                out.append((low, high, 0.0, line[SLOPE] * shift + line[SHIFT]))
            continue
        # The second map's ends, seen from before the first.
        lows, highs = (then[:, LOW] - shift) / slope, (then[:, HIGH] - shift) / slope
        meet = np.column_stack([np.maximum(lows, low), np.minimum(highs, high), then[:, SLOPE] * slope, then[:, SLOPE] * shift + then[:, SHIFT]])
        out.extend(meet[meet[:, LOW] < meet[:, HIGH]])
    return np.array(out, float).reshape(-1, 4)


def _holding(branches: np.ndarray, r: float) -> np.ndarray | None:
    at = int(np.searchsorted(branches[:, HIGH], r))
    return branches[at] if at < len(branches) and branches[at, LOW] < r else None


def applied(branches: np.ndarray, r: float) -> tuple[float, bool]:
    """Where ``r`` leads, and whether the map knows it; else the next branch's line is used as a guess."""
    line = _holding(branches, r)
    known = line is not None
    if not known:
        if not len(branches):
            return r, False
        line = branches[min(int(np.searchsorted(branches[:, HIGH], r)), len(branches) - 1)]
    return float(line[SLOPE] * r + line[SHIFT]), known
