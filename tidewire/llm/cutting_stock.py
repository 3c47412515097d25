"""Which lengths share a sequence: cutting stock by column generation, over a histogram of lengths.

A pattern is a multiset of lengths whose sum needs no padding: the capacity, or a power of two below it. The linear program gives
each pattern a number of uses, so that no length is used more often than it occurs and as many tokens as possible are packed
whole. Columns are priced by a knapsack over the capacities: with a dual price for each length, one dynamic program finds the
best pattern of every sum, and for each length the best full pattern that holds it. The revised simplex method starts from slacks
(every item left over) and ends when no pattern gains more than ``GAP`` of its tokens, which bounds what the optimum could still
add by that share of all tokens.

All of this works on at most ``capacity`` lengths, whatever the number of documents, so it runs on the driver.
"""

from __future__ import annotations

import numpy as np

#: The share of all tokens by which the program may miss the optimum. What it leaves over is packed too, but cut.
GAP = 0.01
#: A sequence costs so many tokens, which makes full ones better than short ones.
SEQUENCE_COST = 8
#: Columns taken from one dynamic program, and dynamic programs at most: beyond them more is cut, and nothing is lost.
COLUMNS, PRICINGS = 64, 200
#: Tokens by which the choice inside a dynamic program may miss the best one.
NOISE = 4.0
_EPS = 1e-9

Pattern = dict[int, int]


def sums(capacity: int) -> list[int]:
    """The sums that need no padding."""
    return sorted({capacity} | {1 << i for i in range(capacity.bit_length()) if 1 << i < capacity})


def knapsack(values: np.ndarray, noise: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every sum the best value of a multiset of lengths with that sum, and the length it ends with.

    ``values`` has the value of each length at its index, minus infinity for those that don't occur. With ``noise`` (twice as long)
    the choice is the best but for the noise, so that patterns of different sums share few lengths.
    """
    n = len(values)
    best, last = np.full(n, -np.inf), np.zeros(n, np.int64)
    best[0], reverse = 0.0, np.full(n, -np.inf)
    reverse[n - 1] = 0.0  # reverse[n - 1 - c] is best[c]
    for c in range(1, n):
        found = values[1 : c + 1] + reverse[n - c : n]
        k = int((found if noise is None else found + noise[c : 2 * c]).argmax())
        best[c] = reverse[n - 1 - c] = found[k]
        last[c] = k + 1
    return best, last


def unfolded(last: np.ndarray, total: int, pattern: Pattern | None = None) -> Pattern:
    pattern = dict(pattern or {})
    while total:
        length = int(last[total])
        pattern[length] = pattern.get(length, 0) + 1
        total -= length
    return pattern


class Master:
    """The linear program: maximise the tokens of the patterns used, no length more often than it occurs."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        m = len(lengths)
        self.row = {int(x): i for i, x in enumerate(lengths)}
        self.inverse, self.duals, self.basis = np.eye(m), np.zeros(m), [None] * m
        self.gains = np.zeros(m)
        self.x = counts * (1 + 1e-7 * (np.arange(m) * 37 % 101)) + 1e-4 * (1 + np.arange(m) * 53 % 97)  # a little apart, against cycles

    def column(self, pattern: Pattern) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.row[k] for k in pattern]), np.array(list(pattern.values()), float)

    def enter(self, rows: np.ndarray, times: np.ndarray, value: float, pattern: Pattern | None) -> bool:
        """Let a column into the basis if it still gains."""
        gain = value - float(self.duals[rows] @ times)
        if gain <= 1e-6:
            return False
        step = self.inverse[:, rows] @ times
        up = np.flatnonzero(step > _EPS)
        if not len(up):
            return False
        ratios = self.x[up] / step[up]
        out = int(up[np.flatnonzero(ratios <= ratios.min() + 1e-12)[0]])
        pivot = self.inverse[out] / step[out]
        moved = np.flatnonzero(np.abs(step) > 1e-12)
        moved = moved[moved != out]
        filled = np.flatnonzero(pivot)
        if len(filled) * 4 < len(pivot):
            self.inverse[np.ix_(moved, filled)] -= step[moved, None] * pivot[filled]
        else:
            self.inverse[moved] -= step[moved, None] * pivot
        self.inverse[out] = pivot
        amount = self.x[out] / step[out]
        self.x -= amount * step
        self.x[out] = amount
        np.maximum(self.x, 0, out=self.x)
        self.duals += gain * pivot
        self.basis[out] = pattern
        return True


def relaxed(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Pattern, float]]:
    """Patterns and how often each is used, by column generation."""
    master, totals, noise, plain = Master(lengths, counts), sums(capacity), np.random.default_rng(0), False
    present = set(lengths.tolist())
    for total in reversed(totals):  # pairs and single lengths come first
        for k in lengths[lengths * 2 >= total].tolist():
            if k == total or total - k in present:
                pattern = {k: 1} if k == total else {k: 2} if 2 * k == total else {k: 1, total - k: 1}
                master.enter(*master.column(pattern), total - SEQUENCE_COST, pattern)
    for _ in range(PRICINGS):
        for i in np.flatnonzero(master.duals < -1e-7)[:COLUMNS]:  # a slack gains
            master.enter(np.array([i]), np.ones(1), 0.0, None)
        values = np.full(capacity + 1, -np.inf)
        values[lengths] = lengths - master.duals
        best, last = knapsack(values, None if plain else noise.random(2 * capacity + 2) * NOISE)
        if plain and max((best[s] - SEQUENCE_COST) / s for s in totals) <= GAP:
            break
        found = [(best[s] - SEQUENCE_COST, unfolded(last, s), s) for s in totals if best[s] - SEQUENCE_COST > 1e-6]
        with_each = values[lengths] + best[capacity - lengths] - SEQUENCE_COST
        for i in np.argsort(-with_each)[:COLUMNS]:
            if with_each[i] > 1e-6:
                found.append((with_each[i], unfolded(last, capacity - int(lengths[i]), {int(lengths[i]): 1}), capacity))
        entered = 0
        for _, pattern, total in sorted(found, key=lambda x: -x[0]):
            entered += master.enter(*master.column(pattern), total - SEQUENCE_COST, pattern)
        if plain and not entered:
            break
        plain = max((best[s] - SEQUENCE_COST) / s for s in totals) <= GAP or not entered  # then the exact program decides
    return [(p, float(x)) for p, x in zip(master.basis, master.x) if p and x > _EPS]


def solved(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and whole numbers of uses, within ``counts`` (of lengths below ``capacity``): rounded down, then filled up."""
    if not counts:
        return []
    lengths = np.array(sorted(counts))
    left, used = dict(counts), {}
    fractions = relaxed(lengths, np.array([counts[int(k)] for k in lengths], float), capacity)
    for whole in (True, False):
        for pattern, x in sorted(fractions, key=lambda f: f[1] % 1, reverse=True):
            fits = min(left[k] // a for k, a in pattern.items())
            uses = min(fits, int(x)) if whole else fits
            if uses > 0:
                key = tuple(sorted(pattern.items(), reverse=True))
                used[key] = used.get(key, 0) + uses
                for k, a in pattern.items():
                    left[k] -= a * uses
    return [(dict(p), n) for p, n in used.items()]
