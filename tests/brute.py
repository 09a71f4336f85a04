"""Plain loops that state the expected results of the interval operators."""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby


def by_key(rows):
    groups = defaultdict(list)
    for key, *rest in rows:
        groups[key].append(tuple(rest))
    return groups


def paired(marks):
    """FIFO pairs of (position, kind, at) marks."""
    waiting, pairs = [], []
    for _, kind, at in sorted(marks):
        if kind == "S":
            waiting.insert(0, at)
        elif waiting:
            pairs.append((waiting.pop(), at))
    return pairs


def merged(intervals):
    """Unions of intervals that overlap or touch."""
    result = []
    for interval in sorted(intervals):
        if result and interval[0] <= result[-1][1]:
            result[-1][1] = max(result[-1][1], interval[1])
        else:
            result.append(list(interval))
    return [tuple(pair) for pair in result]


def kept(silences, duration, padding, minimum):
    if duration <= 0:
        return []
    position, ranges = 0, []
    for start, end in merged(silences):
        ranges.append((position, max(position, start - padding)))
        position = min(duration, end + padding)
    ranges.append((position, duration))
    return [pair for pair in ranges if pair[1] - pair[0] >= minimum]


def bounds(start, end):
    start = start or 0
    return start, (end or start)


def overlap(a, b):
    return max(0, min(a[1], b[1]) - max(a[0], b[0]))


def speaker(segment, turns):
    """Label of the best turn among (position, start, end, label)."""
    segment = bounds(*segment)
    placed = [(bounds(s, e), label) for _, s, e, label in sorted(turns, key=lambda t: t[0])]
    amounts = [overlap(segment, span) for span, _ in placed]
    if amounts and max(amounts) > 0:
        label = placed[amounts.index(max(amounts))][1]
    else:
        middle = segment[0] + (segment[1] - segment[0]) / 2
        label = next((name for span, name in placed if span[0] <= middle <= span[1]), None)
    return (label or "").strip() or None


def total_overlap(segment, ranges):
    segment = bounds(*segment)
    return sum(overlap(segment, bounds(*span)) for span in ranges) if segment[1] > segment[0] else 0


def runs(values):
    lengths = []
    for value, group in groupby(values):
        size = len(list(group))
        lengths += [size if value is not None else 0] * size
    return lengths


def quiet(levels, below, at_least):
    """Quiet stretches of (position, at, level) samples, closed by the next loud sample or the last one."""
    found, start, last = [], None, None
    for _, at, level in sorted(levels):
        last = at
        if level < below:
            start = at if start is None else start
        elif start is not None:
            found.append((start, at))
            start = None
    if start is not None:
        found.append((start, last))
    return [pair for pair in found if pair[1] - pair[0] >= at_least]
