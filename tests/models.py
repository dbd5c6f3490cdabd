"""Plain Python statements of what the operators must return."""

import math

NAN = float("nan")


def missing(v):
    return v is None or math.isnan(v)


def median(values):
    values = [v for v in values if not math.isnan(v)]
    if not values:
        return NAN
    ordered = sorted(values)
    n = len(ordered)
    low, high = ordered[(n - 1) // 2], ordered[n // 2]
    return (low + high) / 2


def difference(a, b):
    if missing(a) or missing(b):
        return NAN
    return b - a  # inf - inf is NaN


def spikes(values, window=24, z=4.0):
    """{row: score}"""
    if len(values) < 3:
        return {}
    half = max(max(int(window), 2) // 2, 1)
    steps = [difference(a, b) for a, b in zip(values, values[1:])]
    found = {}
    for i, step in enumerate(steps):
        frame = [steps[min(max(j, 0), len(steps) - 1)] for j in range(i - half, i + half + 1)]
        centre = median(frame)
        spread = median([abs(v - centre) for v in frame])
        score = abs(step - centre) / (spread * 1.4826 + 1e-9)
        if not math.isfinite(score):
            score = 0.0
        if score > z:
            found[i + 1] = score
    return found


def frozen(values, least=6, tolerance=0.0):
    """{row: run length}"""
    least = max(int(least), 2)
    found, start = {}, 0
    for i in range(1, len(values) + 1):
        same = (
            i < len(values)
            and not missing(values[i - 1])
            and not missing(values[i])
            and abs(difference(values[i - 1], values[i])) <= tolerance
        )
        if not same:
            if i - start >= least:
                found.update({row: float(i - start) for row in range(start, i)})
            start = i
    return found


def nearest(times, probe):
    """Row of the nearest of ascending ``times``."""
    after = [i for i, t in enumerate(times) if t >= probe]
    before = [i for i, t in enumerate(times) if t < probe]
    if not after:
        return before[-1]
    if before and probe - times[before[-1]] < times[after[0]] - probe:
        return before[-1]
    return after[0]


class EditedArray:
    """A mutable array with the log actions, as one would write it for one series."""

    def __init__(self, raw):
        self.raw, self.now = list(raw), list(raw)
        self.gone = [False] * len(raw)
        self.edits, self.removed = [], []

    def apply(self, op, new):
        """``new`` maps rows to values."""
        if not new:
            return
        self.edits.append((op, {i: self.now[i] for i in new}, dict(new)))
        for i, v in new.items():
            self.now[i], self.gone[i] = v, op == "delete"

    def undo(self):
        if self.edits:
            for i, v in self.edits.pop()[1].items():
                self.now[i] = v

    def rebuild(self):
        self.now, self.gone = list(self.raw), [False] * len(self.raw)
        for op, _, new in self.edits:
            for i, v in new.items():
                self.now[i], self.gone[i] = v, op == "delete"

    def remove(self, at):
        if 0 <= at < len(self.edits):
            self.removed.append((at, self.edits.pop(at)))
            self.rebuild()

    def restore(self):
        if self.removed:
            at, edit = self.removed.pop()
            self.edits.insert(min(at, len(self.edits)), edit)
            self.rebuild()

    def reset(self):
        self.edits, self.removed = [], []
        self.now, self.gone = list(self.raw), [False] * len(self.raw)


