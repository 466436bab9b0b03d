"""A learned first stage of the tagger: which parts of a text it has to read.

Every character gets a score from three tables of weights by the hash of the letters
around it: the trigram at the place, and the means over the trigrams before and after
it. The tables are a logistic regression on the characters inside the spans that the
tagger itself finds; the threshold is the largest that keeps a stated share of those
spans on documents that weren't used for the tables. Where the score passes it, the
surroundings are handed to the tagger; all else is read by the tables alone, at about
a fortieth of the cost.
"""

from __future__ import annotations

import numpy as np

#: Rows of a table, characters before and after a place that count, and those handed on around it.
TABLE, REACH, LEFT, RIGHT = 1 << 16, 12, 40, 64
_A, _B = 104 * 104, 104


def _hashes(x: np.ndarray) -> np.ndarray:
    """The row of the trigram around each place of symbols ``x``."""
    wide = x.astype(np.int32)
    code = np.empty(len(x), np.int32)
    code[1:-1] = wide[:-2] * _A + wide[1:-1] * _B + wide[2:]
    code[0] = code[-1] = 0
    return ((code * np.int32(-1640531527)) >> 16) & (TABLE - 1)


def _means(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means over the REACH places before and after each place."""
    total = np.concatenate([np.zeros(REACH + 1), np.cumsum(values, dtype=np.float64), np.zeros(REACH)])
    n = len(values)
    total[n + REACH + 1 :] = total[n + REACH]
    here = total[REACH : REACH + n]  # sum of all before a place
    before = here - total[:n]
    after = total[2 * REACH + 1 : 2 * REACH + 1 + n] - total[REACH + 1 : REACH + 1 + n]
    return (before / REACH).astype(np.float32), (after / REACH).astype(np.float32)


class Gate:
    def __init__(self, here: np.ndarray, before: np.ndarray, after: np.ndarray, bias: float, threshold: float):
        self.here, self.before, self.after, self.bias, self.threshold = here, before, after, bias, threshold

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(x) < 3:
            return np.full(len(x), np.inf, np.float32)
        h = _hashes(x)
        before, _ = _means(self.before[h])
        _, after = _means(self.after[h])
        return self.here[h] + before + after + np.float32(self.bias)

    def parts(self, x: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the parts of ``x`` that the tagger has to read, in order."""
        hot = np.flatnonzero(self.scores(x) > self.threshold)
        if not len(hot):
            return []
        gaps = np.flatnonzero(np.diff(hot) > LEFT + RIGHT)
        starts, ends = hot[np.concatenate([[0], gaps + 1])], hot[np.concatenate([gaps, [len(hot) - 1]])]
        return [(max(0, int(s) - LEFT), min(len(x), int(e) + 1 + RIGHT)) for s, e in zip(starts, ends, strict=True)]


def train(xs: list[np.ndarray], spans: list[list[tuple[int, int]]], epochs: int = 6, rate: float = 0.5, seed: int = 5) -> Gate:
    """The tables from symbols and the spans in them, by Adagrad over whole documents.

    The number of steps is fixed, so the same documents give the same tables."""
    rng = np.random.default_rng(seed)
    w = [np.zeros(TABLE, np.float32) for _ in range(3)]
    g2 = [np.full(TABLE, 1e-3, np.float32) for _ in range(3)]
    bias, b2 = -3.0, 1e-3
    for _ in range(epochs):
        for group in np.array_split(rng.permutation(len(xs)), max(1, len(xs) // 40)):
            x = np.concatenate([np.concatenate([xs[i], np.zeros(REACH, np.int16)]) for i in group])
            y, at = np.zeros(len(x), np.float32), 0
            for i in group:
                for s, e in spans[i]:
                    y[at + s : at + e] = 1
                at += len(xs[i]) + REACH
            h = _hashes(x)
            z = w[0][h] + _means(w[1][h])[0] + _means(w[2][h])[1] + np.float32(bias)
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            d *= np.where(y > 0, 8.0, 1.0)  # a missed span costs more than a part read in vain
            # the mean over places before takes its gradient from places after, and the other way round
            before, after = _means(d)
            for k, grad in enumerate((d, after, before)):
                g = np.bincount(h, grad, TABLE).astype(np.float32) / 200
                g2[k] += g * g
                w[k] -= rate * g / np.sqrt(g2[k])
            g = float(d.mean()) * 10
            b2 += g * g
            bias -= rate * g / b2**0.5
    return Gate(*w, bias, 0.0)


def kept(gate: Gate, xs: list[np.ndarray], spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(best score inside each span, scores of all places): what a threshold keeps and costs."""
    best, every = [], []
    for x, own in zip(xs, spans, strict=True):
        s = gate.scores(x)
        every.append(s)
        best += [float(s[a:b].max()) for a, b in own]
    return np.array(best), np.concatenate(every) if every else np.zeros(0)


def fit_threshold(best: np.ndarray, share: float) -> float:
    """The largest threshold that keeps ``share`` of the spans."""
    return float(np.sort(best)[int((1 - share) * len(best))]) - 1e-3 if len(best) else -np.inf
