"""String similarities and list matching that have no built-in: vectorised Arrow UDFs.

These are the only row functions that run in Python. Callers send them just the rows
that the native rules leave open.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.taxonomy import CORPORATE_SUFFIXES, ROLE_WORDS

_PUNCTUATION = re.compile(r"""[,.;:'"()\[\]{}!?@#$%^&*+=|\\/<>~`_-]""")
_SUFFIXES, _ROLES = frozenset(CORPORATE_SUFFIXES), frozenset(ROLE_WORDS)


def words(text: str) -> list[str]:
    return _PUNCTUATION.sub(" ", text.lower()).split()


def plain_name(text: str) -> str:
    return " ".join(w for w in _PUNCTUATION.sub(" ", text.upper()).split() if w not in _SUFFIXES)


def seq_ratio(a: str, b: str) -> float:
    """Share of matching runs (Ratcliff-Obershelp); not symmetric."""
    if not a or not b:
        return float(a == b)
    return SequenceMatcher(None, a, b).ratio()


def token_set_ratio(a: str, b: str) -> float:
    """The better of common words against ``a``'s, and of the words each has alone."""
    x, y = set(words(a)), set(words(b))
    if not x or not y:
        return float(x == y)
    if x == y:
        return 1.0
    line = lambda s: " ".join(sorted(s))
    return max(seq_ratio(line(x & y), line(x)), seq_ratio(line(x - y), line(y - x)))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with the bonus for up to four common first letters."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    of_b = [False] * len(b)
    found_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not of_b[j] and b[j] == c:
                of_b[j] = True
                found_a.append(c)
                break
    m = len(found_a)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(found_a, (c for c, hit in zip(b, of_b, strict=True) if hit), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    head = 0
    while head < min(4, len(a), len(b)) and a[head] == b[head]:
        head += 1
    return jaro + 0.1 * head * (1 - jaro)


def name_score(pred: str | None, exp: str | None) -> float:
    """Names: expected words within the predicted ones 1, else the best similarity."""
    p, e = plain_name(pred or ""), plain_name(exp or "")
    if not p or not e:
        return float(p == e)
    wp, we = set(words(p)), set(words(e))
    if we and we <= wp:
        return 1.0
    base = token_set_ratio(p, e)
    return max(base, jaro_winkler(p, e)) if wp & we else base


def text_f1(pred: str, exp: str) -> float:
    p, e = words(pred), words(exp)
    if not p or not e:
        return float(p == e)
    common = sum(min(p.count(w), e.count(w)) for w in set(e))
    return 2 * common / (len(p) + len(e))


def element_score(kind: str, item: str, exp: str, coverage: float = 0.7) -> float:
    """One list item against one label, by the element's type."""
    if kind == "free_text":
        label, own = set(words(exp)), set(words(item))
        share = len(label & own) / len(label) if label else 0.0
        return max(text_f1(item, exp), share) if share >= coverage else text_f1(item, exp)
    if kind == "id":
        p, e = plain_name(item), plain_name(exp)
        return float(p == e)
    return name_score(item, exp)


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of largest total gain (Hungarian method, O(n^3)). Among equally
    good assignments the one that the potentials find first, scanning rows in order."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (cur < least[1:])
            least[1:][better] = cur[better]
            way[1:][better] = j0
            open_ = np.where(used[1:], np.inf, least[1:])
            j1 = int(open_.argmin()) + 1
            delta = open_[j1 - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            owner[j0] = owner[j1]
            j0 = j1
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((c, r) for r, c in pairs) if turned else sorted(pairs)


def list_score(kind: str, pred: list[str], exp: list[str], partial: bool, match: float = 0.6, coverage: float = 0.7) -> dict:
    """Precision, recall and F1 of a predicted list, by the best assignment above ``match``.

    With ``partial`` labels, role words count as matched if any party is named, and labels
    of three to six words if they stand verbatim within an item. They come on top of the
    assignment, so precision may exceed 1.
    """
    pred, exp = [x or "" for x in pred], [x or "" for x in exp]
    n_p, n_e = len(pred), len(exp)
    if not n_p or not n_e:
        both = not n_p and not n_e
        return {"precision": 1.0 if not n_e else 0.0, "recall": 1.0 if both else 0.0, "f1": 1.0 if both else 0.0, "matched": 0, "n_predicted": n_p, "n_expected": n_e}
    is_role = lambda t: 1 <= len(words(t)) <= 3 and all(w in _ROLES for w in words(t))
    extra, real = 0, exp
    if partial:
        of_pred = [words(p) for p in pred]
        within = lambda w: 3 <= len(w) <= 6 and any(w == t[i : i + len(w)] for t in of_pred for i in range(len(t) - len(w) + 1))
        roles = [e for e in exp if is_role(e)]
        held = [e for e in exp if not is_role(e) and within(words(e))]
        real = [e for e in exp if not is_role(e) and not within(words(e))]
        extra = len(held) + (len(roles) if any(not is_role(p) for p in pred) else 0)
    matched = 0
    if real:
        gain = np.array([[element_score(kind, p, e, coverage) for e in real] for p in pred])
        matched = sum(gain[r, c] >= match for r, c in best_assignment(gain))
    matched = int(matched) + extra
    p, r = matched / n_p, matched / n_e
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if matched else 0.0, "matched": matched, "n_predicted": n_p, "n_expected": n_e}


LIST_SCORE = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")] + [T.StructField(n, T.IntegerType()) for n in ("matched", "n_predicted", "n_expected")]
)


@F.arrow_udf(T.DoubleType())
def name_score_udf(pred: pa.Array, exp: pa.Array) -> pa.Array:
    return pa.array([None if p is None and e is None else name_score(p, e) for p, e in zip(pred.to_pylist(), exp.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def seq_ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else seq_ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def token_set_ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def jaro_winkler_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def list_score_udf(kind: str = "name", match: float = 0.6, coverage: float = 0.7):
    """An Arrow UDF (predicted, expected, partial) -> struct for one element type."""
    fields = [("precision", pa.float64()), ("recall", pa.float64()), ("f1", pa.float64()), ("matched", pa.int32()), ("n_predicted", pa.int32()), ("n_expected", pa.int32())]

    @F.arrow_udf(LIST_SCORE)
    def score(pred: pa.Array, exp: pa.Array, partial: pa.Array) -> pa.Array:
        rows = [list_score(kind, p or [], e or [], bool(q), match, coverage) for p, e, q in zip(pred.to_pylist(), exp.to_pylist(), partial.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct(fields))

    return score
