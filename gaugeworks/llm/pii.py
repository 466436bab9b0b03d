"""Personal data in free text: found by a tagger, replaced by typed placeholders.

A learned first stage (:mod:`gaugeworks.llm.gate`) picks the parts of a text that the
tagger has to read. Parts are cut into overlapping windows; windows of like length are
tagged together. A span counts from the window in whose core it begins, where the
tagger saw text on both sides, and from either window if it touches the edge between
their cores. Spans that overlap are reconciled over the whole text: of all sets of spans
that don't overlap, the one in which the tags are furthest ahead of "outside", summed
over its characters, stays. An exact check follows: each span is snapped to the form of
its kind, or dropped if it has none.
"""

from __future__ import annotations

import bisect
import hashlib
import io
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.pii_rules import KINDS, snap
from gaugeworks.llm.tagger import Tagger, symbols
from gaugeworks.runtime import spread

#: The tagger's weights, trained by train_pii; a parameter of every function here.
WEIGHTS = str(Path(__file__).with_name("pii_tagger.npz"))
#: Characters of a window, of its left and right margins, and windows tagged at once.
WINDOW, LEFT, RIGHT, TOGETHER = 448, 32, 96, 256
#: Characters of text that are worked on at once.
CHUNK = 1_500_000
#: Bytes of weights that are sent to the workers at most.
WEIGHTS_LIMIT = 50_000_000


def _windows(length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, core start, core end) of the windows over a text."""
    core = WINDOW - LEFT - RIGHT
    if length <= WINDOW:
        yield 0, length, 0, length
        return
    at = 0
    while at < length:
        stop = length if at + core + RIGHT >= length else at + core
        yield max(0, at - LEFT), min(length, stop + RIGHT), at, stop
        at = stop


def settle(spans: dict[tuple[int, int, str], float]) -> list[tuple[int, int, str]]:
    """Of all sets of spans that don't overlap the one of the largest total weight, in order;
    of equal ones that with the earlier spans. Weights are positive."""
    order = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in order]
    best: list[float] = [0.0]
    take: list[bool] = []
    for s in order:
        alone = spans[s] + best[bisect.bisect_right(ends, s[0], 0, len(best) - 1)]
        take.append(alone > best[-1])
        best.append(max(alone, best[-1]))
    out, i = [], len(order)
    while i:
        if take[i - 1]:
            out.append(order[i - 1])
            i = bisect.bisect_right(ends, order[i - 1][0], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def spans_in(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """(begin, end, kind) of the personal data in each text, in code points."""
    jobs: list[tuple[int, int, int, int, np.ndarray]] = []
    for k, text in enumerate(texts):
        if text:
            x = symbols(text)
            for first, last in tagger.gate.parts(x) if tagger.gate else [(0, len(x))]:
                jobs += [(k, first + start, first + low, first + high, x[first + start : first + end]) for start, end, low, high in _windows(last - first)]
    jobs.sort(key=lambda j: len(j[4]))
    raw: list[dict[tuple[int, int, str], float]] = [{} for _ in texts]
    for g in range(0, len(jobs), TOGETHER):
        group = jobs[g : g + TOGETHER]
        x = np.zeros((len(group[-1][4]), len(group)), np.int16)
        for c, job in enumerate(group):
            x[: len(job[4]), c] = job[4]
        tags, ahead = tagger.decode_scored(x)
        begins = (tags > 0) & (tags % 2 == 1)
        for c in np.flatnonzero(begins.any(0)):
            k, start, low, high, piece = group[c]
            column = tags[:, c]
            for t in np.flatnonzero(begins[:, c]):
                e = t + 1
                while e < len(piece) and column[e] == column[t] + 1:
                    e += 1
                if low <= start + t <= high or start + t < low <= start + e:
                    span = (int(start + t), int(start + e), KINDS[(column[t] - 1) // 2])
                    raw[k][span] = max(raw[k].get(span, 0.0), max(1e-6, float(ahead[t:e, c].sum())))
    out = []
    for text, found in zip(texts, raw, strict=True):
        formed = {s: at for s in found if (at := snap(text, *s))}
        exact: dict[tuple[int, int, str], float] = {}
        for s in settle({s: found[s] for s in formed}):
            for at in formed[s]:
                exact[(*at, s[2])] = max(exact.get((*at, s[2]), 0.0), found[s])
        out.append(settle(exact))
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``[KIND]`` for each span and all else unchanged."""
    parts, at = [], 0
    for begin, end, kind in spans:
        parts += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


_LOADED: dict[str, Tagger] = {}


def _shared(df: DataFrame, weights: str):
    """A function that gives the tagger, loaded once per worker."""
    data = Path(weights).read_bytes()
    if len(data) > WEIGHTS_LIMIT:
        raise ValueError(f"{weights} is too large for a tagger")
    key, shared = hashlib.sha1(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data)

    def load() -> Tagger:
        if key not in _LOADED:
            _LOADED[key] = Tagger.load(io.BytesIO(shared.value))
        return _LOADED[key]

    return load


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def find_spans(df: DataFrame, row_id: str, text: str, weights: str = WEIGHTS) -> DataFrame:
    """(row_id, begin_at, end_at, kind) of the personal data in ``text``, in code points.

    Null, empty and blank texts have none; very long texts are worked through window by
    window. Repeated rows come out again. Rows are tagged where they lie, unless
    there are fewer partitions than cores.
    """
    load = _shared(df, weights)
    source = spread(df.select(F.col(row_id).alias("rec"), F.col(text).alias("text")), "rec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = load()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _chunks(texts):
                at, spans = [], []
                for i, found in enumerate(spans_in([t or "" for t in texts[low:high]], tagger), low):
                    at += [i] * len(found)
                    spans += found
                columns = list(zip(*spans, strict=True)) if spans else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int32())),
                        pa.array(list(columns[0]), pa.int64()),
                        pa.array(list(columns[1]), pa.int64()),
                        pa.array(list(columns[2]), pa.string()),
                    ],
                    ["rec", "begin_at", "end_at", "kind"],
                )

    kind = source.schema["rec"].dataType.simpleString()
    return source.mapInArrow(run, f"rec {kind}, begin_at bigint, end_at bigint, kind string").withColumnRenamed("rec", row_id)


def redact(df: DataFrame, row_id: str, text: str, weights: str = WEIGHTS) -> DataFrame:
    """(row_id, text) with typed placeholders; null stays null, empty stays empty."""
    load = _shared(df, weights)
    source = spread(df.select(F.col(row_id).alias("rec"), F.col(text).alias("text")), "rec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = load()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _chunks(texts):
                part = texts[low:high]
                found = spans_in([t or "" for t in part], tagger)
                new = [t if t is None else redacted(t, s) for t, s in zip(part, found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(new, pa.string())], ["rec", "text"])

    kind = source.schema["rec"].dataType.simpleString()
    return source.mapInArrow(run, f"rec {kind}, text string").withColumnRenamed("rec", row_id)
