"""Trains the tagger of personal data: python -m gaugeworks.llm.train_pii TABLES OUT [STEPS],
or only its first stage, for weights that exist: ... train_pii TABLES WEIGHTS gate.

Labels come from the weak labeller on a bounded sample of documents (SAMPLE rows, those
of the smallest hash of the id, streamed from the file), to which names made of letters at
random and re-cased spans are mixed in, so that the tagger leans on surroundings and not
on known words only. Every tenth document is held out; precision and recall on it are
printed. The number of steps is fixed, so the same sample gives the same weights.

The first stage is trained on the spans that the tagger finds in the same sample without
it. Of the documents that aren't held out, a quarter sets its threshold: the largest that
keeps all of their spans, less a margin.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pyarrow.parquet as pq

from gaugeworks.llm.gate import fit_threshold, kept
from gaugeworks.llm.gate import train as train_tables
from gaugeworks.llm.pii import spans_in
from gaugeworks.llm.pii_rules import KINDS, NameForms, weak_labels
from gaugeworks.llm.tagger import Adam, Tagger, symbols

#: Labelled documents that are used at most.
SAMPLE = 8_000
HIDDEN, WIDTH, BATCH, RATE = 48, 144, 64, 0.006
#: Batches of a training, those between reports, and of the first stage its rounds over the documents
#: and how far below the least score of a kept span its threshold lies.
STEPS, REPORT, ROUNDS, MARGIN = 16_000, 200, 40, 3.0


def labelled(folder: str) -> list[tuple[int, str, list[tuple[int, int, str]]]]:
    names = pq.read_table(f"{folder}/name_lexicon.parquet").to_pydict()
    forms = NameForms(list(zip(names["name"], names["name_kind"], strict=True)))
    rows: list[tuple[int, int, str]] = []  # a heap of the SAMPLE smallest hashes
    for batch in pq.ParquetFile(f"{folder}/documents.parquet").iter_batches(1024, columns=["doc_id", "text"]):
        for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t:
                own = (-((i * 2654435761) % 2**32), i, t)
                if len(rows) < SAMPLE:
                    heapq.heappush(rows, own)
                elif own > rows[0]:
                    heapq.heapreplace(rows, own)
    return [(i, t, weak_labels(t, forms)) for _, i, t in sorted(rows, reverse=True)]


def tags_of(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(text), np.int8)
    for s, e, k in spans:
        at = KINDS.index(k)
        y[s] = 1 + 2 * at
        y[s + 1 : e] = 2 + 2 * at
    return y


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    out, t = [], 0
    while t < len(tags):
        if tags[t] and tags[t] % 2:
            e = t + 1
            while e < len(tags) and tags[e] == tags[t] + 1:
                e += 1
            out.append((t, e, KINDS[(tags[t] - 1) // 2]))
            t = e
        else:
            t += 1
    return out


def evaluate(tagger: Tagger, docs: list) -> dict[str, tuple[float, float]]:
    got, want, hit = ({k: 0 for k in KINDS} for _ in range(3))
    for (_, _, gold), found in zip(docs, spans_in([d[1] for d in docs], tagger), strict=True):
        for _, _, k in gold:
            want[k] += 1
        for s in found:
            got[s[2]] += 1
            hit[s[2]] += s in gold
    return {k: (hit[k] / max(1, got[k]), hit[k] / max(1, want[k])) for k in KINDS}


def train_gate(folder: str, weights: str) -> None:
    """Adds a first stage to the weights of a tagger."""
    docs, tagger = labelled(folder), Tagger.load(weights)
    tagger.gate = None
    spans = [[(s, e) for s, e, _ in found] for found in spans_in([d[1] for d in docs], tagger)]
    xs = [symbols(t) for _, t, _ in docs]
    held, rest = list(range(0, len(docs), 10)), [i for i in range(len(docs)) if i % 10]
    judge, learn = rest[::4], [i for k, i in enumerate(rest) if k % 4]
    pick = lambda at: ([xs[i] for i in at], [spans[i] for i in at])
    gate = train_tables(*pick(learn), epochs=ROUNDS)
    gate.threshold = fit_threshold(kept(gate, *pick(judge))[0], 1.0) - MARGIN
    best, _ = kept(gate, *pick(held))
    read = sum(e - s for i in held for s, e in gate.parts(xs[i])) / max(1, sum(len(xs[i]) for i in held))
    print(f"of {len(best)} spans in held-out documents {(best > gate.threshold).mean():.4f} are kept, {read:.4f} of the text is read by the tagger", flush=True)
    tagger.gate = gate
    tagger.save(weights)


def train(folder: str, out: str, steps: int) -> None:
    docs = labelled(folder)
    held, rest = docs[::10], [d for i, d in enumerate(docs) if i % 10]
    xs, ys = [symbols(t) for _, t, _ in rest], [tags_of(t, s) for _, t, s in rest]
    spots = [(d, (s + e) // 2) for d, (_, _, spans) in enumerate(rest) for s, e, _ in spans]
    rng = np.random.default_rng(11)
    tagger = Tagger.fresh(HIDDEN, len(KINDS))
    adam, loss = Adam(tagger.w), 0.0
    letters = {u: np.array([ord(c) - 31 for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if u else "abcdefghijklmnopqrstuvwxyz")], np.int16) for u in (True, False)}
    name_b = 1 + 2 * KINDS.index("name")
    for seen in range(steps):
        x, y = np.zeros((WIDTH, BATCH), np.int16), np.zeros((WIDTH, BATCH), np.int8)
        for k in range(BATCH):
            if rng.random() < 0.7 and spots:
                d, at = spots[rng.integers(len(spots))]
                at -= int(rng.integers(WIDTH // 6, WIDTH - WIDTH // 6))
            else:
                d = int(rng.integers(len(xs)))
                at = int(rng.integers(max(1, len(xs[d]) - WIDTH // 2)))
            at = max(0, at)
            piece, tags = xs[d][at : at + WIDTH].copy(), ys[d][at : at + WIDTH].copy()
            if len(tags) and tags[0] and not tags[0] % 2:  # a span that begins before the window
                cut = int(np.argmax(tags != tags[0])) if (tags != tags[0]).any() else len(tags)
                piece, tags = piece[cut:], tags[cut:]
            if rng.random() < 0.25:  # other letters in some names: their surroundings must do
                name = (tags == name_b) | (tags == name_b + 1)
                for upper in (True, False):
                    low, high = (34, 60) if upper else (66, 92)
                    where = np.flatnonzero(name & (piece >= low) & (piece < high) & (rng.random(len(piece)) < 0.4))
                    piece[where] = letters[upper][rng.integers(26, size=len(where))]
            x[: len(piece), k], y[: len(tags), k] = piece, tags
        value, g = tagger.loss(x, y)
        adam.step(tagger.w, g, RATE * (min(1, seen / 50) if seen < 50 else 0.5 * (1 + np.cos(np.pi * seen / steps)) + 0.01))
        loss = 0.98 * loss + 0.02 * value if seen else value
        if seen % REPORT == REPORT - 1:
            print(f"{seen + 1} batches, loss {loss:.4f}", flush=True)
            tagger.save(out)
    tagger.save(out)
    train_gate(folder, out)
    for k, (p, r) in evaluate(Tagger.load(out), held).items():
        print(f"{k}: precision {p:.4f}, recall {r:.4f} against the labels of {len(held)} held-out documents", flush=True)


if __name__ == "__main__":
    if sys.argv[3:] == ["gate"]:
        train_gate(sys.argv[1], sys.argv[2])
    else:
        train(sys.argv[1], sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else STEPS)
