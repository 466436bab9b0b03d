"""Freely typed values mapped to a canonical list.

An Aho-Corasick automaton over canonical names, labels and aliases finds the mentions
embedded in the folded value; of overlapping mentions the longest wins, of the rest
the one that covers most. Values without a mention go to a token-set similarity in
which tokens are compared by edit distance (with transpositions), so misspelt,
abbreviated and run-together words still find their entry. Below a threshold, or if
two entries are equally near, a value is unmatched.

Folding: compatibility forms, look-alike letters of other scripts, accents, digits that
stand for letters, camel case, punctuation, file endings. Numbers and version marks are
left out unless the list itself has them ("Phase 2 Study"). What a caller knows of the
words in the list, such as words that say nothing of the kind of entry, is a parameter
(:class:`Vocabulary`), empty by default.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.runtime import bounded_rows

UNMATCHED = "unmatched"
#: Entries of a canonical list that are carried to the tasks at most.
CATALOG_LIMIT = 100_000
#: Least similarity of a match, and by how much it must be ahead of other entries.
THRESHOLD, AHEAD = 0.62, 0.02
#: Names of up to so many letters, and their least similarity: one letter more or less, not one that differs.
SHORT, SHORT_THRESHOLD = 4, 0.75
#: Values and folded values that a worker remembers.
MEMO = 400_000
#: Words of values whose similarities to all words of the entries a worker remembers, in bytes.
WORDS_MEMO = 50_000_000
#: For rounding, by how much a bound must be below what would count.
SLACK = 1e-9

# Letters of other scripts that look like Latin ones, and digits that stand for letters.
LOOK_ALIKES = str.maketrans(
    "аАеЕоОрРсСхХуУкКмМтТвВнНіІјЈѕЅԁһԛԝαΑβΒεΕηΗιΙκΚμΜνΝοΟρΡτΤυΥχΧ",
    "aAeEoOpPcCxXyYkKmMtTbBhHiIjJsSdhqwaAbBeEnHiIkKmMvNoOpPtTuYxX",
)
DIGITS = str.maketrans("013457", "oleast")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]{2})")
_ENDING = re.compile(r"\.(?:pdf|docx?|txt|rtf|xlsx?)\b", re.I)
_OTHER = re.compile(r"[^0-9a-z]+")
_VERSION = re.compile(r"v\d+|\d+")


class Pattern:
    """Edit distance (insertions, deletions, changes, swaps) to one word, bit-parallel."""

    __slots__ = ("bits", "full", "size", "top", "word")

    def __init__(self, word: str):
        self.word, self.size = word, len(word)
        self.full, self.top = (1 << self.size) - 1, 1 << max(0, self.size - 1)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(word):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def distance(self, other: str) -> int:
        if not self.size:
            return len(other)
        plus, minus, same, before, score, full = self.full, 0, 0, 0, self.size, self.full
        for c in other:
            here = self.bits.get(c, 0)
            swap = (((~same & full) & here) << 1) & before
            same = ((((here & plus) + plus) ^ plus) | here | minus | swap) & full
            up, down = minus | (~(same | plus) & full), same & plus
            if up & self.top:
                score += 1
            elif down & self.top:
                score -= 1
            up, down = (up << 1 | 1) & full, (down << 1) & full
            plus, minus, before = down | (~(same | up) & full), up & same, here
        return score

    def similarity(self, other: str) -> float:
        most = max(self.size, len(other))
        return 1 - self.distance(other) / most if most else 1.0


@dataclass(frozen=True)
class Vocabulary:
    """What a caller knows of the names in a list: ``plain`` words say nothing of the kind of
    entry and are left out on both sides, ``tails`` are endings that values run together with
    a name."""

    plain: tuple[str, ...] = ()
    tails: tuple[str, ...] = ()


NO_VOCABULARY = Vocabulary()


def fold(value: str, numbers: frozenset[str] = frozenset()) -> list[str]:
    """The words of a value in one writing, plain words included; of numbers and version marks
    only those in ``numbers``."""
    text = unicodedata.normalize("NFKC", value).translate(LOOK_ALIKES)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    text = _CAMEL.sub(" ", _ENDING.sub(" ", text)).lower()
    words = [w for w in _OTHER.sub(" ", text).split() if w in numbers or not _VERSION.fullmatch(w)]
    return [w if w.isalpha() or w in numbers else w.translate(DIGITS) for w in words]


def numbers_of(names: Iterable[str]) -> frozenset[str]:
    """The numbers and version marks in names."""
    found = (w for name in names for w in _OTHER.sub(" ", unicodedata.normalize("NFKC", name).lower()).split())
    return frozenset(w for w in found if _VERSION.fullmatch(w))


def _letters(text: str) -> np.ndarray:
    """How often each of 0-9 and a-z occurs, at most 255 times."""
    found = np.bincount(np.frombuffer(text.encode("ascii", "replace"), np.uint8), minlength=123)[:123]
    return np.minimum(np.concatenate([found[48:58], found[97:123]]), 255).astype(np.uint8)


class Entry:
    """One way to write an entry: its telling words and patterns to compare with."""

    def __init__(self, key: str, words: list[str], tails: tuple[str, ...] = ()):
        self.key, self.words = key, words
        self.joined = "".join(words)
        self.patterns = [Pattern(w) for w in words]
        self.whole = Pattern(self.joined)
        self.tailed = [Pattern(self.joined + t) for t in tails]
        self.weight = sum(map(len, words))

    def similarity(self, words: list[str], joined: str) -> float:
        best = 0.9 if len(joined) >= 5 and self.joined.startswith(joined) else self.whole.similarity(joined)
        if self.tailed and len(joined) > self.weight:
            best = max(best, *(p.similarity(joined) for p in self.tailed))
        # token set: every word of the entry with its nearest word of the value
        got, used = 0.0, 0
        for p in self.patterns:
            near, of = 0.0, 0
            for w in words:
                s = 0.97 if len(w) >= 4 and p.word.startswith(w) else p.similarity(w)
                if s > near:
                    near, of = s, len(w)
            got += near * p.size
            used += of
        rest = max(0, len(joined) - used)
        best = max(best, got / (self.weight + 0.5 * rest)) if self.weight else 0.0
        return best if self.weight > SHORT or best >= SHORT_THRESHOLD else 0.0


class Catalog:
    """Canonical entries with everything that is needed to map values to them."""

    def __init__(self, rows: list[tuple[str, str | None, list[str] | None]], threshold: float = THRESHOLD, ahead: float = AHEAD, vocabulary: Vocabulary = NO_VOCABULARY):
        import ahocorasick

        self.threshold, self.ahead, self.tails = threshold, ahead, vocabulary.tails
        self.plain_words = frozenset(vocabulary.plain)
        self.plain_patterns = [Pattern(w) for w in vocabulary.plain if len(w) >= 4]
        self.entries: list[Entry] = []
        self._memo: dict[tuple[str, ...], str] = {}
        self._values: dict[str, str] = {}
        self._plain: dict[str, bool] = {}
        telling: set[str] = set()
        names: dict[str, set[str]] = {}
        named = [(key, [key, label or "", *(a for a in aliases or [] if a)]) for key, label, aliases in rows if key is not None]
        self.numbers = numbers_of(name for _, all_names in named for name in all_names)
        for key, all_names in named:
            seen = set()
            for name in all_names:
                full = fold(name, self.numbers)
                words = [w for w in full if w not in self.plain_words] or full
                if not words or tuple(words) in seen:
                    continue
                seen.add(tuple(words))
                telling.update(w for w in words if len(w) >= 4)
                names.setdefault(" ".join(full), set()).add(key)
                names.setdefault(" ".join(words), set()).add(key)
                self.entries.append(Entry(key, words, self.tails))
        self.telling = [Pattern(w) for w in sorted(telling)]
        self.automaton = ahocorasick.Automaton()
        for name, keys in names.items():
            if len(keys) == 1 and name:
                self.automaton.add_word(f" {name} ", (len(name), next(iter(keys))))
        self.automaton.make_automaton()
        self._prepare()

    def _prepare(self) -> None:
        """Arrays over all entries for :meth:`bounds`."""
        words = {w: k for k, w in enumerate(sorted({w for e in self.entries for w in e.words}))}
        self.vocabulary = [Pattern(w) for w in words]
        self.word_at = np.array([words[w] for e in self.entries for w in e.words], np.int64)
        self.word_size = np.array([len(w) for e in self.entries for w in e.words], np.float64)
        self.word_first = np.cumsum([0, *(len(e.words) for e in self.entries)])[:-1]
        self.weight = np.array([e.weight for e in self.entries], np.float64)
        self.whole = [np.array([_letters(e.joined + t) for e in self.entries], np.uint8).reshape(-1, 36) for t in ("", *self.tails)]
        self._near: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        """Similarity of a word to each word of the entries, as in :meth:`Entry.similarity`."""
        found = self._near.get(word)
        if found is None:
            found = np.array([0.97 if len(word) >= 4 and p.word.startswith(word) else p.similarity(word) for p in self.vocabulary], np.float64)
            if len(self._near) * found.nbytes >= WORDS_MEMO:
                self._near.clear()
            self._near[word] = found
        return found

    def bounds(self, words: list[str], joined: str) -> np.ndarray:
        """No less than the similarity of each entry: shared letters for the whole (no edit
        distance is below the letters that differ), the token set as it is."""
        size, letters = len(joined), _letters(joined)
        most = np.zeros(len(self.entries))
        for tail, counts in zip(("", *self.tails), self.whole, strict=True):
            longer = self.weight + len(tail)
            # letters beyond 255 of a kind aren't counted, so they may all be shared
            shared = np.minimum(counts, letters).sum(1) if size < 256 else np.minimum(longer, size)
            found = np.where(longer < 256, shared, np.minimum(longer, size)) / np.maximum(longer, size)
            most = np.maximum(most, np.where(size > self.weight, found, 0) if tail else found)
        if size >= 5:
            begins = np.fromiter((e.joined.startswith(joined) for e in self.entries), bool, len(self.entries))
            most[begins] = np.maximum(most[begins], 0.9)
        near, of = np.zeros(len(self.vocabulary)), np.zeros(len(self.vocabulary))
        for w in words:
            s = self._word(w)
            better = s > near
            near[better], of[better] = s[better], len(w)
        got = np.add.reduceat(near[self.word_at] * self.word_size, self.word_first)
        rest = np.maximum(0, size - np.add.reduceat(of[self.word_at], self.word_first))
        return np.maximum(most, got / (self.weight + 0.5 * rest))

    def plain(self, word: str) -> bool:
        """Whether a word is a plain word, or nearer to one than to any telling word."""
        if word in self.plain_words:
            return True
        found = self._plain.get(word)
        if found is None:
            near = min((p.distance(word) for p in self.plain_patterns if abs(p.size - len(word)) <= 2), default=9) if len(word) >= 4 else 9
            found = near <= (1 if len(word) < 6 else 2) or near == 3 and len(word) >= 9
            found = found and not any(p.distance(word) <= near for p in self.telling if abs(p.size - len(word)) <= near)
            if len(self._plain) >= MEMO:
                self._plain.clear()
            self._plain[word] = found
        return found

    def mention(self, words: list[str]) -> str | None:
        """The entry of the longest mention; None if there is none."""
        if not len(self.automaton):
            return None
        text = f" {' '.join(words)} "
        found = sorted(((size, end, key) for end, (size, key) in self.automaton.iter(text)), key=lambda x: (-x[0], x[1]))
        taken: list[tuple[int, int]] = []
        cover: Counter[str] = Counter()
        for size, end, key in found:
            start = end - size
            if all(start > e or end < s for s, e in taken):
                taken.append((start, end))
                cover[key] += size
        if not cover:
            return None
        most = max(cover.values())
        best = [k for k, n in cover.items() if n == most]
        return best[0] if len(best) == 1 else None

    def nearest(self, words: list[str]) -> str:
        joined = "".join(words)
        if not self.entries:
            return UNMATCHED
        bounds = self.bounds(words, joined)
        best, score = 0.0, {}
        # nothing below the best, or the threshold, by more than the lead can change the outcome
        for i in np.argsort(-bounds, kind="stable"):
            if bounds[i] < max(best, self.threshold) - self.ahead - SLACK:
                break
            e = self.entries[i]
            score[e.key] = max(score.get(e.key, 0), e.similarity(words, joined))
            best = max(best, score[e.key])
        if not score:
            return UNMATCHED
        order = sorted(score.items(), key=lambda x: -x[1])
        if order[0][1] < self.threshold or len(order) > 1 and order[0][1] - order[1][1] < self.ahead:
            return UNMATCHED
        return order[0][0]

    def find(self, value: str) -> str:
        """The key of the entry that is meant, or ``unmatched``."""
        found = self._values.get(value)
        if found is None:
            words = tuple(fold(value, self.numbers))
            found = self._memo.get(words)
            if found is None:
                telling = [w for w in words if not self.plain(w)]
                found = self.mention(telling) or self.mention(list(words)) or (self.nearest(telling) if telling else UNMATCHED)
                if len(self._memo) >= MEMO:
                    self._memo.clear()
                self._memo[words] = found
            if len(self._values) >= MEMO:
                self._values.clear()
            self._values[value] = found
        return found


_LOADED: dict[str, Catalog] = {}


def map_values(
    df: DataFrame, row_id: str, fields: list[str], catalog: DataFrame, skip: list[str] | None = None, vocabulary: Vocabulary = NO_VOCABULARY
) -> DataFrame:
    """(row_id, field, subtype_key) of the free values in ``fields``.

    ``catalog`` has subtype_key, label and aliases; its size is checked before it goes to
    the tasks. Left out are values that need no mapping: null, blank, exactly a key or
    one of ``skip``. Every other value gets the entry that is meant or ``unmatched``. Rows
    are mapped where they lie: nothing is shuffled, and each worker remembers what it
    has seen. Repeated rows come out repeatedly; an empty catalog leaves all unmatched.
    """
    spark = df.sparkSession
    rows = [(r[0], r[1], list(r[2]) if r[2] else None) for r in bounded_rows(catalog.select("subtype_key", "label", "aliases"), CATALOG_LIMIT, "the canonical list")]
    shared = spark.sparkContext.broadcast(rows)
    key = hashlib.sha1(repr((rows, vocabulary)).encode()).hexdigest()
    exact = [r[0] for r in rows if r[0] is not None] + list(skip or [])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    long = df.select(F.col(row_id).alias("rec"), each.alias("v")).select("rec", "v.field", "v.value")
    free = long.where(F.col("value").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}\p{Cf}]") & ~F.col("value").isin(exact))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED[key] = Catalog(shared.value, vocabulary=vocabulary)
        find = _LOADED[key].find
        for batch in batches:
            keys = [find(v) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string())], ["rec", "field", "subtype_key"])

    kind = long.schema["rec"].dataType.simpleString()
    return free.mapInArrow(run, f"rec {kind}, field string, subtype_key string").withColumnRenamed("rec", row_id)
