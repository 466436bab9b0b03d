"""Text normalisation and token measures as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.taxonomy import CORPORATE_SUFFIXES, NO_RELATED, ROLE_WORDS, STOPWORDS

PUNCTUATION = r"""[,.;:'"()\[\]{}!?@#$%^&*+=|\\/<>~`_\-]"""
SPACE = r"[\s\x0B\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, PUNCTUATION, " "), f"{SPACE}+"), lambda w: w != "")


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation; null text has none."""
    return F.coalesce(_words(F.lower(text)), F.array().cast("array<string>"))


def normalized(text: Column) -> Column:
    """Upper case, punctuation and corporate suffixes gone, single spaces."""
    words = _words(F.upper(F.coalesce(text, F.lit(""))))
    return F.array_join(F.filter(words, lambda w: ~w.isin(CORPORATE_SUFFIXES)), " ")


def content_tokens(words: Column) -> Column:
    """The set of words that aren't stopwords."""
    return F.array_except(words, F.array(*map(F.lit, STOPWORDS)))


def token_f1(pred: Column, exp: Column) -> Column:
    """F1 of two arrays of words as multisets; both empty 1, one empty 0."""
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))

    def of(p: Column, e: Column) -> Column:
        common = F.aggregate(F.array_distinct(e), F.lit(0), lambda acc, w: acc + F.least(count(e, w), count(p, w)))
        return let(common, lambda c: F.when((F.size(e) == 0) | (F.size(p) == 0), (F.size(e) == F.size(p)).cast("double")).otherwise(2 * c / (F.size(p) + F.size(e))))

    return let(pred, lambda p: let(exp, lambda e: of(p, e)))


def containment(pred: Column, exp: Column) -> Column:
    """Share of the expected words that the prediction holds (both as sets)."""

    def of(p: Column, e: Column) -> Column:
        none = (F.size(e) == 0) | (F.size(p) == 0)
        return F.when(none, (F.size(e) == F.size(p)).cast("double")).otherwise(F.size(F.array_intersect(e, p)) / F.size(e))

    return let(pred, lambda p: let(exp, lambda e: of(p, e)))


def jaccard(a: Column, b: Column) -> Column:
    """Word-set Jaccard as used for clauses: ``.,;:`` gone, ``/`` a space, split at single spaces."""
    words = lambda t: F.split(F.regexp_replace(F.lower(F.regexp_replace(t, "[.,;:]", "")), "/", " "), " ")
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return let(words(a), lambda x: let(words(b), lambda y: share(x, y)))


def bare(text: Column) -> Column:
    """Without blanks, line ends and backticks at either end."""
    return F.regexp_replace(text, "^[ \\n`]+|[ \\n`]+$", "")


def said_no_related(output: Column) -> Column:
    return F.lower(bare(F.coalesce(output, F.lit("")))).contains(NO_RELATED)


def clause_covered(spans: Column, output: Column) -> Column:
    """Every span stands verbatim in the output."""
    return F.forall(spans, lambda s: F.coalesce(bare(output).contains(bare(s)), F.lit(False)))


def folded(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def is_role(text: Column) -> Column:
    """One to three words, all of them roles."""
    return let(tokens(text), lambda ws: F.size(ws).between(1, 3) & F.forall(ws, lambda w: w.isin(ROLE_WORDS)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, cut to [0, 1]; null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return let(F.try_divide(dot(a, b), size), lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))))


def rescued(score: Column, similarity: Column, below: float) -> Column:
    """A score below ``below`` is lifted to the similarity where there is one."""
    return F.when((score < below) & similarity.isNotNull(), F.greatest(score, similarity)).otherwise(score)


#: Where a text of several clauses is cut into spans.
CLAUSE_CUT = r"\s*\n\s*|\s*;\s+|(?<=[A-Za-z)][.!?])\s+(?=[A-Z0-9\"(])"


def percent(value: Column, digits: int = 1) -> Column:
    """A share as text, ``n/a`` for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(F.concat(F.format_string(f"%.{digits}f", 100 * value), F.lit("%")))


def clause_spans(items: Column, least: int = 4) -> Column:
    """Items cut into clauses; pieces of under ``least`` words join the one before, repeated
    spans (by their words) are left out."""
    pieces = lambda item: F.filter(F.transform(F.split(item, CLAUSE_CUT), stripped), lambda p: p != "")
    merged = lambda item: F.aggregate(
        pieces(item),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.size(tokens(p)) < least),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), p))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    flat = F.flatten(F.transform(F.coalesce(items, F.array().cast("array<string>")), merged))
    key = lambda p: F.array_join(tokens(p), " ")
    # of spans with the same words the first: each span's words are joined once
    first = lambda ks: lambda p, i: F.array_position(ks, ks[i]) == i + 1
    return let(flat, lambda ps: let(F.transform(ps, key), lambda ks: F.filter(ps, first(ks))))
