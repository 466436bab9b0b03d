"""Label normalisation and equivalence as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.text import folded, let, stripped
from gaugeworks.taxonomy import (
    CONSIDERATION_ALIASES,
    CONSIDERATIONS,
    DOC_CLASSES,
    EQUIVALENT,
    EQUIVALENT_SUBCLASSES,
    NO_WORDS,
    SUBTYPE_ALIASES,
    SUBTYPE_LABELS,
    TASK_KINDS,
    UNKNOWN,
    YES_WORDS,
)


def _squeezed(text: str) -> str:
    return "".join(c for c in text.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def class_patterns(classes: list[str] | None = None) -> dict[str, str]:
    """A pattern for each class: its words with a blank, an underscore or nothing between."""
    return {c: r"\b" + "[_ ]?".join(c.split("_")) + r"\b" for c in classes or DOC_CLASSES}


def normalize_label(value: Column, valid: dict[str, str] | None = None) -> Column:
    """A class from a model's answer: the doc_type of a JSON object, an exact class, the
    first class whose pattern occurs, else the text without quotes and marks; null is ''."""
    valid = valid or class_patterns()

    def told(text: Column) -> Column:
        inner = F.when(text.startswith("{") & text.endswith("}"), F.get_json_object(text, "$.doc_type"))
        return F.coalesce(F.nullif(inner, F.lit("")), text)

    def classed(text: Column) -> Column:
        out = F.when(text.isin(list(valid)), text)
        for name, pattern in valid.items():
            out = out.when(text.rlike(pattern), F.lit(name))
        return out.otherwise(F.regexp_replace(text, r'^["`*_ ]+|["`*_ ]+$', ""))

    return let(F.lower(stripped(F.coalesce(value, F.lit("")))), lambda t: let(told(t), classed))


def normalize_subtype(value: Column) -> Column:
    """A family from free text: its key, an alias, or a label that begins alike in eight
    letters; null, blank and all else is ``other``."""
    key = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]", "")
    exact = {k: k for k in SUBTYPE_LABELS if k == _squeezed(k)} | {a: f for a, f in SUBTYPE_ALIASES.items() if a == _squeezed(a)}
    heads = {_squeezed(label)[:8]: family for family, label in reversed(SUBTYPE_LABELS.items())}
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return let(key, lambda k: F.coalesce(F.try_element_at(table(exact), k), F.try_element_at(table(heads), F.substring(k, 1, 8)), F.lit(UNKNOWN)))


def normalize_subclass(value: Column, allowed: list[str] | None = None) -> Column:
    """A subclass of one dimension; without ``allowed`` the trimmed text itself."""
    raw = stripped(value)
    key = F.regexp_replace(F.lower(raw), "[^a-z0-9]", "")
    out = F.when(value.isNull() | (key == ""), F.lit(UNKNOWN))
    if allowed is None:
        return out.otherwise(raw)
    out = out.when(raw.isin(allowed), raw)
    for candidate in allowed:
        out = out.when(key == _squeezed(candidate), F.lit(candidate))
    return out.otherwise(F.lit(UNKNOWN))


def normalize_consideration(value: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in CONSIDERATION_ALIASES.items() for x in kv])
    named = lambda t: F.when(F.regexp_replace(t, " ", "_").isin(CONSIDERATIONS), F.regexp_replace(t, " ", "_"))
    return let(folded(F.coalesce(value, F.lit(""))), lambda t: F.coalesce(F.try_element_at(aliases, t), named(t), F.lit(UNKNOWN)))


def normalize_yes_no(value: Column) -> Column:
    text = folded(F.coalesce(value, F.lit("")))
    return F.when(text.isin(YES_WORDS), "yes").when(text.isin(NO_WORDS), "no").otherwise(text)


def normalize_answer(task: str, value: Column, valid: dict[str, str] | None = None) -> Column:
    """The normaliser of a task's kind."""
    kind = TASK_KINDS.get(task, task)
    if kind == "subtype":
        return normalize_subtype(value)
    if kind == "legalbench":
        return normalize_yes_no(value)
    if kind == "maud_question":
        return folded(F.coalesce(value, F.lit("")))
    return normalize_label(value, valid)


def _pairs(a: Column, b: Column, pairs: list[tuple[str, str]]) -> Column:
    found = F.lit(False)
    for x, y in pairs:
        found = found | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return found


def equivalent_subtypes(a: Column, b: Column) -> Column:
    """The same family or two that count for one another (not transitive)."""
    return (a == b) | _pairs(a, b, EQUIVALENT)


def equivalent_subclasses(a: Column, b: Column, allowed: list[str] | None = None) -> Column:
    """Like :func:`equivalent_subtypes`, null equal to null; pairs count within ``allowed``."""
    pairs = [p for p in EQUIVALENT_SUBCLASSES if allowed is None or set(p) <= set(allowed)]
    return a.eqNullSafe(b) | F.coalesce(_pairs(a, b, pairs), F.lit(False))


def failure_mode(subtype_ok: Column, doc_type_ok: Column, predicted: Column, equivalent_ok: Column, unknown: str = UNKNOWN) -> Column:
    """Why a row failed, or ``ok``; a missing flag counts as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(subtype_ok), "ok")
        .when(~yes(doc_type_ok), "function_over_form")
        .when(yes(predicted == unknown), "other_fallback")
        .when(yes(equivalent_ok), "equivalent_family")
        .otherwise("family_confusion")
    )


def docclass_failure(doc_type_ok: Column, subclass_ok: Column) -> Column:
    """A missing flag counts as true here."""
    return F.when(~F.coalesce(doc_type_ok, F.lit(True)), "doc_type_miss").when(~F.coalesce(subclass_ok, F.lit(True)), "subclass_miss").otherwise("ok")


def flag(value: Column) -> Column:
    """1 for texts that mean yes, else 0."""
    return F.lower(stripped(F.coalesce(value.cast("string"), F.lit("")))).isin("yes", "y", "true", "1", "1.0").cast("int")
