"""Scores of extracted fields, their audits against the source text, and documents' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.parse import date_grounded, date_score, no_real_date, parse_date, parse_money, prose_date
from gaugeworks.functions.similarity import list_score_udf, name_score_udf
from gaugeworks.functions.text import containment, content_tokens, let, normalized, rescued, stripped, token_f1, tokens
from gaugeworks.operators.classify import ratio
from gaugeworks.settings import Settings
from gaugeworks.taxonomy import ID_HINTS, MONEY_HINTS

LIST = "entity_list"


def field_type(name: Column, is_list: Column) -> Column:
    """The type that a field's name suggests."""
    low = F.lower(name)
    hint = lambda words: low.rlike("|".join(words))
    return F.when(is_list, LIST).when(low.contains("date"), "date").when(hint(MONEY_HINTS), "money").when(hint(ID_HINTS), "id").otherwise("name")


def id_score(pred: Column, exp: Column) -> Column:
    p, e = normalized(pred), normalized(exp)
    return (p == e).cast("double")


def money_score(pred: Column, exp: Column) -> Column:
    """1 within a cent, 0 beyond; null where either isn't an amount."""
    return (F.abs(parse_money(pred) - parse_money(exp)) <= 0.01).cast("double")


def free_text_score(pred: Column, exp: Column) -> Column:
    return token_f1(tokens(pred), tokens(exp))


def containment_score(pred: Column, exp: Column) -> Column:
    return containment(content_tokens(tokens(pred)), content_tokens(tokens(exp)))


def sure_name_score(pred: Column, exp: Column) -> Column:
    """The cases of a name that need no similarity: null is left for those that do.

    Words of either side within the other's score 1 (the similarity has its maximum then).
    """

    def words(p: Column, e: Column, wp: Column, we: Column) -> Column:
        within = (F.size(F.array_except(we, wp)) == 0) | (F.size(F.array_except(wp, we)) == 0)
        return F.when((p == "") | (e == ""), (p == e).cast("double")).when(within, 1.0)

    return let(normalized(pred), lambda p: let(normalized(exp), lambda e: let(tokens(p), lambda wp: let(tokens(e), lambda we: words(p, e, wp, we)))))


def native_score(kind: Column, pred: Column, exp: Column) -> Column:
    """Score of a scalar field as far as native rules go; null where similarity is due."""
    return (
        F.when(kind == "id", id_score(pred, exp))
        .when(kind == "money", F.coalesce(money_score(pred, exp), sure_name_score(pred, exp)))
        .when(kind == "date", F.coalesce(date_score(pred, exp), sure_name_score(pred, exp)))
        .when(kind == "free_text", free_text_score(pred, exp))
        .when(kind == "containment", containment_score(pred, exp))
        .otherwise(sure_name_score(pred, exp))
    )


def score_scalars(
    df: DataFrame, kind: str = "field_type", pred: str = "predicted", exp: str = "expected", out: str = "score", similarity: str | None = None, settings: Settings = Settings()
) -> DataFrame:
    """``df`` with the score of each scalar field, in one pass over its rows.

    Values of rows that native rules settle never meet Python: the Arrow UDF gets nulls for
    them, which it passes over. Null counts as empty text. ``similarity`` names a column with
    the embedding similarity of the two texts: it lifts the scores of names and free texts
    that are below the settings' limit, where neither text is blank.
    """
    known = df.withColumn("__native", native_score(F.col(kind), F.col(pred), F.col(exp)))
    due = lambda c: F.when(F.col("__native").isNull(), F.coalesce(c, F.lit("")))
    score = F.coalesce("__native", name_score_udf(due(pred), due(exp)))
    if similarity is not None:
        blank = (stripped(F.coalesce(pred, F.lit(""))) == "") | (stripped(F.coalesce(exp, F.lit(""))) == "")
        near = F.when(~blank & ~F.col(kind).isin("id", "money", "date", "containment"), F.col(similarity))
        score = rescued(score, near, settings.rescue_below)
    return known.withColumn(out, score).drop("__native")


def score_lists(df: DataFrame, pred: str, exp: str, partial: Column, kind: str = "name", settings: Settings = Settings(), out: str = "list_score") -> DataFrame:
    """``df`` with precision, recall, F1 and counts of each predicted list."""
    return df.withColumn(out, list_score_udf(kind, settings.match, settings.coverage)(F.col(pred), F.col(exp), partial))


def list_total(score: Column, partial: Column) -> Column:
    """Recall where labels are partial, else F1."""
    return F.when(partial, score["recall"]).otherwise(score["f1"])


def score_documents(fields: DataFrame, doc: list[str], settings: Settings = Settings(), element: str = "name") -> DataFrame:
    """Scores of whole documents from fields in long form.

    ``fields`` has the columns of ``doc``, field, field_type (null: by name), predicted and
    expected, and optionally pred_items and exp_items for lists (of ``element`` kind). Fields
    whose expected value is null or '' don't count; an empty list counts. Result: doc,
    field_scores (map), overall_score, ambiguous_fields, needs_review. If there is a column
    text with the document's text, every field that the model filled is audited against it
    and the label, those without an expected value too: audits (map of counts and
    rates by field) and overall_verified_precision, the mean over the audited fields, both
    null where there is no text.
    """
    has_lists = {"pred_items", "exp_items"} <= set(fields.columns)
    is_list = F.col("exp_items").isNotNull() if has_lists else F.lit(False)
    rows = fields.withColumn("__list", is_list).where(F.col("__list") | (F.col("expected").isNotNull() & (F.col("expected") != "")))
    kind = F.coalesce("field_type", field_type(F.col("field"), F.col("__list")))
    widened = F.when(F.col("field").isin(*settings.containment) & kind.isin("name", "free_text", "containment"), "containment").otherwise(kind)
    rows = rows.withColumns({"__kind": widened, "__partial": F.col("field").isin(*settings.partial_gt)})
    scalars = rows.where(~F.col("__list"))
    null_date = (F.col("__kind") == "date") & parse_date(F.col("expected")).isNull() & no_real_date(F.col("expected"))
    missing = scalars.where(F.col("predicted").isNull()).withColumn("score", F.when(null_date, 1.0).otherwise(0.0))
    given = score_scalars(scalars.where(F.col("predicted").isNotNull()), "__kind")
    scored = missing.select(*doc, "field", "score").unionByName(given.select(*doc, "field", "score"))
    if has_lists:
        lists = rows.where("__list")
        listed = score_lists(lists, "pred_items", "exp_items", F.col("__partial"), element, settings)
        scored = scored.unionByName(listed.select(*doc, "field", list_total(F.col("list_score"), F.col("__partial")).alias("score")))
    scored = scored.withColumn("score", F.round("score", 4))
    low, high = settings.band
    one = scored.groupBy(*doc, "field").agg(F.max("score").alias("score"))
    totals = (
        one.groupBy(*doc)
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "score")))).alias("field_scores"),
            F.avg("score").alias("overall_score"),
            F.array_sort(F.collect_list(F.when(F.col("score").between(low, high), F.col("field")))).alias("ambiguous_fields"),
        )
        .withColumn("needs_review", F.size("ambiguous_fields") > 0)
    )
    if "text" not in fields.columns or not settings.verify:
        return totals
    return totals.join(audited_documents(fields, doc, settings, element), doc, "left")


def audited_documents(fields: DataFrame, doc: list[str], settings: Settings = Settings(), element: str = "name") -> DataFrame:
    """(doc, audits, overall_verified_precision) of the fields that the model filled, for
    documents with a text; columns as for :func:`score_documents`, and optionally words, the
    content words of the text, made once per document.

    A value or an item is true if it matches a label or stands in the text. Of a field that
    occurs twice in a document the counts are added up.
    """
    rows = fields.where(F.coalesce(F.col("text") != "", F.lit(False)))
    if "words" not in fields.columns:
        rows = rows.withColumn("words", content_tokens(tokens(F.col("text"))))
    has_lists = {"pred_items", "exp_items"} <= set(fields.columns)
    is_list = F.coalesce(F.col("pred_items").isNotNull() | F.col("exp_items").isNotNull(), F.lit(False)) if has_lists else F.lit(False)
    rows = rows.withColumn("__list", is_list).withColumn("__kind", F.coalesce("field_type", field_type(F.col("field"), F.col("__list"))))
    scalars = audit_scalars(rows.where(~F.col("__list") & (stripped(F.coalesce("predicted", F.lit(""))) != "")), "__kind", "predicted", "expected", "text", settings, "words")
    true_ = F.greatest("matched_gt", "verified_in_doc")
    counts = scalars.select(*doc, "field", F.lit(1).alias("n_predicted"), "matched_gt", "verified_in_doc", true_.alias("true_items"))
    if has_lists:
        items = rows.where("__list").select(*doc, "field", F.col("words").alias("__words"), F.coalesce("exp_items", F.array().cast("array<string>")).alias("__e"), F.explode("pred_items").alias("item"))
        hit = score_lists(items.withColumn("__p", F.array(F.coalesce("item", F.lit("")))), "__p", "__e", F.lit(False), element, settings)
        hit = hit.withColumn("hit_gt", F.col("list_score.matched") > 0)
        one = audit_items(hit, "__words", "hit_gt", settings).select(
            *doc, "field", F.lit(1).alias("n_predicted"), F.col("hit_gt").cast("int").alias("matched_gt"), F.col("in_doc").cast("int").alias("verified_in_doc"), F.col("true_item").cast("int").alias("true_items")
        )
        counts = counts.unionByName(one)
    n = F.col("n_predicted")
    sums = counts.groupBy(*doc, "field").agg(*[F.sum(c).alias(c) for c in ("n_predicted", "matched_gt", "verified_in_doc", "true_items")])
    sums = sums.withColumn("verified_precision", F.round(F.col("true_items") / n, 4)).withColumns(
        {"hallucinated": n - F.col("true_items"), "hallucination_rate": F.round((n - F.col("true_items")) / n, 4)}
    )
    audit = F.struct("n_predicted", "matched_gt", "verified_in_doc", "true_items", "verified_precision", "hallucinated", "hallucination_rate")
    return sums.groupBy(*doc).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", audit.alias("audit"))))).alias("audits"),
        F.round(F.avg("verified_precision"), 4).alias("overall_verified_precision"),
    )


def grounded(words: Column, doc_words: Column, coverage: float) -> Column:
    """At least ``coverage`` of an item's content words stand in the document."""

    def of(w: Column, d: Column) -> Column:
        share = F.size(F.array_intersect(w, d)) / F.size(w)
        return F.when((F.size(w) > 0) & (F.size(d) > 0), share >= coverage).otherwise(False)

    return let(words, lambda w: let(doc_words, lambda d: of(w, d)))


def verify_items(items: Column, doc_words: Column, coverage: float = 0.7) -> Column:
    """A flag for each item: its content stands in the document. ``doc_words`` are the content
    words of the text, made once per document."""
    return let(doc_words, lambda d: F.transform(items, lambda i: grounded(content_tokens(tokens(i)), d, coverage)))


def audit_scalars(df: DataFrame, kind: str, pred: str, exp: str, doc: str, settings: Settings = Settings(), doc_words: str | None = None) -> DataFrame:
    """``df`` with matched_gt, verified_in_doc and hallucinated of each populated field.
    ``doc_words`` names a column with the content words of the text, if they were made once
    per document.

    A value is true if it matches the label or stands in the document. Fields that the
    model left null or blank aren't audited (all three are 0).
    """
    scored = score_scalars(df, kind, pred, exp, "__score")
    given = stripped(F.coalesce(pred, F.lit(""))) != ""
    words = content_tokens(tokens(F.when(F.col(kind) == "date", prose_date(F.col(pred))).otherwise(F.col(pred))))
    in_text = grounded(words, F.col(doc_words) if doc_words else content_tokens(tokens(F.col(doc))), settings.coverage)
    found = F.when(F.col(kind) == "date", date_grounded(parse_date(F.col(pred)), F.col(doc))).otherwise(in_text)
    match = F.coalesce((F.col(exp) != "") & (F.col("__score") >= settings.match), F.lit(False))
    step = scored.withColumns({"matched_gt": (given & match).cast("int"), "verified_in_doc": (given & found).cast("int")})
    return step.withColumn("hallucinated", (given & (F.col("matched_gt") + F.col("verified_in_doc") == 0)).cast("int")).drop("__score")


def audit_items(items: DataFrame, doc_words: str, has_match: str, settings: Settings = Settings(), item: str = "item") -> DataFrame:
    """``items`` (one row per predicted item) with in_doc and true_item; ``has_match`` tells
    whether a label matches it."""
    in_doc = grounded(content_tokens(tokens(F.col(item))), F.col(doc_words), settings.coverage)
    return items.withColumn("in_doc", in_doc).withColumn("true_item", F.col("in_doc") | F.col(has_match))


def audit_totals(items: DataFrame, by: list[str], has_match: str = "hit_gt", item: str = "item") -> DataFrame:
    """Counts and rates of audited items per group; a null item stands for none, and a group
    without items has counts and rates of 0."""
    items = items.withColumns({c: F.col(item).isNotNull() & F.col(c) for c in (has_match, "in_doc", "true_item")})
    n = F.count(item)
    true_ = F.count_if("true_item")
    return items.groupBy(*by).agg(
        n.alias("n_predicted"), F.count_if(has_match).alias("matched_gt"), F.count_if("in_doc").alias("verified_in_doc"),
        true_.alias("true_items"), (n - true_).alias("hallucinated"), ratio(true_, n).alias("verified_precision"), ratio(n - true_, n).alias("hallucination_rate"),
    )


def category_presence(df: DataFrame, by: list[str], answer: str, candidates: str, settings: Settings = Settings(), similarities: str | None = None) -> DataFrame:
    """Share of expected categories whose clause is covered by a candidate span, or near one
    by ``similarities``, a column with the embedding similarity of each candidate.

    ``df`` has one row per expected category; groups without any are absent (their score is 1
    by definition of the caller)."""
    hit = F.exists(F.col(candidates), lambda c: (c != "") & (containment_score(c, F.col(answer)) >= settings.coverage))
    if similarities is not None:
        hit = hit | F.coalesce(F.array_max(similarities) >= settings.presence, F.lit(False))
    rows = df.withColumn("matched", F.coalesce(hit, F.lit(False)) & (F.col(answer) != ""))
    return rows.groupBy(*by).agg(F.count("*").alias("n_expected"), F.count_if("matched").alias("n_matched"), (F.count_if("matched") / F.count("*")).alias("score"))


#: Weights of the sorter and of the extractor in the score of a chained run.
CHAIN = (0.25, 0.75)


def chained_composite(sorter: Column, extractor: Column, weights: tuple[float, float] = CHAIN) -> Column:
    """The weighted score of a chained run, by default a quarter the sorter's."""
    return weights[0] * sorter + weights[1] * extractor


def chained_summary(exact: Column, subtype: Column, overall: Column, presence: Column, n: Column, weights: tuple[float, float] = CHAIN, digits: int = 4) -> Column:
    """struct<sorter, extractor, composite, weights, n> of a chained run."""
    r = lambda c: F.round(c, digits)
    return F.struct(
        F.struct(r(exact).alias("exact_match"), r(subtype).alias("subtype_accuracy")).alias("sorter"),
        F.struct(r(overall).alias("overall_extraction_score"), r(presence).alias("field_presence")).alias("extractor"),
        r(chained_composite(exact, overall, weights)).alias("composite"),
        F.struct(F.lit(weights[0]).alias("sorter"), F.lit(weights[1]).alias("extractor")).alias("weights"),
        n.alias("n"),
    )
