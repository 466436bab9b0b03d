"""Queries of the evaluation operators over the domain tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import labels, parse, text
from gaugeworks.functions.similarity import jaro_winkler_udf, seq_ratio_udf, token_set_ratio_udf
from gaugeworks.operators import catalog, classify, clauses, cost, diagnostics, export, failures, fields, runs, scorecard, stats
from gaugeworks.runtime import spread, table
from gaugeworks.taxonomy import CORPORATE_SUFFIXES, EQUIVALENT, NUMBER_WORDS, STOPWORDS, SUBTYPE_LABELS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# -- SQL fragments -----------------------------------------------------------------
_WS = r"[\s\x0B\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PUNCT = r"""[,.;:''"()\[\]{}!?@#$%^&*+=|\\/<>~`_\-]"""


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def q_words(x: str, case: str = "lower") -> str:
    return f"list_filter(string_split_regex(regexp_replace({case}(coalesce({x}, '')), '{_PUNCT}', ' ', 'g'), '{_WS}+'), lambda w: w <> '')"


def q_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def q_content(x: str) -> str:
    return f"list_distinct(list_filter({q_words(x)}, lambda w: NOT list_contains({q_list(STOPWORDS)}, w)))"


def q_normal(x: str) -> str:
    return f"array_to_string(list_filter({q_words(x, 'upper')}, lambda w: NOT list_contains({q_list(CORPORATE_SUFFIXES)}, w)), ' ')"


def q_subtype(x: str) -> str:
    key = f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"
    plain = [k for k in SUBTYPE_LABELS if "_" not in k]
    arms = " ".join(f"WHEN starts_with({key}, '{labels._squeezed(v)[:8]}') THEN '{k}'" for k, v in SUBTYPE_LABELS.items())
    return f"CASE WHEN {key} = '' THEN 'other' WHEN list_contains({q_list(plain)}, {key}) THEN {key} {arms} ELSE 'other' END"


def q_label(x: str) -> str:
    t = f"lower({q_strip(f"coalesce({x}, '')")})"
    told = f"CASE WHEN starts_with({t}, '{{') AND ends_with({t}, '}}') AND json_valid({t}) THEN nullif(json_extract_string({t}, '$.doc_type'), '') END"
    t = f"coalesce({told}, {t})"
    patterns = labels.class_patterns()
    arms = " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{c}'" for c, p in patterns.items())
    return f"CASE WHEN list_contains({q_list(list(patterns))}, {t}) THEN {t} {arms} ELSE regexp_replace({t}, '^[\"`*_ ]+|[\"`*_ ]+$', '', 'g') END"


def q_equal(a: str, b: str) -> str:
    return f"({a} = {b} OR " + " OR ".join(f"({a} = '{x}' AND {b} = '{y}') OR ({a} = '{y}' AND {b} = '{x}')" for x, y in EQUIVALENT) + ")"


Q_MODE = """CASE WHEN coalesce(subtype_ok, false) THEN 'ok' WHEN NOT coalesce(doc_type_ok, false) THEN 'function_over_form'
  WHEN coalesce(contract_subtype = 'other', false) THEN 'other_fallback' WHEN coalesce(subtype_ok_equiv, false) THEN 'equivalent_family' ELSE 'family_confusion' END"""
Q_ERROR = "coalesce(starts_with(contract_subtype, 'ERROR: '), false)"
PAIRS = "sorter_rows"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sorter_rows").withColumnsRenamed({"expected_subtype": "expected", "contract_subtype": "predicted"})


# -- labels ------------------------------------------------------------------------
@query(
    "label_accuracy",
    f"SELECT session, count(*) n, {big('count(*) FILTER (expected_subtype = contract_subtype)')} hits, count(*) FILTER (expected_subtype = contract_subtype) / count(*)::DOUBLE accuracy FROM {PAIRS} GROUP BY session",
)
def _(spark, base):
    return classify.accuracy(_pairs(spark, base), ["session"])


@query(
    "label_per_class",
    f"SELECT expected_subtype AS class, count(*) n, {big('count(*) FILTER (expected_subtype = contract_subtype)')} correct, count(*) FILTER (expected_subtype = contract_subtype) / count(*)::DOUBLE accuracy FROM {PAIRS} WHERE NOT {Q_ERROR} GROUP BY 1",
)
def _(spark, base):
    return classify.per_class(_pairs(spark, base), [])


@query(
    "label_macro",
    f"SELECT session, count(*) classes, round(avg(a), 9) macro_accuracy FROM (SELECT session, expected_subtype, count(*) FILTER (expected_subtype = contract_subtype) / count(*)::DOUBLE a FROM {PAIRS} WHERE NOT {Q_ERROR} GROUP BY 1, 2) GROUP BY session",
)
def _(spark, base):
    return classify.macro_accuracy(_pairs(spark, base), ["session"]).withColumn("macro_accuracy", F.round("macro_accuracy", 9))


_CELLS = f"SELECT {q_subtype('expected_subtype')} expected, {q_subtype('contract_subtype')} predicted, count(*) n FROM {PAIRS} GROUP BY 1, 2"


@query("failure_confusion", _CELLS)
def _(spark, base):
    return failures.confusion(table(spark, base, "sorter_rows"))


@query("label_confusion", f"SELECT expected_subtype AS expected, contract_subtype AS predicted, count(*) n FROM {PAIRS} WHERE NOT {Q_ERROR} GROUP BY 1, 2")
def _(spark, base):
    return classify.confusion(_pairs(spark, base), [])


@query("label_confusion_accuracy", f"SELECT {big('sum(n)')} n, sum(CASE WHEN expected = predicted THEN n ELSE 0 END) / sum(n)::DOUBLE accuracy FROM ({_CELLS})")
def _(spark, base):
    return classify.confusion_accuracy(failures.confusion(table(spark, base, "sorter_rows")), [])


@query("label_top_confusions", f"SELECT expected, predicted, n FROM ({_CELLS}) WHERE expected <> predicted ORDER BY n DESC, expected, predicted LIMIT 5")
def _(spark, base):
    return classify.top_confusions(failures.confusion(table(spark, base, "sorter_rows")), 5)


@query("label_confusion_dense")
def _(spark, base):
    return classify.dense_confusion(failures.confusion(table(spark, base, "sorter_rows")), [*SUBTYPE_LABELS, "other"])


@query("label_distribution", f"SELECT contract_subtype AS label, count(*) n FROM {PAIRS} GROUP BY 1")
def _(spark, base):
    return classify.distribution(_pairs(spark, base).withColumn("label", F.col("predicted")), "label")


@query(
    "label_binary",
    f"""SELECT session, n, tp, fp, fn, tn, p AS precision, r AS recall, (tp + tn) / (tp + fp + fn + tn)::DOUBLE accuracy,
      CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END f1, CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END f2
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0::DOUBLE END p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0::DOUBLE END r FROM (
      SELECT session, count(*) n, {big('count(*) FILTER (e = 1 AND p = 1)')} tp, {big('count(*) FILTER (e = 0 AND p = 1)')} fp,
        {big('count(*) FILTER (e = 1 AND p = 0)')} fn, {big('count(*) FILTER (e = 0 AND p = 0)')} tn
      FROM (SELECT session, coalesce(doc_type_ok, false)::INT e, coalesce(subtype_ok, false)::INT p FROM {PAIRS}) GROUP BY session))""",
)
def _(spark, base):
    rows = table(spark, base, "sorter_rows").withColumns({"expected": F.col("doc_type_ok"), "predicted": F.col("subtype_ok")})
    return classify.binary(rows, ["session"])


@query("label_normalize", f"SELECT row_id, {q_label('contract_subtype')} label FROM {PAIRS}")
def _(spark, base):
    return table(spark, base, "sorter_rows").select("row_id", labels.normalize_label(F.col("contract_subtype")).alias("label"))


@query("subtype_normalize", f"SELECT row_id, {q_subtype('contract_subtype')} subtype FROM {PAIRS}")
def _(spark, base):
    return table(spark, base, "sorter_rows").select("row_id", labels.normalize_subtype(F.col("contract_subtype")).alias("subtype"))


@query(
    "subtype_equivalence",
    f"SELECT session, count(*) n, {big(f'count(*) FILTER ({q_equal("e", "p")})')} equivalent FROM (SELECT session, {q_subtype('expected_subtype')} e, {q_subtype('contract_subtype')} p FROM {PAIRS}) GROUP BY session",
)
def _(spark, base):
    rows = table(spark, base, "sorter_rows").select("session", labels.normalize_subtype(F.col("expected_subtype")).alias("e"), labels.normalize_subtype(F.col("contract_subtype")).alias("p"))
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.count_if(labels.equivalent_subtypes(F.col("e"), F.col("p"))).alias("equivalent"))


@query("subclass_normalize")
def _(spark, base):
    return table(spark, base, "sorter_rows").select("row_id", labels.normalize_subclass(F.col("contract_subtype"), list(SUBTYPE_LABELS)).alias("subclass"))


@query("yes_no_task", f"SELECT row_id, CASE WHEN t IN ('y', 'yes', 'true', '1') THEN 'yes' WHEN t IN ('n', 'no', 'false', '0') THEN 'no' ELSE t END answer FROM (SELECT row_id, trim(regexp_replace(lower(coalesce(CAST(subtype_ok AS VARCHAR), '')), '[^a-z0-9]+', ' ', 'g')) t FROM {PAIRS})")
def _(spark, base):
    return table(spark, base, "sorter_rows").select("row_id", labels.normalize_yes_no(F.col("subtype_ok").cast("string")).alias("answer"))


@query(
    "task_scores",
    f"""SELECT e.session, e.n, e.exact_match, m.classes, round(m.macro_accuracy, 9) macro_accuracy FROM
      (SELECT session, count(*) n, count(*) FILTER (e = p) / count(*)::DOUBLE exact_match FROM (SELECT session, {q_subtype('expected_subtype')} e, {q_subtype('contract_subtype')} p FROM {PAIRS}) GROUP BY session) e
      JOIN (SELECT session, count(*) classes, avg(a) macro_accuracy FROM (SELECT session, e, count(*) FILTER (e = p) / count(*)::DOUBLE a FROM
        (SELECT session, {q_subtype('expected_subtype')} e, {q_subtype('contract_subtype')} p FROM {PAIRS}) GROUP BY 1, 2) GROUP BY session) m ON e.session = m.session""",
)
def _(spark, base):
    rows = _pairs(spark, base).where("session is not null")
    return classify.score_task(rows, "subtype", ["session"]).withColumn("macro_accuracy", F.round("macro_accuracy", 9))


@query("docclass_hierarchical")
def _(spark, base):
    rows = table(spark, base, "sorter_rows").withColumns({"de": F.lit("contract"), "dp": F.when(F.col("doc_type_ok"), "contract").otherwise("correspondence")})
    return classify.hierarchical(rows, ["session"], ("de", "dp"), ("expected_subtype", "contract_subtype"))


# -- failures ----------------------------------------------------------------------
@query("failure_classify", f"SELECT row_id, {Q_MODE} AS mode FROM {PAIRS}")
def _(spark, base):
    return failures.with_mode(table(spark, base, "sorter_rows")).select("row_id", "mode")


@query(
    "failure_summary",
    f"""SELECT session, count(*) n_total, {big("count(*) FILTER (m <> 'ok')")} n_failed, count(*) FILTER (m <> 'ok') / count(*)::DOUBLE rate,
      {big("count(*) FILTER (m = 'function_over_form')")} function_over_form, {big("count(*) FILTER (m = 'other_fallback')")} other_fallback,
      {big("count(*) FILTER (m = 'equivalent_family')")} equivalent_family, {big("count(*) FILTER (m = 'family_confusion')")} family_confusion
    FROM (SELECT session, {Q_MODE} m FROM {PAIRS}) GROUP BY session""",
)
def _(spark, base):
    return failures.summary(table(spark, base, "sorter_rows"), ["session"])


@query("failure_ledger", f"SELECT row_id, mode, expected_subtype, contract_subtype FROM (SELECT *, {Q_MODE} AS mode FROM {PAIRS}) WHERE mode <> 'ok'")
def _(spark, base):
    return failures.ledger(table(spark, base, "sorter_rows")).select("row_id", "mode", "expected_subtype", "contract_subtype")


@query(
    "failure_per_subtype",
    f"""SELECT {q_subtype('expected_subtype')} subtype, count(*) n, {big('count(*) FILTER (coalesce(subtype_ok, false))')} correct,
      {big('count(*) FILTER (coalesce(subtype_ok, false) OR coalesce(subtype_ok_equiv, false))')} correct_equiv, count(*) FILTER (coalesce(subtype_ok, false)) / count(*)::DOUBLE accuracy,
      count(*) FILTER (coalesce(subtype_ok, false) OR coalesce(subtype_ok_equiv, false)) / count(*)::DOUBLE accuracy_equiv FROM {PAIRS} GROUP BY 1""",
)
def _(spark, base):
    return failures.per_subtype(table(spark, base, "sorter_rows"))


# -- text --------------------------------------------------------------------------
_FIELDS = "extraction_fields"


@query("text_normalize", f"SELECT row_id, {q_normal('predicted')} normal, {big(f'len({q_words("predicted")})')} n_tokens FROM {_FIELDS}")
def _(spark, base):
    return table(spark, base, _FIELDS).select("row_id", text.normalized(F.col("predicted")).alias("normal"), F.size(text.tokens(F.col("predicted"))).cast("bigint").alias("n_tokens"))


@query(
    "token_f1",
    f"""SELECT row_id, CASE WHEN len(e) = 0 THEN CASE WHEN len(p) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN len(p) = 0 OR c = 0 THEN 0.0::DOUBLE
      ELSE round(2 * (c / len(p)::DOUBLE) * (c / len(e)::DOUBLE) / (c / len(p)::DOUBLE + c / len(e)::DOUBLE), 9) END f1
    FROM (SELECT *, coalesce(list_sum(list_transform(list_distinct(e), lambda w: least(len(list_filter(e, lambda x: x = w)), len(list_filter(p, lambda x: x = w))))), 0) c
      FROM (SELECT row_id, {q_words('predicted')} p, {q_words('expected')} e FROM {_FIELDS}))""",
)
def _(spark, base):
    return spread(table(spark, base, _FIELDS).select("row_id", "predicted", "expected"), "row_id").select("row_id", F.round(fields.free_text_score(F.col("predicted"), F.col("expected")), 9).alias("f1"))


@query(
    "containment",
    f"""SELECT row_id, CASE WHEN len(e) = 0 THEN CASE WHEN len(p) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN len(p) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(e, p)) / len(e)::DOUBLE END score
    FROM (SELECT row_id, {q_content('predicted')} p, {q_content('expected')} e FROM {_FIELDS})""",
)
def _(spark, base):
    return table(spark, base, _FIELDS).select("row_id", fields.containment_score(F.col("predicted"), F.col("expected")).alias("score"))


@query("id_match", f"SELECT row_id, ({q_normal('predicted')} = {q_normal('expected')})::INT::DOUBLE score FROM {_FIELDS}")
def _(spark, base):
    return table(spark, base, _FIELDS).select("row_id", fields.id_score(F.col("predicted"), F.col("expected")).alias("score"))


def _q_jwords(x: str) -> str:
    return f"string_split(replace(lower(regexp_replace({x}, '[.,;:]', '', 'g')), '/', ' '), ' ')"


@query(
    "token_jaccard",
    f"SELECT row_id, len(list_intersect(list_distinct(p), list_distinct(e))) / len(list_distinct(list_concat(p, e)))::DOUBLE jaccard FROM (SELECT row_id, {_q_jwords('predicted')} p, {_q_jwords('expected')} e FROM {_FIELDS} WHERE predicted IS NOT NULL AND expected IS NOT NULL)",
)
def _(spark, base):
    rows = table(spark, base, _FIELDS).where("predicted is not null and expected is not null")
    return rows.select("row_id", text.jaccard(F.col("predicted"), F.col("expected")).alias("jaccard"))


@query("clause_spans")
def _(spark, base):
    return table(spark, base, "documents").select("doc_id", text.clause_spans(F.array("text")).alias("spans"))


@query("similarity_pairs")
def _(spark, base):
    rows = table(spark, base, _FIELDS).where("predicted <> expected")
    p, e = F.col("predicted"), F.col("expected")
    return rows.select("row_id", seq_ratio_udf(p, e).alias("seq"), token_set_ratio_udf(p, e).alias("token_set"), jaro_winkler_udf(p, e).alias("jaro_winkler"))


@query("embedding_cosine", "SELECT vec_id, round(greatest(0, least(1, list_sum(list_transform(list_zip(a, b), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(a, lambda v: v::DOUBLE * v))) * sqrt(list_sum(list_transform(b, lambda v: v::DOUBLE * v)))))), 6) cosine FROM (SELECT x.vec_id, x.embedding a, y.embedding b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)")
def _(spark, base):
    rows = table(spark, base, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return rows.join(after, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


# -- dates, durations, money ----------------------------------------------------------
_NUMS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in NUMBER_WORDS.items()) + "}"


def q_duration(x: str) -> str:
    s = f"lower(regexp_replace({x}, '[,.]', ' ', 'g'))"
    p = parse.DURATION.replace("(?i)", "")
    last = lambda g: f"list_extract(regexp_extract_all({s}, '{p}', {g}, 'i'), -1)"
    n = f"CASE WHEN {last(2)} <> '' THEN TRY_CAST({last(2)} AS INT) WHEN regexp_full_match({last(1)}, '[0-9]+') THEN TRY_CAST({last(1)} AS INT) ELSE {_NUMS}[{last(1)}] END"
    return f"CASE WHEN regexp_matches({s}, '\\ban[n]?ual') THEN 365 ELSE ({n}) * (MAP {{'year': 365, 'month': 30, 'week': 7, 'day': 1}})[regexp_replace({last(3)}, 's$', '')] END"


@query("duration_parse", f"SELECT row_id, {q_duration('predicted')} AS days FROM {_FIELDS} WHERE field IN ('term_length', 'renewal_terms')")
def _(spark, base):
    rows = table(spark, base, _FIELDS).where(F.col("field").isin("term_length", "renewal_terms"))
    return rows.select("row_id", parse.parse_duration(F.col("predicted")).cast("int").alias("days"))


def q_money(x: str) -> str:
    s = f"regexp_replace(upper({q_strip(x)}), '[,$€£]', '', 'g')"
    f = f"CASE right({s}, 1) WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 WHEN 'B' THEN 1e9 ELSE 1e0 END"
    cut = f"CASE WHEN right({s}, 1) IN ('M', 'K', 'B') THEN rtrim(left({s}, len({s}) - 1)) ELSE {s} END"
    cut = f"trim(regexp_replace({cut}, ' (?:USD|DOLLARS|EUROS)$', ''))"
    return f"CASE WHEN regexp_full_match({cut}, '[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:E[+-]?\\d+)?') THEN TRY_CAST({cut} AS DOUBLE) * ({f}) END"


@query("money_parse", f"SELECT row_id, {q_money('predicted')} AS amount FROM {_FIELDS} WHERE field = 'contract_value'")
def _(spark, base):
    return table(spark, base, _FIELDS).where("field = 'contract_value'").select("row_id", parse.parse_money(F.col("predicted")).alias("amount"))


@query("money_match", f"SELECT row_id, (abs({q_money('predicted')} - {q_money('expected')}) <= 0.01)::INT::DOUBLE AS score FROM {_FIELDS} WHERE field = 'contract_value'")
def _(spark, base):
    return table(spark, base, _FIELDS).where("field = 'contract_value'").select("row_id", fields.money_score(F.col("predicted"), F.col("expected")).alias("score"))


@query("date_parse")
def _(spark, base):
    return table(spark, base, _FIELDS).where("field = 'effective_date'").select("row_id", parse.parse_date(F.col("predicted")).alias("day"))


@query("date_roundtrip", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(spark, base):
    day = F.col("o_orderdate")
    forms = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "d MMMM yyyy"), F.date_format(day, "M/d/yyyy"), F.concat(F.date_format(day, "d"), F.lit("th day of "), F.date_format(day, "MMMM, yyyy"))]
    pick = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return spread(table(spark, base, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", parse.parse_date(pick).alias("day"))


@query(
    "date_match",
    """SELECT o_orderkey, CASE WHEN s = 0 THEN 1.0::DOUBLE WHEN year(p) = year(e) AND month(p) = month(e) THEN 0.67::DOUBLE WHEN abs(s) <= 45 THEN 0.67::DOUBLE
      WHEN year(p) = year(e) OR month(p) = month(e) THEN 0.33::DOUBLE ELSE 0.0::DOUBLE END score
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) e, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 * 20 AS INT) p, CAST(o_orderkey % 7 * 20 AS INT) s FROM orders)""",
)
def _(spark, base):
    e = F.to_date("o_orderdate")
    p = F.date_add(e, (F.col("o_orderkey") % 7 * 20).cast("int"))
    return spread(table(spark, base, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", parse.date_score(F.date_format(p, "yyyy-MM-dd"), F.date_format(e, "MMMM d, yyyy")).alias("score"))


# -- fields ------------------------------------------------------------------------
_TYPES = {"effective_date": "date", "term_length": "containment", "renewal_terms": "containment", "document_name": "name", "governing_law": "containment", "contract_value": "money"}


def _typed(spark: SparkSession, base: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    return table(spark, base, _FIELDS).withColumn("field_type", F.try_element_at(kinds, F.col("field")))


@query("field_scores")
def _(spark, base):
    return fields.score_scalars(spread(_typed(spark, base).where("field <> 'parties'"), "row_id")).select("row_id", "field", "score")


@query("field_types_by_name", f"""SELECT DISTINCT field, CASE WHEN contains(lower(field), 'date') THEN 'date' WHEN regexp_matches(lower(field), 'value|amount|fee|compensation|price|cost|salary|consideration|total') THEN 'money'
    WHEN regexp_matches(lower(field), 'number|id|docket|reference|filing') THEN 'id' ELSE 'name' END field_type FROM {_FIELDS}""")
def _(spark, base):
    return table(spark, base, _FIELDS).select("field", fields.field_type(F.col("field"), F.lit(False)).alias("field_type")).distinct()


@query("name_fuzzy")
def _(spark, base):
    rows = table(spark, base, _FIELDS).where("field in ('document_name', 'parties')").withColumn("field_type", F.lit("name"))
    return fields.score_scalars(rows).select("row_id", "score")


def _items(c: str) -> Column:
    return F.when(F.col(c).isNull() | (text.stripped(F.col(c)) == ""), F.array().cast("array<string>")).otherwise(F.transform(F.split(c, r"\s*;\s*"), text.stripped))


@query("entity_list")
def _(spark, base):
    rows = table(spark, base, _FIELDS).where("field = 'parties'").select("row_id", _items("predicted").alias("p"), _items("expected").alias("e"))
    return fields.score_lists(rows, "p", "e", F.lit(False)).select("row_id", "list_score.*")


@query("entity_list_partial")
def _(spark, base):
    rows = table(spark, base, _FIELDS).where("field = 'parties'").select("row_id", _items("predicted").alias("p"), _items("expected").alias("e"))
    return fields.score_lists(rows, "p", "e", F.lit(True)).select("row_id", "list_score.*", fields.list_total(F.col("list_score"), F.lit(True)).alias("score"))


@query("extraction_score")
def _(spark, base):
    is_list = F.col("field") == "parties"
    rows = _typed(spark, base).withColumns({"pred_items": F.when(is_list, _items("predicted")), "exp_items": F.when(is_list, _items("expected"))})
    return fields.score_documents(rows, ["extraction_id"])


def _with_text(spark: SparkSession, base: str, how: str = "inner") -> DataFrame:
    """Fields with the text of their document and its content words, which are made once per
    document; in a left join, '' and none where there is no text."""
    docs = table(spark, base, "documents").where("text is not null").select("filename", "text")
    docs = spread(docs, "filename").withColumn("words", text.content_tokens(text.tokens(F.col("text"))))
    found = _typed(spark, base).join(docs, "filename", how)
    return found.withColumns({"text": F.coalesce("text", F.lit("")), "words": F.coalesce("words", F.array().cast("array<string>"))})


@query("scalar_audit")
def _(spark, base):
    rows = _with_text(spark, base, "left").where("field <> 'parties'").select("row_id", F.coalesce("field_type", F.lit("name")).alias("kind"), "predicted", "expected", "text", "words")
    return fields.audit_scalars(rows, "kind", "predicted", "expected", "text", doc_words="words").select("row_id", "matched_gt", "verified_in_doc", "hallucinated")


@query(
    "grounding_items",
    f"""SELECT row_id, len(i) > 0 AND len(d) > 0 AND len(list_intersect(i, d)) / greatest(len(i), 1)::DOUBLE >= 0.7 AS grounded
    FROM (SELECT row_id, {q_content('predicted')} i, {q_content('text')} d FROM {_FIELDS} JOIN documents USING (filename) WHERE text IS NOT NULL AND predicted IS NOT NULL)""",
)
def _(spark, base):
    rows = _with_text(spark, base).where("predicted is not null")
    return rows.select("row_id", fields.verify_items(F.array("predicted"), F.col("words"))[0].alias("grounded"))


@query("list_audit")
def _(spark, base):
    rows = _with_text(spark, base, "left").where("field = 'parties'").select("row_id", "words", _items("expected").alias("e"), F.explode_outer(_items("predicted")).alias("item"))
    one = fields.score_lists(rows.withColumn("p", F.array_compact(F.array("item"))), "p", "e", F.lit(False)).withColumn("hit_gt", F.col("list_score.matched") > 0)
    return fields.audit_totals(fields.audit_items(one, "words", "hit_gt"), ["row_id"])


@query("category_presence")
def _(spark, base):
    rows = _with_text(spark, base).where("expected is not null and field in ('governing_law', 'document_name')")
    return fields.category_presence(rows.withColumn("spans", text.clause_spans(F.array("text"))), ["field"], "expected", "spans")


# -- clauses -----------------------------------------------------------------------
_CLAUSES = """SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN [substr(text, 1, 40)] ELSE [] END spans, CASE WHEN doc_id % 5 = 0 THEN 'No related clause.' ELSE text END output FROM documents WHERE text IS NOT NULL"""


def _clauses(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents").where("text is not null")
    spans = F.when(F.col("doc_id") % 3 == 0, F.array(F.substring("text", 1, 40))).otherwise(F.array().cast("array<string>"))
    output = F.when(F.col("doc_id") % 5 == 0, "No related clause.").otherwise(F.col("text"))
    return clauses.clause_rows(rows.select("doc_id", "lang", spans.alias("spans"), output.alias("output")))


_BARE = "regexp_replace({0}, '^[ \\n`]+|[ \\n`]+$', '', 'g')"
_OUTCOMES = f"""SELECT *, contains(lower({_BARE.format('output')}), 'no related clause') none,
  CASE WHEN len(spans) > 0 THEN CASE WHEN contains({_BARE.format('output')}, {_BARE.format('spans[1]')}) THEN 'tp' ELSE 'fn' END
    WHEN contains(lower({_BARE.format('output')}), 'no related clause') THEN 'tn' ELSE 'fp' END o FROM ({_CLAUSES})"""
_RATES = """SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END f1, CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END f2 FROM
  (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0::DOUBLE END p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0::DOUBLE END r FROM ({0}))"""


def _clause_sql(group: str) -> str:
    head, tail = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    n = lambda o: big(f"count(*) FILTER (o = '{o}')")
    inner = f"SELECT {head}count(*) n_pairs, {n('tp')} tp, {n('tn')} tn, {n('fp')} fp, {n('fn')} fn, {big('count(*) FILTER (none)')} nr, {big("count(*) FILTER (none AND o IN ('tp', 'fn'))")} fnr FROM ({_OUTCOMES}){tail}"
    return f"SELECT {head}n_pairs, tp + fn AS n_positive, tp, tn, fp, fn, p AS precision, r AS recall, (tp + tn) / n_pairs::DOUBLE accuracy, f1, f2, nr / n_pairs::DOUBLE no_related_rate, CASE WHEN tp + fn > 0 THEN fnr / (tp + fn)::DOUBLE ELSE 0 END false_no_related_rate, fnr / 1244::DOUBLE false_no_related_rate_fixed FROM ({_RATES.format(inner)})"


@query("clause_metrics", _clause_sql(""))
def _(spark, base):
    return clauses.clause_metrics(_clauses(spark, base), []).drop("jaccard_mean")


@query("clause_per_category", _clause_sql("lang"))
def _(spark, base):
    return clauses.clause_metrics(_clauses(spark, base), ["lang"]).drop("jaccard_mean")


@query("clause_jaccard")
def _(spark, base):
    rows = _clauses(spark, base)
    mean = rows.groupBy("lang").agg(F.avg("jaccard").alias("jaccard_mean"))
    both = mean.join(clauses.upper_median(rows.where("lang is not null"), ["lang"], "jaccard"), "lang", "left")
    return both.withColumn("jaccard_mean", F.round("jaccard_mean", 9))


# -- diagnostics -------------------------------------------------------------------
@query(
    "diag_fields",
    f"SELECT field, count(*) n, {big('count(*) FILTER (field_score >= 1)')} exact, {big('count(*) FILTER (field_score <= 0)')} miss, {big('count(*) FILTER (field_score > 0 AND field_score < 1)')} partial, count(*) FILTER (field_score >= 1) / count(*)::DOUBLE exact_rate FROM {_FIELDS} WHERE field_score IS NOT NULL GROUP BY field",
)
def _(spark, base):
    return diagnostics.error_classes(table(spark, base, _FIELDS), ["field"])


@query("diag_presence", f"SELECT field, count(*) n, avg(coalesce(predicted <> '', false)::INT) presence FROM {_FIELDS} GROUP BY field")
def _(spark, base):
    return diagnostics.presence(table(spark, base, _FIELDS), ["field"])


def _q_errors(pairs: str, by: str) -> str:
    return f"SELECT {by}, count(*) n, round(avg(abs(p - e)), 6) mae, round(median(abs(p - e)), 6) median_ae, round(CASE WHEN count(*) >= 2 AND var_pop(e) > 0 THEN 1 - sum((p - e) * (p - e)) / (count(*) * var_pop(e)) END, 6) r2 FROM ({pairs}) WHERE p IS NOT NULL AND e IS NOT NULL GROUP BY {by}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mae", "median_ae", "r2")})


@query("diag_durations", _q_errors(f"SELECT field, ({q_duration('predicted')})::DOUBLE p, ({q_duration('expected')})::DOUBLE e FROM {_FIELDS} WHERE field IN ('term_length', 'renewal_terms')", "field"))
def _(spark, base):
    rows = table(spark, base, _FIELDS).where(F.col("field").isin("term_length", "renewal_terms"))
    return _rounded(diagnostics.errors(diagnostics.duration_pairs(rows), ["field"]))


@query("diag_money", _q_errors(f"SELECT field, {q_money('predicted')} p, {q_money('expected')} e FROM {_FIELDS} WHERE field = 'contract_value'", "field"))
def _(spark, base):
    return _rounded(diagnostics.errors(diagnostics.money_pairs(table(spark, base, _FIELDS).where("field = 'contract_value'")), ["field"]))


@query("diag_dates")
def _(spark, base):
    return _rounded(diagnostics.errors(diagnostics.date_pairs(table(spark, base, _FIELDS).where("field = 'effective_date'")), ["session"]))


@query("diag_r2", _q_errors("SELECT l_returnflag, l_quantity * 900 p, l_extendedprice e FROM lineitem", "l_returnflag"))
def _(spark, base):
    rows = table(spark, base, "lineitem").select("l_returnflag", (F.col("l_quantity") * 900).alias("p"), F.col("l_extendedprice").alias("e"))
    return _rounded(diagnostics.errors(rows, ["l_returnflag"]))


@query("diag_lists", f"SELECT session, count(*) n, round(avg(coalesce(list_score.precision, 0)), 9) AS precision, round(avg(coalesce(list_score.recall, 0)), 9) AS recall, round(avg(coalesce(list_score.f1, 0)), 9) AS f1 FROM {_FIELDS} WHERE list_score IS NOT NULL GROUP BY session")
def _(spark, base):
    return diagnostics.list_macro(table(spark, base, _FIELDS), ["session"]).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "diag_lists_micro",
    f"""SELECT matched, n_predicted, n_expected, matched / n_predicted::DOUBLE AS precision, matched / n_expected::DOUBLE AS recall,
      2 * (matched / n_predicted::DOUBLE) * (matched / n_expected::DOUBLE) / (matched / n_predicted::DOUBLE + matched / n_expected::DOUBLE) AS f1
    FROM (SELECT {big('sum(coalesce(list_score.matched, 0))')} matched, {big('sum(coalesce(list_score.n_predicted, 0))')} n_predicted, {big('sum(coalesce(list_score.n_expected, 0))')} n_expected FROM {_FIELDS} WHERE list_score IS NOT NULL)""",
)
def _(spark, base):
    return diagnostics.list_micro(table(spark, base, _FIELDS), [])


@query("diag_spans", f"SELECT session, count(*) n, avg(abs(coalesce(list_score.n_predicted, 0) - list_score.n_expected)) span_mae, avg(coalesce(list_score.n_predicted, 0) - list_score.n_expected) span_bias FROM {_FIELDS} WHERE list_score.n_expected IS NOT NULL GROUP BY session")
def _(spark, base):
    return diagnostics.span_drift(table(spark, base, _FIELDS), ["session"])


# -- runs --------------------------------------------------------------------------
_RUNS, _M = "eval_results", "subtype_accuracy"
_OK = f"{_M} IS NOT NULL AND NOT isnan({_M})"


def _runs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, _RUNS)


@query("run_best", f"SELECT result_id, {_M} FROM {_RUNS} WHERE {_OK} AND coalesce(sample_n, 0) >= 50 ORDER BY {_M} DESC, sample_n DESC NULLS LAST, result_id LIMIT 1")
def _(spark, base):
    return runs.best_run(_runs(spark, base), _M, "result_id", min_n=50).select("result_id", _M)


@query("run_runner_up", f"SELECT result_id, {_M} FROM {_RUNS} WHERE {_OK} ORDER BY {_M} DESC, sample_n DESC NULLS LAST, result_id LIMIT 1 OFFSET 1")
def _(spark, base):
    return runs.runner_up(_runs(spark, base), _M, "result_id").select("result_id", _M)


def _q_group(g: str) -> str:
    return f"SELECT coalesce({g}, '?') AS {g}, count(*) n_runs, round(avg({_M}), 9) AS mean, max({_M}) AS best, min({_M}) AS worst, max({_M}) - min({_M}) AS spread, arg_max(experiment_name, struct_pack(a := {_M}, b := -result_id)) best_run, arg_max(struct_pack(n := sample_n), struct_pack(a := {_M}, b := -result_id)).n best_n FROM {_RUNS} WHERE {_OK} GROUP BY 1"


@query("run_group_summary", _q_group("prompt_version"))
def _(spark, base):
    return runs.group_summary(_runs(spark, base), "prompt_version", _M, "result_id").withColumn("mean", F.round("mean", 9))


@query("run_model_summary", _q_group("model"))
def _(spark, base):
    return runs.group_summary(_runs(spark, base), "model", _M, "result_id").withColumn("mean", F.round("mean", 9))


_Q_WILSON = "((p + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n))", "(1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n)) / (1 + 3.8416e0 / n))"


@query(
    "run_trend_wilson",
    f"""SELECT result_id, round(CASE WHEN f THEN greatest(0, {_Q_WILSON[0]} - {_Q_WILSON[1]}) ELSE subtype_ci_lo END, 9) lo, round(CASE WHEN f THEN least(1, {_Q_WILSON[0]} + {_Q_WILSON[1]}) ELSE subtype_ci_hi END, 9) hi
    FROM (SELECT *, {_M} p, sample_n::DOUBLE n, coalesce((subtype_ci_lo IS NULL OR isnan(subtype_ci_lo) OR subtype_ci_hi IS NULL OR isnan(subtype_ci_hi)) AND sample_n >= 2, false) f FROM {_RUNS} WHERE {_OK})""",
)
def _(spark, base):
    rows = runs.trend(_runs(spark, base), _M, "subtype_ci_lo", "subtype_ci_hi")
    return rows.select("result_id", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query("run_regressions", f"SELECT result_id, prompt_version, previous, previous - {_M} AS delta FROM (SELECT *, lag({_M}) OVER (PARTITION BY prompt_version ORDER BY run_date NULLS LAST, result_id) previous FROM {_RUNS} WHERE {_OK} AND prompt_version IS NOT NULL) WHERE previous - {_M} >= 0.02")
def _(spark, base):
    rows = _runs(spark, base).select("result_id", "prompt_version", "run_date", _M)
    return runs.regressions(rows, _M, "prompt_version", "run_date", "result_id").select("result_id", "prompt_version", "previous", "delta")


@query(
    "run_failure_modes",
    f"""SELECT mode, n_total, n_runs, n_total / t.f::DOUBLE pct_of_failures, n_total / t.d::DOUBLE pct_of_docs FROM
      (SELECT mode, {big('sum(v)')} n_total, {big('count(*) FILTER (v > 0)')} n_runs FROM (SELECT 'failed' AS mode, rows_failed v FROM {_RUNS} UNION ALL SELECT 'misfiled', failures_n FROM {_RUNS}) WHERE v IS NOT NULL GROUP BY mode),
      (SELECT sum(failures_n) + sum(rows_failed) f, sum(sample_n) d FROM {_RUNS}) t""",
)
def _(spark, base):
    rows = _runs(spark, base)
    long = runs.wide_to_long(rows, ["result_id"], {"rows_failed": "failed", "failures_n": "misfiled"}, "mode", "v")
    totals = rows.agg((F.sum("failures_n") + F.sum("rows_failed")).alias("f"), F.sum("sample_n").alias("d"))
    return runs.failure_totals(long, "mode", "v", F.lit(None), F.lit(None)).drop("pct_of_failures", "pct_of_docs").crossJoin(F.broadcast(totals)).select(  # totals is one row
        "mode", "n_total", "n_runs", (F.col("n_total") / F.col("f")).alias("pct_of_failures"), (F.col("n_total") / F.col("d")).alias("pct_of_docs")
    )


_LONG = f"SELECT result_id, experiment_name, k, v FROM (SELECT result_id, experiment_name, 'subtype' k, subtype_accuracy v FROM {_RUNS} UNION ALL SELECT result_id, experiment_name, 'equivalent', subtype_accuracy_equiv FROM {_RUNS} UNION ALL SELECT result_id, experiment_name, 'doc_type', doc_type_accuracy FROM {_RUNS}) WHERE v IS NOT NULL AND NOT isnan(v)"
_KEYS = f"SELECT k AS key, round(avg(v), 9) AS mean, max(v) AS best, min(v) AS worst, max(v) - min(v) AS spread, arg_max(experiment_name, struct_pack(a := v, b := -result_id)) best_run FROM ({_LONG}) GROUP BY 1"


def _keys(spark: SparkSession, base: str) -> DataFrame:
    long = runs.wide_to_long(_runs(spark, base), ["result_id", "experiment_name"], {"subtype_accuracy": "subtype", "subtype_accuracy_equiv": "equivalent", "doc_type_accuracy": "doc_type"}, "key", "v")
    return runs.key_summary(long.where(~F.isnan("v")), "key", "v", "experiment_name", "result_id").withColumn("mean", F.round("mean", 9))


@query("run_subtype_summary", _KEYS)
def _(spark, base):
    return _keys(spark, base)


@query("run_hotspots", f"SELECT * FROM ({_KEYS}) ORDER BY mean, key LIMIT 2")
def _(spark, base):
    return runs.lowest(_keys(spark, base), "key", 2)


@query("run_confusion_drivers", f"SELECT mode, n FROM (SELECT {Q_MODE} AS mode, count(*) n FROM {PAIRS} GROUP BY 1) WHERE mode <> 'ok' ORDER BY n DESC, mode LIMIT 3")
def _(spark, base):
    modes = failures.ledger(table(spark, base, "sorter_rows")).groupBy("mode").agg(F.count("*").alias("n"))
    return runs.highest(modes, "n", "mode", 3)


@query("run_reliability", f"SELECT count(*) n_runs, median(sample_n) median_n, min(sample_n)::DOUBLE min_n, round(median(h), 9) median_ci_half, round(max(h), 9) max_ci_half, count(h) runs_with_ci, count(h) / count(*)::DOUBLE runs_with_ci_pct FROM (SELECT sample_n, (subtype_ci_hi - subtype_ci_lo) / 2 h FROM {_RUNS} WHERE {_OK})")
def _(spark, base):
    rows = runs.reliability(_runs(spark, base), _M, (F.col("subtype_ci_hi") - F.col("subtype_ci_lo")) / 2)
    return rows.withColumns({c: F.round(c, 9) for c in ("median_ci_half", "max_ci_half")})


_CHAMPION = f"SELECT prompt_version FROM {_RUNS} ORDER BY CASE WHEN {_M} IS NULL OR isnan({_M}) THEN 0 ELSE {_M} END DESC, coalesce(sample_n, 0) DESC, result_id LIMIT 1"


@query("run_champion", _CHAMPION)
def _(spark, base):
    return runs.champion_version(_runs(spark, base), "prompt_version", _M, "result_id")


@query("run_sweep", f"SELECT result_id, experiment_name, prompt_version FROM {_RUNS} WHERE prompt_version = ({_CHAMPION})")
def _(spark, base):
    return runs.sweep(_runs(spark, base), "prompt_version", _M, "result_id").select("result_id", "experiment_name", "prompt_version")


@query(
    "run_aggregate",
    f"""SELECT session, count(*) n_rows, round(avg(doc_type_ok::INT), 9) exact_match, round(avg(subtype_ok::INT), 9) subtype_accuracy, round(avg(subtype_ok_equiv::INT), 9) subtype_accuracy_equiv,
      round(avg(confidence), 9) confidence, {big('count(*) FILTER (NOT coalesce(subtype_ok, false))')} n_failed FROM {PAIRS} WHERE coalesce(session <> '', false) GROUP BY session""",
)
def _(spark, base):
    rows = runs.sessions(table(spark, base, "sorter_rows")).drop("first_at")
    return rows.withColumns({c: F.round(c, 9) for c in ("exact_match", "subtype_accuracy", "subtype_accuracy_equiv", "confidence")})


@query("name_parse")
def _(spark, base):
    return runs.with_name_parts(_runs(spark, base).select("result_id", "experiment_name"), "experiment_name")


@query("name_version", f"SELECT result_id, nullif(regexp_extract(coalesce(experiment_name, ''), '(?:sorter|contracts_specialist|legalbench_task)_(v?\\d+)', 1), '') AS version FROM {_RUNS}")
def _(spark, base):
    return runs.with_name_parts(_runs(spark, base), "experiment_name").select("result_id", "version")


@query("frame_normalize", f"SELECT result_id, CAST(run_date AS DATE) AS date, sample_n AS n, lower(experiment_name) experiment_key FROM {_RUNS}")
def _(spark, base):
    return runs.normalized_frame(_runs(spark, base)).select("result_id", "date", "n", "experiment_key")


@query("bootstrap_ci")
def _(spark, base):
    return stats.bootstrap(table(spark, base, "sorter_rows").where("session is not null"), "session", "confidence")


@query("delta_significance")
def _(spark, base):
    rows = table(spark, base, "sorter_rows").where("session is not null").withColumn("side", F.when(F.coalesce("subtype_ok", F.lit(False)), "right").otherwise("wrong"))
    return stats.bootstrap_difference(rows, "side", "wrong", "right", "session", "confidence")


# -- JSON, cost, catalog, scorecards ---------------------------------------------------
@query("json_dotted", "SELECT rec_id, json_extract_string(raw, '$.data_source.project') project, json_extract_string(raw, '$.task') task FROM experiment_log WHERE json_valid(raw)")
def _(spark, base):
    rows = table(spark, base, "experiment_log").where(F.try_parse_json("raw").isNotNull())
    return rows.select("rec_id", F.get_json_object("raw", "$.data_source.project").alias("project"), F.get_json_object("raw", "$.task").alias("task"))


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "cairn/cairn-s", 0.5, 1.0), (1, "cairn/", 1.0, 2.0), (2, "loam/", 3.0, 4.0)], "pos int, known string, per_m_in double, per_m_out double")


@query(
    "cost_estimate",
    f"""SELECT result_id, round(CASE WHEN model = 'cairn/cairn-s' OR starts_with(model, 'cairn/cairn-s') THEN t * 0.5e0 / 1e6 + c * 1e0 / 1e6 WHEN starts_with(model, 'cairn/') THEN t * 1e0 / 1e6 + c * 2e0 / 1e6
      WHEN starts_with(model, 'loam/') THEN t * 3e0 / 1e6 + c * 4e0 / 1e6 END, 9) cost FROM (SELECT result_id, model, coalesce(rows_completed, 0) t, coalesce(failures_n, 0) c FROM {_RUNS}) WHERE t + c > 0""",
)
def _(spark, base):
    rows = _runs(spark, base).select("result_id", "model", F.col("rows_completed").alias("prompt_tokens"), F.col("failures_n").alias("completion_tokens"))
    rows = rows.where("coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) > 0")
    return cost.with_cost(rows, _prices(spark)).select("result_id", F.round("cost_estimated_usd", 9).alias("cost"))


@query("cost_summary", f"SELECT model, {big('sum(coalesce(rows_completed, 0))')} prompt_tokens, {big('sum(coalesce(rows_failed, 0))')} completion_tokens, {big('sum(coalesce(sample_n, 0))')} total_tokens, round(coalesce(avg(cost_estimated_usd), 0), 9) cost_usd, round(coalesce(sum(cost_estimated_usd), 0), 6) cost_total_usd, count(*) rows_with_usage FROM {_RUNS} GROUP BY model")
def _(spark, base):
    rows = _runs(spark, base).select("model", F.col("rows_completed").alias("prompt_tokens"), F.col("rows_failed").alias("completion_tokens"), F.col("sample_n").alias("total_tokens"), F.col("cost_estimated_usd").alias("cost"))
    return cost.tokens_summary(rows, ["model"]).withColumns({"cost_usd": F.round("cost_usd", 9), "cost_total_usd": F.round("cost_total_usd", 6)})


@query("registry_filter", "SELECT name, tier FROM metric_defs WHERE tier <= 1 AND (list_contains(agents, 'ALL') OR list_contains(agents, 'sorter'))")
def _(spark, base):
    return scorecard.metrics_for(table(spark, base, "metric_defs"), max_tier=1, agent="sorter").select("name", "tier")


_BUNDLE = {"review": {"metrics": ["family_hit", "span_cover", "grounding", "reply_ms"], "agents": {"auditor": ["clause_agree", "grounding"]}}}


@query("bundle_metrics", "SELECT * FROM (VALUES ('family_hit', 0), ('span_cover', 1), ('grounding', 2), ('reply_ms', 3), ('clause_agree', 10000)) t(metric, pos)")
def _(spark, base):
    return catalog.bundle_metrics(catalog.bundles(spark, _BUNDLE), "review", "auditor")


@query("dashboard_metrics", "SELECT b.metric, b.pos, m.tier FROM (VALUES ('family_hit', 0), ('span_cover', 1), ('grounding', 2), ('reply_ms', 3), ('clause_agree', 10000)) b(metric, pos) JOIN metric_defs m ON m.name = b.metric WHERE m.tier <= 1")
def _(spark, base):
    return catalog.dashboard(catalog.bundles(spark, _BUNDLE), table(spark, base, "metric_defs"), "review", "auditor")


@query("prune_records", "SELECT seq, metric FROM score_records s WHERE EXISTS (SELECT 1 FROM metric_defs m WHERE m.name = s.metric AND m.tier <= 1)")
def _(spark, base):
    return scorecard.pruned(table(spark, base, "score_records"), table(spark, base, "metric_defs")).select("seq", "metric")


@query("unknown_metrics", "SELECT seq, metric FROM score_records s WHERE NOT EXISTS (SELECT 1 FROM metric_defs m WHERE m.name = s.metric)")
def _(spark, base):
    return scorecard.unknown_metrics(table(spark, base, "score_records"), table(spark, base, "metric_defs")).select("seq", "metric")


_CARD = """SELECT {0} agent, metric, count(*) n, round(CASE WHEN any_value(aggregation) = 'sum' THEN sum(value_num) WHEN any_value(aggregation) <> 'none' AND avg(value_num) IS NOT NULL THEN avg(value_num)
    WHEN any_value(aggregation) <> 'sum' THEN arg_max(struct_pack(v := value_num), seq).v END, 6) value_num,
  CASE WHEN any_value(aggregation) = 'none' OR (any_value(aggregation) <> 'sum' AND avg(value_num) IS NULL) THEN arg_max(struct_pack(v := value_str), seq).v END value_str
FROM score_records s JOIN metric_defs m ON m.name = s.metric WHERE (list_contains(m.agents, 'ALL') OR list_contains(m.agents, s.agent)) AND m.tier <= {1} GROUP BY {0} agent, metric"""


@query("scorecard", _CARD.format("run_id,", 3))
def _(spark, base):
    return scorecard.scorecard(table(spark, base, "score_records"), table(spark, base, "metric_defs"), ["run_id"]).withColumn("value_num", F.round("value_num", 6))


@query(
    "headline_compare",
    f"SELECT coalesce(x.metric, y.metric) metric, x.value_num a, y.value_num b, round(y.value_num - x.value_num, 6) delta_b_minus_a FROM (SELECT * FROM ({_CARD.format('', 0)}) WHERE agent = 'sorter') x FULL OUTER JOIN (SELECT * FROM ({_CARD.format('', 0)}) WHERE agent = 'auditor') y ON x.metric = y.metric",
)
def _(spark, base):
    card = scorecard.scorecard(table(spark, base, "score_records"), table(spark, base, "metric_defs"), [], 0).withColumn("value_num", F.round("value_num", 6))
    found = scorecard.compare_headlines(card.where("agent = 'sorter'"), card.where("agent = 'auditor'"))
    return found.withColumn("delta_b_minus_a", F.round("delta_b_minus_a", 6))


@query("chained_composite", f"SELECT session, round(0.25e0 * avg(subtype_ok::INT) + 0.75e0 * avg(confidence), 9) composite FROM {PAIRS} GROUP BY session")
def _(spark, base):
    rows = table(spark, base, "sorter_rows").groupBy("session").agg(F.avg(F.col("subtype_ok").cast("double")).alias("s"), F.avg("confidence").alias("e"))
    return rows.select("session", F.round(fields.chained_composite(F.col("s"), F.col("e")), 9).alias("composite"))



@query("export_sorter")
def _(spark, base):
    return export.export_frame(table(spark, base, "experiment_log"), "raw", export.sorter_columns(), ["rec_id"])


@query("export_extraction")
def _(spark, base):
    return export.export_frame(table(spark, base, "experiment_log"), "raw", export.extraction_columns(), ["rec_id"])


@query(
    "export_sorter_core",
    """SELECT rec_id, json_extract_string(raw, '$.experiment_name') "Experiment Name", TRY_CAST(json_extract_string(raw, '$.n_rows') AS BIGINT) "SAMPLE (n)",
      TRY_CAST(json_extract_string(raw, '$.scores.sorter.subtype_accuracy') AS DOUBLE) "Subtype Accuracy" FROM experiment_log WHERE json_valid(raw)""",
)
def _(spark, base):
    wanted = [c for c in export.sorter_columns() if c[0] in ("Experiment Name", "SAMPLE (n)", "Subtype Accuracy")]
    return export.export_frame(table(spark, base, "experiment_log"), "raw", wanted, ["rec_id"])


@query("chart_metric_ci")
def _(spark, base):
    return runs.chart_frames(_runs(spark, base), _M, "subtype_ci_lo", "subtype_ci_hi", "result_id")["metric_ci"].drop("run_date")


@query("chart_cost", f"SELECT experiment_name, cost_estimated_usd, {_M} FROM {_RUNS} WHERE {_OK} AND cost_estimated_usd > 0")
def _(spark, base):
    return runs.chart_frames(_runs(spark, base), _M, "subtype_ci_lo", "subtype_ci_hi", "result_id")["cost"]
