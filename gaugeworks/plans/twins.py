"""Further queries of the evaluation operators with SQL twins, and twins of queries in
:mod:`gaugeworks.plans.reference`. They add to its registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import labels, parse, text
from gaugeworks.functions.similarity import jaro_winkler_udf
from gaugeworks.operators import classify, clauses, export, failures, fields, runs, scorecard
from gaugeworks.plans.reference import (
    _CELLS,
    _CLAUSES,
    _FIELDS,
    _M,
    _OK,
    _Q_WILSON,
    _RUNS,
    PAIRS,
    QUERIES,
    SQL,
    Q_ERROR,
    Q_MODE,
    _items,
    _pairs,
    _q_errors,
    _q_jwords,
    big,
    q_content,
    q_list,
    q_normal,
    q_strip,
    q_subtype,
    q_words,
    query,
)
from gaugeworks.operators.quantiles import medians
from gaugeworks.runtime import spread, table
from gaugeworks.settings import Settings
from gaugeworks.taxonomy import (
    CONSIDERATION_ALIASES,
    CONSIDERATIONS,
    EQUIVALENT_SUBCLASSES,
    FAILURE_MODES,
    MONTHS,
    ROLE_WORDS,
    SUBTYPE_LABELS,
)

__all__ = ["QUERIES", "SQL"]


# -- SQL fragments -----------------------------------------------------------------
def q_let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def q_fold(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def q_consideration(x: str) -> str:
    aliases = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CONSIDERATION_ALIASES.items()) + "}"
    t = q_fold(x)
    return f"coalesce(({aliases})[{t}], CASE WHEN list_contains({q_list(CONSIDERATIONS)}, replace({t}, ' ', '_')) THEN replace({t}, ' ', '_') END, 'other')"


def q_subclass(x: str) -> str:
    raw, key = q_strip(x), f"regexp_replace(lower({q_strip(x)}), '[^a-z0-9]', '', 'g')"
    arms = " ".join(f"WHEN {key} = '{labels._squeezed(c)}' THEN '{c}'" for c in SUBTYPE_LABELS)
    return f"CASE WHEN {x} IS NULL OR {key} = '' THEN 'other' WHEN list_contains({q_list(list(SUBTYPE_LABELS))}, {raw}) THEN {raw} {arms} ELSE 'other' END"


_SHORT = "[" + ", ".join(f"'{m[:3]}'" for m in MONTHS) + "]"
_LONG = q_list(MONTHS)


def _q_day(x: str) -> str:
    """The date of a text that is taken apart already: ``year|month|day``."""
    name = f"CASE WHEN starts_with({_LONG}[list_position({_SHORT}, lower(left(a[2], 3)))], lower(a[2])) OR lower(a[2]) = 'sept' THEN list_position({_SHORT}, lower(left(a[2], 3))) END"
    first, day, year = "TRY_CAST(ltrim(a[2], '?') AS INT)", "TRY_CAST(a[3] AS INT)", "TRY_CAST(a[1] AS INT)"
    swapped = f"(starts_with(a[2], '?') AND {first} > 12)"
    y = f"CASE WHEN len(a[1]) > 2 THEN {year} WHEN {year} <= 68 THEN {year} + 2000 ELSE {year} + 1900 END"
    m = f"CASE WHEN {swapped} THEN {day} WHEN {first} IS NOT NULL THEN {first} ELSE {name} END"
    d = f"CASE WHEN {swapped} THEN {first} ELSE {day} END"
    made = f"TRY_CAST(printf('%04d-%02d-%02d', CAST({y} AS INT), CAST({m} AS INT), CAST({d} AS INT)) AS DATE)"
    return q_let(f"string_split({x}, '|')", "a", made)


def q_date(x: str) -> str:
    s = f"regexp_replace({q_strip(x)}, '[\\s\\x0B\\x{{0085}}\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g')"
    s = f"regexp_replace({s}, '(\\d)(st|nd|rd|th)\\b', '\\1', 'gi')"
    s = f"regexp_replace({s}, '\\b(\\d{{1,2}})[a-z]*(?:\\s+[a-z]+)*\\s+day\\s+of\\b', '\\1 day of', 'gi')"
    s = f"trim(regexp_replace({s}, '[(\\[{{,]+$', ''))"
    arms = []
    for pattern, order in parse._WRITINGS:
        plain = pattern.replace("(?is)", "").replace("(?i)", "")
        arms.append(f"WHEN regexp_matches(s, '{plain}', 'is') THEN regexp_replace(s, '{plain}', '{order.replace('$', chr(92))}', 'is')")
    return q_let(s, "s", _q_day(f"CASE {' '.join(arms)} END"))


_MONTH_WORDS = "|".join(MONTHS)


def q_no_real_date(x: str) -> str:
    return f"(contains({x}, '_') OR contains(lower({x}), 'blank') OR (NOT regexp_matches(lower({x}), '{_MONTH_WORDS}') AND NOT regexp_matches(lower({x}), '\\b(19|20)\\d{{2}}\\b')))"


def q_within(container: str, target: str, date: str) -> str:
    """Of two folded texts and the target's date."""
    explicit = f"(regexp_matches({target}, ' (?:{_MONTH_WORDS})') OR regexp_matches({target}, '\\b\\d{{4}}-\\d{{1,2}}\\b'))"
    month, day, year = f"lower(strftime({date}, '%B'))", f"CAST(day({date}) AS VARCHAR)", f"strftime({date}, '%Y')"
    forms = [f"strftime({date}, '%Y %m %d')", f"{month} || ' ' || {day} || ' ' || {year}", f"{day} || ' ' || {month} || ' ' || {year}"]
    other = " OR ".join(f"contains({container}, {f})" for f in forms)
    return f"coalesce({container} <> '' AND {target} <> '' AND ((contains({container}, {target}) AND (len(string_split({target}, ' ')) >= 3 OR {explicit})) OR ({date} IS NOT NULL AND ({other}))), false)"


def q_sure_name(p: str, e: str) -> str:
    words = lambda x: q_words(x)
    inside = f"len(list_filter({words('b')}, lambda w: NOT list_contains({words('a')}, w))) = 0 OR len(list_filter({words('a')}, lambda w: NOT list_contains({words('b')}, w))) = 0"
    body = f"CASE WHEN a = '' OR b = '' THEN (a = b)::INT::DOUBLE WHEN {inside} THEN 1::DOUBLE END"
    return q_let(q_normal(p), "a", q_let(q_normal(e), "b", body))


def q_containment(p: str, e: str) -> str:
    body = "CASE WHEN len(ce) = 0 OR len(cp) = 0 THEN (len(ce) = len(cp))::INT::DOUBLE ELSE len(list_intersect(ce, cp)) / len(ce)::DOUBLE END"
    return q_let(q_content(p), "cp", q_let(q_content(e), "ce", body))


def q_token_f1(p: str, e: str) -> str:
    common = "coalesce(list_sum(list_transform(list_distinct(we), lambda w: least(len(list_filter(we, lambda x: x = w)), len(list_filter(wp, lambda x: x = w))))), 0)"
    body = f"CASE WHEN len(we) = 0 OR len(wp) = 0 THEN (len(we) = len(wp))::INT::DOUBLE ELSE 2 * {common} / (len(wp) + len(we))::DOUBLE END"
    return q_let(q_words(p), "wp", q_let(q_words(e), "we", body))


# -- twins of queries that had none ---------------------------------------------------
_DENSE = [*SUBTYPE_LABELS, "other"]
SQL["label_confusion_dense"] = (
    "SELECT l.expected, " + ", ".join(f"coalesce(sum(n) FILTER (predicted = '{x}'), 0)::BIGINT AS \"{x}\"" for x in _DENSE) + f" FROM (SELECT unnest({q_list(_DENSE)}) AS expected) l LEFT JOIN ({_CELLS}) c ON c.expected = l.expected GROUP BY 1"
)
SQL["subclass_normalize"] = f"SELECT row_id, {q_subclass('contract_subtype')} subclass FROM {PAIRS}"
_SAME = " OR ".join(f"(s = '{a}' AND p = '{b}') OR (s = '{b}' AND p = '{a}')" for a, b in EQUIVALENT_SUBCLASSES)
SQL["docclass_hierarchical"] = f"""
    SELECT session, count(*) n, count(*) FILTER (d) / count(*)::DOUBLE doc_type_accuracy, count(*) FILTER (s = p) / count(*)::DOUBLE subclass_accuracy,
      count(*) FILTER (s = p OR {_SAME}) / count(*)::DOUBLE subclass_accuracy_equiv, count(*) FILTER (d AND s = p) / count(*)::DOUBLE joint_exact
    FROM (SELECT session, coalesce(doc_type_ok, false) d, {q_consideration('expected_subtype')} s, {q_consideration('contract_subtype')} p FROM {PAIRS}) GROUP BY session"""
SQL["date_parse"] = f"SELECT row_id, {q_date('predicted')} AS day FROM {_FIELDS} WHERE field = 'effective_date'"
_DAYS = lambda c: f"CAST(({q_date(c)} - DATE '1970-01-01') AS DOUBLE)"
SQL["diag_dates"] = _q_errors(f"SELECT session, {_DAYS('predicted')} p, {_DAYS('expected')} e FROM {_FIELDS} WHERE field = 'effective_date'", "session")
SQL["chart_metric_ci"] = f"""
    SELECT experiment_name, {_M}, CASE WHEN f THEN greatest(0, {_Q_WILSON[0]} - {_Q_WILSON[1]}) ELSE subtype_ci_lo END lo, CASE WHEN f THEN least(1, {_Q_WILSON[0]} + {_Q_WILSON[1]}) ELSE subtype_ci_hi END hi
    FROM (SELECT *, {_M} p, sample_n::DOUBLE n, coalesce((subtype_ci_lo IS NULL OR isnan(subtype_ci_lo) OR subtype_ci_hi IS NULL OR isnan(subtype_ci_hi)) AND sample_n >= 2, false) f FROM {_RUNS} WHERE {_OK})"""


def _q_part(i: int) -> str:
    return f"nullif(CASE WHEN k THEN regexp_extract(r, '{runs.RUN_NAME}', {i}) END, '')"


_HEAD_WORD = "nullif(string_split(r, '_')[1], '')"
SQL["name_parse"] = f"""
    SELECT result_id, experiment_name, CASE WHEN k THEN regexp_extract(r, '{runs.RUN_NAME}', 1) ELSE {_HEAD_WORD} END model_slug, {_q_part(2)} prompt_kind,
      CASE WHEN k THEN regexp_extract(r, '{runs.RUN_NAME}', 3) ELSE nullif(regexp_extract(r, '{runs.FRAGMENT}', 1), '') END AS version, {_q_part(4)} dimension, {_q_part(5)} suffix,
      CASE WHEN k THEN regexp_extract(r, '{runs.RUN_NAME}', 1) ELSE {_HEAD_WORD} END friendly_model
    FROM (SELECT result_id, experiment_name, trim(coalesce(experiment_name, '')) r, regexp_matches(trim(coalesce(experiment_name, '')), '{runs.RUN_NAME}') k FROM {_RUNS})"""


# -- labels ------------------------------------------------------------------------
@query("label_macro_rounded", f"SELECT session, count(*) classes, round(avg(a), 4) macro_accuracy FROM (SELECT session, expected_subtype, round(count(*) FILTER (expected_subtype = contract_subtype) / count(*)::DOUBLE, 4) a FROM {PAIRS} WHERE NOT {Q_ERROR} GROUP BY 1, 2) GROUP BY session")
def _(spark, base):
    return classify.macro_accuracy(_pairs(spark, base), ["session"], digits=4)


_RATE = lambda a, b: f"CASE WHEN {b} > 0 THEN round(({a}) / ({b})::DOUBLE, 4) ELSE 0::DOUBLE END"


@query(
    "label_binary_rounded",
    f"""SELECT session, n, tp, fp, fn, tn, p AS precision, r AS recall, {_RATE('tp + tn', 'n')} accuracy, {_RATE('2 * p * r', 'p + r')} f1, {_RATE('5 * p * r', '4 * p + r')} f2
    FROM (SELECT *, {_RATE('tp', 'tp + fp')} p, {_RATE('tp', 'tp + fn')} r FROM (
      SELECT session, count(*) n, {big('count(*) FILTER (e = 1 AND p = 1)')} tp, {big('count(*) FILTER (e = 0 AND p = 1)')} fp, {big('count(*) FILTER (e = 1 AND p = 0)')} fn, {big('count(*) FILTER (e = 0 AND p = 0)')} tn
      FROM (SELECT session, coalesce(doc_type_ok, false)::INT e, coalesce(subtype_ok, false)::INT p FROM {PAIRS}) GROUP BY session))""",
)
def _(spark, base):
    rows = table(spark, base, "sorter_rows").withColumns({"expected": F.col("doc_type_ok"), "predicted": F.col("subtype_ok")})
    return classify.binary(rows, ["session"], digits=4)


@query("exact_and_failed", f"SELECT row_id, coalesce(expected_subtype = contract_subtype, false)::INT::DOUBLE exact, {Q_ERROR} failed FROM {PAIRS}")
def _(spark, base):
    hit = F.coalesce(F.col("expected_subtype") == F.col("contract_subtype"), F.lit(False)).cast("double")
    return table(spark, base, "sorter_rows").select("row_id", hit.alias("exact"), classify.is_error(F.col("contract_subtype")).alias("failed"))


@query("consideration_normalize", f"SELECT row_id, {q_consideration('contract_subtype')} consideration, {q_consideration('list_value([\'All cash\', \'stock\', \'Mixed cash and stock\', \'MIXED cash/stock election\', \'n.a.\'])[1][(row_id % 5 + 1)::INT]')} stated FROM {PAIRS}")
def _(spark, base):
    said = F.element_at(F.array(*map(F.lit, ["All cash", "stock", "Mixed cash and stock", "MIXED cash/stock election", "n.a."])), (F.col("row_id") % 5 + 1).cast("int"))
    return table(spark, base, "sorter_rows").select("row_id", labels.normalize_consideration(F.col("contract_subtype")).alias("consideration"), labels.normalize_consideration(said).alias("stated"))


_CONS = q_list(CONSIDERATIONS)


@query("subclass_equivalence", f"SELECT a, b, (a IS NOT DISTINCT FROM b) OR coalesce({_SAME.replace('s = ', 'a = ').replace('p = ', 'b = ')}, false) same FROM (SELECT DISTINCT CASE WHEN l_linenumber % 6 < 5 THEN {_CONS}[l_linenumber % 6 + 1] END a, CASE WHEN l_partkey % 6 < 5 THEN {_CONS}[(l_partkey % 6 + 1)::INT] END b FROM lineitem)")
def _(spark, base):
    pick = lambda n: F.when(n < 5, F.element_at(F.array(*map(F.lit, CONSIDERATIONS)), (n + 1).cast("int")))
    rows = table(spark, base, "lineitem").select(pick(F.col("l_linenumber") % 6).alias("a"), pick(F.col("l_partkey") % 6).alias("b")).distinct()
    return rows.withColumn("same", labels.equivalent_subclasses(F.col("a"), F.col("b"), CONSIDERATIONS))


@query("docclass_failure", f"SELECT row_id, CASE WHEN NOT coalesce(doc_type_ok, true) THEN 'doc_type_miss' WHEN NOT coalesce(subtype_ok, true) THEN 'subclass_miss' ELSE 'ok' END AS mode FROM {PAIRS}")
def _(spark, base):
    return table(spark, base, "sorter_rows").select("row_id", labels.docclass_failure(F.col("doc_type_ok"), F.col("subtype_ok")).alias("mode"))


@query("role_words", f"SELECT row_id, pos, len(w) BETWEEN 1 AND 3 AND len(list_filter(w, lambda x: NOT list_contains({q_list(ROLE_WORDS)}, x))) = 0 is_role FROM (SELECT row_id, i - 1 AS pos, {q_words('item')} w FROM (SELECT row_id, unnest(string_split(predicted, ';')) item, generate_subscripts(string_split(predicted, ';'), 1) i FROM {_FIELDS} WHERE field = 'parties' AND predicted IS NOT NULL))")
def _(spark, base):
    rows = table(spark, base, _FIELDS).where("field = 'parties' and predicted is not null").select("row_id", F.posexplode(F.split("predicted", ";")).alias("pos", "item"))
    return rows.select("row_id", F.col("pos").cast("bigint").alias("pos"), text.is_role(F.col("item")).alias("is_role"))


@query("task_answers", f"SELECT row_id, {q_fold('contract_subtype')} question, CASE WHEN {q_fold('subtype_ok::VARCHAR')} = 'true' THEN 'yes' WHEN {q_fold('subtype_ok::VARCHAR')} = 'false' THEN 'no' ELSE {q_fold('subtype_ok::VARCHAR')} END legal, {q_subtype('contract_subtype')} family FROM {PAIRS}")
def _(spark, base):
    said = F.col("contract_subtype")
    return table(spark, base, "sorter_rows").select(
        "row_id", labels.normalize_answer("maud_question", said).alias("question"), labels.normalize_answer("legalbench", F.col("subtype_ok").cast("string")).alias("legal"), labels.normalize_answer("subtype", said).alias("family")
    )


_YES = lambda c: f"(coalesce({c}, false))"


def _flags(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sorter_rows").select("session", F.col("doc_type_ok").cast("string").alias("expected"), F.col("subtype_ok").cast("string").alias("predicted"))


@query(
    "task_binary",
    f"""SELECT session, n, tp, fp, fn, tn, p AS precision, r AS recall, {_RATE('tp + tn', 'n')} accuracy, {_RATE('2 * p * r', 'p + r')} f1, {_RATE('5 * p * r', '4 * p + r')} f2
    FROM (SELECT *, {_RATE('tp', 'tp + fp')} p, {_RATE('tp', 'tp + fn')} r FROM (
      SELECT session, count(*) n, {big('count(*) FILTER (e AND p)')} tp, {big('count(*) FILTER (NOT e AND p)')} fp, {big('count(*) FILTER (e AND NOT p)')} fn, {big('count(*) FILTER (NOT e AND NOT p)')} tn
      FROM (SELECT session, {_YES('doc_type_ok')} e, {_YES('subtype_ok')} p FROM {PAIRS}) GROUP BY session))""",
)
def _(spark, base):
    return classify.task_frames(_flags(spark, base), "legalbench", ["session"], digits=4)["binary"]


_SAID = lambda c: f"CASE WHEN {c} IS NULL THEN '' WHEN {c} THEN 'yes' ELSE 'no' END"


@query("task_per_class", f"SELECT session, e AS class, count(*) n, {big('count(*) FILTER (e = p)')} correct, count(*) FILTER (e = p) / count(*)::DOUBLE accuracy FROM (SELECT session, {_SAID('doc_type_ok')} e, {_SAID('subtype_ok')} p FROM {PAIRS}) GROUP BY 1, 2")
def _(spark, base):
    return classify.task_frames(_flags(spark, base), "legalbench", ["session"])["per_class"]


@query("task_overall", f"SELECT session, count(*) n, round(count(*) FILTER (e = p) / count(*)::DOUBLE, 4) exact_match FROM (SELECT session, {q_fold('expected_subtype')} e, {q_fold('contract_subtype')} p FROM {PAIRS} WHERE session IS NOT NULL) GROUP BY session")
def _(spark, base):
    rows = _pairs(spark, base).where("session is not null")
    return classify.task_frames(rows, "maud_question", ["session"], digits=4)["overall"].select("session", "n", "exact_match")


@query("medians", "SELECT l_returnflag, median(l_extendedprice) median_price FROM lineitem GROUP BY 1")
def _(spark, base):
    return medians(table(spark, base, "lineitem"), ["l_returnflag"], "l_extendedprice", "median_price")


# -- text --------------------------------------------------------------------------
_PIECE_GAP = "[ \\t\\n\\x0B\\f\\r]"
_SENTENCE = f"'([A-Za-z)][.!?]){_PIECE_GAP}+([A-Z0-9\"(])', '\\1' || chr(1) || '\\2', 'g'"


def q_spans(source: str) -> str:
    """(doc_id, pos, span) of the clauses of ``source`` (doc_id, text)."""
    cut = f"regexp_replace(regexp_replace(text, '{_PIECE_GAP}*;{_PIECE_GAP}+', chr(1), 'g'), '{_PIECE_GAP}*\\n{_PIECE_GAP}*', chr(1), 'g')"
    cut = f"regexp_replace(regexp_replace({cut}, {_SENTENCE}), {_SENTENCE})"
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS pos, span FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, array_to_string({q_words('span')}, ' ') ORDER BY g) AS nth FROM (
        SELECT doc_id, g, string_agg(p, ' ' ORDER BY i) span FROM (
          SELECT *, sum((nth = 1 OR len({q_words('p')}) >= 4)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) g FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) nth FROM (
              SELECT doc_id, i, {q_strip('p')} p FROM (SELECT doc_id, unnest(string_split({cut}, chr(1))) p, generate_subscripts(string_split({cut}, chr(1)), 1) i FROM ({source})))
            WHERE p <> ''))
        GROUP BY 1, 2))
      WHERE nth = 1"""


@query("clause_span_rows", q_spans("SELECT doc_id, text FROM documents WHERE text IS NOT NULL"))
def _(spark, base):
    rows = table(spark, base, "documents").where("text is not null").select("doc_id", F.posexplode(text.clause_spans(F.array("text"))).alias("pos", "span"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("jaro_winkler", "SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 9) score FROM part")
def _(spark, base):
    return table(spark, base, "part").select("p_partkey", F.round(jaro_winkler_udf("p_name", "p_type"), 9).alias("score"))


@query("percent_text", f"SELECT result_id, CASE WHEN {_M} IS NULL OR isnan({_M}) THEN 'n/a' ELSE printf('%.1f', round(100 * round({_M}, 6), 1)) || '%' END AS said FROM {_RUNS}")
def _(spark, base):
    return table(spark, base, _RUNS).select("result_id", text.percent(F.round(_M, 6)).alias("said"))


@query("embedding_rescue", f"SELECT row_id, CASE WHEN score < 0.7 AND sim IS NOT NULL THEN greatest(score, sim) ELSE score END score FROM (SELECT row_id, round({q_token_f1('predicted', 'expected')}, 9) score, CASE WHEN row_id % 3 > 0 THEN (row_id % 100) / 100::DOUBLE END sim FROM {_FIELDS})")
def _(spark, base):
    rows = table(spark, base, _FIELDS).withColumns({"f1": F.round(fields.free_text_score(F.col("predicted"), F.col("expected")), 9), "sim": F.when(F.col("row_id") % 3 > 0, (F.col("row_id") % 100) / 100)})
    return rows.select("row_id", text.rescued(F.col("f1"), F.col("sim"), 0.7).alias("score"))


# -- dates -------------------------------------------------------------------------
_DATE_ROWS = f"{_FIELDS} WHERE field = 'effective_date'"


def _dates(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, _FIELDS).where("field = 'effective_date'")


@query("null_dates", f"SELECT row_id, {q_no_real_date('expected')} none FROM {_DATE_ROWS}")
def _(spark, base):
    return _dates(spark, base).select("row_id", parse.no_real_date(F.col("expected")).alias("none"))


_FOLDED = f"SELECT row_id, predicted, expected, {q_fold('predicted')} tp, {q_fold('expected')} te, {q_date('coalesce(predicted, \'\')')} dp, {q_date('coalesce(expected, \'\')')} de FROM {_DATE_ROWS}"


@query("date_phrases", f"SELECT row_id, {q_within('tp', 'te', 'de')} held FROM ({_FOLDED}) WHERE predicted IS NOT NULL AND expected IS NOT NULL")
def _(spark, base):
    rows = spread(_dates(spark, base).where("predicted is not null and expected is not null"), "row_id")
    return rows.select("row_id", parse.date_phrase_within(F.col("predicted"), F.col("expected")).alias("held"))


_Q_DATE_SCORE = f"""CASE WHEN de IS NULL AND {q_no_real_date("coalesce(expected, '')")} THEN ({q_strip("coalesce(predicted, '')")} = '')::INT::DOUBLE WHEN dp = de THEN 1::DOUBLE
      WHEN {q_within('tp', 'te', 'de')} OR {q_within('te', 'tp', 'dp')} THEN 1::DOUBLE WHEN year(dp) = year(de) AND month(dp) = month(de) THEN 0.67::DOUBLE
      WHEN abs(dp - de) <= 45 THEN 0.67::DOUBLE WHEN year(dp) = year(de) OR month(dp) = month(de) THEN 0.33::DOUBLE WHEN dp IS NOT NULL AND de IS NOT NULL THEN 0::DOUBLE END"""


@query("date_scores", f"SELECT row_id, {_Q_DATE_SCORE} score FROM ({_FOLDED})")
def _(spark, base):
    return spread(_dates(spark, base), "row_id").select("row_id", parse.date_score(F.col("predicted"), F.col("expected")).alias("score"))


@query("prose_dates", f"SELECT row_id, coalesce(strftime(dp, '%B') || ' ' || day(dp) || ', ' || year(dp), predicted) prose FROM ({_FOLDED})")
def _(spark, base):
    return _dates(spark, base).select("row_id", parse.prose_date(F.col("predicted")).alias("prose"))


_Q_SPANS = parse.DATE_SPANS.replace("(?i)", "")


@query("dates_grounded", f"SELECT row_id, coalesce(len(list_filter(regexp_extract_all(coalesce(text, ''), '{_Q_SPANS}', 0, 'i'), lambda c: {q_date('c')} = dp)) > 0, false) grounded FROM (SELECT f.row_id, {q_date('f.predicted')} dp, d.text FROM {_FIELDS} f LEFT JOIN documents d ON d.filename = f.filename WHERE f.field = 'effective_date')")
def _(spark, base):
    docs = table(spark, base, "documents").select("filename", "text")
    rows = spread(_dates(spark, base), "row_id").join(docs, "filename", "left")
    return rows.select("row_id", parse.date_grounded(parse.parse_date(F.col("predicted")), F.col("text")).alias("grounded"))


# -- fields ------------------------------------------------------------------------
_KINDS = {"effective_date": "date", "term_length": "containment", "renewal_terms": "free_text", "document_name": "name", "governing_law": "containment", "contract_value": "id"}
_Q_SETTLED = {
    "containment": q_containment("predicted", "expected"), "free_text": f"round({q_token_f1('predicted', 'expected')}, 9)",
    "id": f"({q_normal('predicted')} = {q_normal('expected')})::INT::DOUBLE", "name": q_sure_name("predicted", "expected"),
}
_SETTLED_SQL = " UNION ALL ".join(
    [f"SELECT row_id, {_Q_SETTLED[k]} score FROM {_FIELDS} WHERE field = '{f}'" for f, k in _KINDS.items() if k != "date"]
    + [f"SELECT row_id, coalesce({_Q_DATE_SCORE}, {q_sure_name('predicted', 'expected')}) score FROM ({_FOLDED})"]
)


@query("field_scores_settled", _SETTLED_SQL)
def _(spark, base):
    """Scores as far as native rules go; null is left for similarity."""
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    rows = spread(table(spark, base, _FIELDS).where("field <> 'parties'"), "row_id")
    return rows.select("row_id", F.round(fields.native_score(F.try_element_at(kinds, F.col("field")), F.col("predicted"), F.col("expected")), 9).alias("score"))


_Q_ITEMS = lambda c: f"CASE WHEN coalesce({q_strip(c)}, '') = '' THEN []::VARCHAR[] ELSE list_transform(string_split_regex({c}, '{_PIECE_GAP}*;{_PIECE_GAP}*'), lambda i: {q_strip('i')}) END"
_Q_NAMES = lambda c: f"list_transform({_Q_ITEMS(c)}, lambda n: {q_normal('n')})"
_LISTS_SQL = f"SELECT *, coalesce(list_sum(list_transform(list_distinct(e), lambda x: least(len(list_filter(e, lambda y: y = x)), len(list_filter(p, lambda y: y = x))))), 0)::INT m FROM (SELECT *, {_Q_NAMES('predicted')} p, {_Q_NAMES('expected')} e FROM {_FIELDS} WHERE field = 'parties')"
_Q_LIST = {
    "precision": "CASE WHEN len(e) = 0 THEN 1::DOUBLE WHEN len(p) = 0 THEN 0::DOUBLE ELSE m / len(p)::DOUBLE END",
    "recall": "CASE WHEN len(e) = 0 THEN (len(p) = 0)::INT::DOUBLE WHEN len(p) = 0 THEN 0::DOUBLE ELSE m / len(e)::DOUBLE END",
    "f1": "CASE WHEN len(e) = 0 THEN (len(p) = 0)::INT::DOUBLE WHEN m = 0 THEN 0::DOUBLE ELSE 2 * (m / len(p)::DOUBLE) * (m / len(e)::DOUBLE) / (m / len(p)::DOUBLE + m / len(e)::DOUBLE) END",
}


@query("entity_list_exact", f"SELECT row_id, {', '.join(f'round({q}, 9) AS {c}' for c, q in _Q_LIST.items())}, m AS matched, len(p)::INT n_predicted, len(e)::INT n_expected FROM ({_LISTS_SQL})")
def _(spark, base):
    """Lists of names that match if they are equal: the best assignment is the common multiset."""
    rows = table(spark, base, _FIELDS).where("field = 'parties'").select("row_id", _items("predicted").alias("p"), _items("expected").alias("e"))
    scored = fields.score_lists(rows, "p", "e", F.lit(False), "id").select("row_id", "list_score.*")
    return scored.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_DOC_KINDS = {"effective_date": "free_text", "term_length": "containment", "renewal_terms": "containment", "document_name": "id", "governing_law": "containment", "contract_value": "id"}


def _documents(spark: SparkSession, base: str) -> DataFrame:
    kinds, is_list = F.create_map(*[F.lit(x) for kv in _DOC_KINDS.items() for x in kv]), F.col("field") == "parties"
    docs = spread(table(spark, base, "documents").where("text is not null").select("filename", "text"), "filename")
    docs = docs.withColumn("words", text.content_tokens(text.tokens(F.col("text"))))
    rows = table(spark, base, _FIELDS).withColumns({"field_type": F.try_element_at(kinds, F.col("field")), "pred_items": F.when(is_list, _items("predicted")), "exp_items": F.when(is_list, _items("expected"))})
    return rows.join(docs, "filename", "left")


_SCALAR = {k: f"round({_Q_SETTLED[k]}, 4)" for k in ("containment", "free_text", "id")}
_DOC_SCORES = " UNION ALL ".join(
    f"SELECT extraction_id, field, CASE WHEN predicted IS NULL THEN 0::DOUBLE ELSE {_SCALAR[k]} END s FROM {_FIELDS} WHERE field = '{f}' AND expected <> ''" for f, k in _DOC_KINDS.items()
) + f" UNION ALL SELECT extraction_id, field, round({_Q_LIST['f1']}, 4) FROM ({_LISTS_SQL})"


@query(
    "document_scores",
    f"""SELECT extraction_id, count(*) n_fields, round(avg(s), 9) overall_score, coalesce(string_agg(field, ',' ORDER BY field) FILTER (s BETWEEN 0.5 AND 0.85), '') ambiguous, count(*) FILTER (s BETWEEN 0.5 AND 0.85) > 0 needs_review
    FROM (SELECT extraction_id, field, max(s) s FROM ({_DOC_SCORES}) GROUP BY ALL) GROUP BY extraction_id""",
)
def _(spark, base):
    """Scores of extractions whose fields all have native scorers."""
    rows = _documents(spark, base).drop("text")
    scored = fields.score_documents(rows, ["extraction_id"], Settings(partial_gt=frozenset()), "id")
    return scored.select("extraction_id", F.size("field_scores").cast("bigint").alias("n_fields"), F.round("overall_score", 9).alias("overall_score"), F.array_join("ambiguous_fields", ",").alias("ambiguous"), "needs_review")


_DOCS = f"{_FIELDS} f JOIN documents d ON d.filename = f.filename AND d.text <> ''"
_AUDITED = " UNION ALL ".join(
    f"""SELECT extraction_id, field, 1 AS n, coalesce(s >= 0.6, false)::INT gt, (len(i) > 0 AND len(dw) > 0 AND len(list_intersect(i, dw)) / greatest(len(i), 1)::DOUBLE >= 0.7)::INT doc FROM (
      SELECT extraction_id, field, CASE WHEN expected <> '' THEN {_Q_SETTLED[k]} END s, {q_content('predicted')} i, {q_content('text')} dw FROM (SELECT f.*, d.text FROM {_DOCS})
      WHERE field = '{f}' AND {q_strip("coalesce(predicted, '')")} <> '')"""
    for f, k in _DOC_KINDS.items()
) + f""" UNION ALL SELECT extraction_id, field, 1, list_contains(e, {q_normal('item')})::INT, (len(i) > 0 AND len(dw) > 0 AND len(list_intersect(i, dw)) / greatest(len(i), 1)::DOUBLE >= 0.7)::INT FROM (
      SELECT *, {q_content('item')} i FROM (SELECT f.extraction_id, f.field, unnest({_Q_ITEMS('f.predicted')}) item, {_Q_NAMES('f.expected')} e, {q_content('d.text')} dw FROM {_DOCS} WHERE f.field = 'parties'))"""


@query(
    "document_audits",
    f"""SELECT extraction_id, field, n_predicted, matched_gt, verified_in_doc, true_items, round(true_items / n_predicted::DOUBLE, 4) verified_precision, n_predicted - true_items AS hallucinated,
      round((n_predicted - true_items) / n_predicted::DOUBLE, 4) hallucination_rate, round(avg(round(true_items / n_predicted::DOUBLE, 4)) OVER (PARTITION BY extraction_id), 4) overall_verified_precision
    FROM (SELECT extraction_id, field, sum(n)::BIGINT n_predicted, sum(gt)::BIGINT matched_gt, sum(doc)::BIGINT verified_in_doc, sum(greatest(gt, doc))::BIGINT true_items FROM ({_AUDITED}) GROUP BY ALL)""",
)
def _(spark, base):
    """Audits of every filled field against its document and its label."""
    found = fields.audited_documents(_documents(spark, base), ["extraction_id"], Settings(), "id")
    return found.select("extraction_id", F.explode("audits").alias("field", "a"), "overall_verified_precision").select("extraction_id", "field", "a.*", "overall_verified_precision")


@query(
    "presence_by_field",
    f"""WITH spans AS ({q_spans("SELECT DISTINCT ON (filename) filename AS doc_id, text FROM documents WHERE text IS NOT NULL")})
    SELECT field, count(*) n_expected, {big('count(*) FILTER (m)')} n_matched, count(*) FILTER (m) / count(*)::DOUBLE score FROM (
      SELECT f.row_id, f.field, coalesce(bool_or({q_containment('s.span', 'f.expected')} >= 0.7 AND s.span <> ''), false) AND f.expected <> '' m
      FROM {_FIELDS} f JOIN documents d ON d.filename = f.filename AND d.text IS NOT NULL LEFT JOIN spans s ON s.doc_id = f.filename
      WHERE f.expected IS NOT NULL AND f.field IN ('governing_law', 'document_name') GROUP BY f.row_id, f.field, f.expected) GROUP BY field""",
)
def _(spark, base):
    return QUERIES["category_presence"](spark, base)


@query("chained_summary", f"SELECT session, round(avg(coalesce(doc_type_ok, false)::INT), 4) exact_match, round(avg(coalesce(subtype_ok, false)::INT), 4) subtype_accuracy, round(0.25e0 * avg(coalesce(doc_type_ok, false)::INT) + 0.75e0 * coalesce(avg(confidence), 0), 4) composite, count(*) n FROM {PAIRS} GROUP BY session")
def _(spark, base):
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    rows = table(spark, base, "sorter_rows").groupBy("session").agg(rate("doc_type_ok").alias("x"), rate("subtype_ok").alias("s"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("o"), F.count("*").alias("c"))
    told = rows.select("session", fields.chained_summary(F.col("x"), F.col("s"), F.col("o"), F.col("o"), F.col("c")).alias("t"))
    return told.select("session", "t.sorter.*", "t.composite", "t.n")


# -- clauses: spans that may be missed -------------------------------------------------
_PARTIAL = """SELECT doc_id, lang, CASE WHEN doc_id % 4 < 3 THEN [substr(text, 1, 40), substr(text, 1 + length(text) // 2, 30)] ELSE [] END spans,
    CASE WHEN doc_id % 5 = 0 THEN 'No related clause.' ELSE substr(text, 1, (length(text) * (doc_id % 10)) // 9) END output FROM documents WHERE text IS NOT NULL"""
_BARE = "regexp_replace({0}, '^[ \\n`]+|[ \\n`]+$', '', 'g')"
_PARTIAL_ROWS = f"""SELECT *, contains(lower({_BARE.format('output')}), 'no related clause') none, CASE WHEN len(spans) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b)))::DOUBLE END j,
    CASE WHEN len(spans) > 0 THEN CASE WHEN len(list_filter(spans, lambda s: NOT contains({_BARE.format('output')}, {_BARE.format('s')}))) = 0 THEN 'tp' ELSE 'fn' END WHEN contains(lower({_BARE.format('output')}), 'no related clause') THEN 'tn' ELSE 'fp' END o
    FROM (SELECT *, {_q_jwords("array_to_string(spans, ' ')")} a, {_q_jwords(_BARE.format('output'))} b FROM ({_PARTIAL}))"""


def _partial(spark: SparkSession, base: str) -> DataFrame:
    rows, n = table(spark, base, "documents").where("text is not null"), F.length("text")
    spans = F.when(F.col("doc_id") % 4 < 3, F.array(F.substring("text", 1, 40), F.substring("text", F.floor(1 + n / 2).cast("int"), F.lit(30)))).otherwise(F.array().cast("array<string>"))
    output = F.when(F.col("doc_id") % 5 == 0, "No related clause.").otherwise(F.substring("text", F.lit(1), F.floor(n * (F.col("doc_id") % 10) / 9).cast("int")))
    return clauses.clause_rows(rows.select("doc_id", "lang", spans.alias("spans"), output.alias("output")))


SQL["clause_jaccard"] = f"""
    SELECT lang, round(avg(j), 9) jaccard_mean, CASE WHEN lang IS NOT NULL THEN list_sort(list(j) FILTER (j IS NOT NULL))[len(list(j) FILTER (j IS NOT NULL)) // 2 + 1] END jaccard_median
    FROM ({_PARTIAL_ROWS.replace(_PARTIAL, _CLAUSES)}) GROUP BY lang"""
_N = lambda o: big(f"count(*) FILTER (o = '{o}')")


@query(
    "clause_outcomes",
    f"""SELECT lang, n_pairs, tp + fn AS n_positive, tp, tn, fp, fn, p AS precision, r AS recall, (tp + tn) / n_pairs::DOUBLE accuracy, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END f1,
      CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END f2, nr / n_pairs::DOUBLE no_related_rate, CASE WHEN tp + fn > 0 THEN fnr / (tp + fn)::DOUBLE ELSE 0 END false_no_related_rate, fnr / 1244::DOUBLE false_no_related_rate_fixed, jaccard_mean
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0::DOUBLE END p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0::DOUBLE END r FROM (
      SELECT lang, count(*) n_pairs, {_N('tp')} tp, {_N('tn')} tn, {_N('fp')} fp, {_N('fn')} fn, {big('count(*) FILTER (none)')} nr, {big("count(*) FILTER (none AND o IN ('tp', 'fn'))")} fnr, round(coalesce(avg(j), 0), 9) jaccard_mean FROM ({_PARTIAL_ROWS}) GROUP BY lang))""",
)
def _(spark, base):
    return clauses.clause_metrics(_partial(spark, base), ["lang"]).withColumn("jaccard_mean", F.round("jaccard_mean", 9))


@query("clause_jaccard_median", f"SELECT lang, list_sort(list(j) FILTER (j IS NOT NULL))[len(list(j) FILTER (j IS NOT NULL)) // 2 + 1] jaccard_median FROM ({_PARTIAL_ROWS}) GROUP BY lang HAVING lang IS NOT NULL AND count(j) > 0")
def _(spark, base):
    return clauses.upper_median(_partial(spark, base).where("lang is not null"), ["lang"], "jaccard")


# -- runs --------------------------------------------------------------------------
_MODE_COLUMNS = ", ".join(big(f"count(*) FILTER (m = '{m}')") + f" {m}" for m in FAILURE_MODES)


@query(
    "run_records",
    f"""SELECT s.*, c.n_classes, c.n_correct, c.n_equiv, x.n_cells, x.n_confused FROM (
      SELECT session, 'subtype_classification' task, count(*) n_rows, min(received_at) AS timestamp, round(avg(coalesce(doc_type_ok, false)::INT), 4) exact_match, round(avg(coalesce(subtype_ok, false)::INT), 4) subtype_accuracy,
        round(avg(coalesce(subtype_ok_equiv, false)::INT), 4) subtype_accuracy_equiv, round(avg(confidence), 4) confidence, {big("count(*) FILTER (m <> 'ok')")} n_failed, {_MODE_COLUMNS}
      FROM (SELECT *, {Q_MODE} m FROM {PAIRS} WHERE coalesce(session <> '', false)) GROUP BY session) s
    JOIN (SELECT session, count(*) n_classes, {big('sum(k)')} n_correct, {big('sum(q - k)')} n_equiv FROM (SELECT session, {q_subtype('expected_subtype')} e, count(*) FILTER (coalesce(subtype_ok, false)) k, count(*) FILTER (coalesce(subtype_ok, false) OR coalesce(subtype_ok_equiv, false)) q FROM {PAIRS} GROUP BY 1, 2) GROUP BY session) c ON c.session = s.session
    JOIN (SELECT session, count(*) n_cells, {big('sum(CASE WHEN e <> p THEN n ELSE 0 END)')} n_confused FROM (SELECT session, {q_subtype('expected_subtype')} e, {q_subtype('contract_subtype')} p, count(*) n FROM {PAIRS} GROUP BY 1, 2, 3) GROUP BY session) x ON x.session = s.session""",
)
def _(spark, base):
    found = runs.run_records(table(spark, base, "sorter_rows"))
    total = lambda c, part: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + part(x))
    cells = F.map_values("per_subtype")
    return found.select(
        "session", "task", "n_rows", "timestamp", "exact_match", "subtype_accuracy", "subtype_accuracy_equiv", "confidence", "n_failed", "mode_counts.*", F.size("per_subtype").cast("bigint").alias("n_classes"),
        total(cells, lambda x: x["correct"]).alias("n_correct"), total(cells, lambda x: x["equiv"]).alias("n_equiv"), F.size("confusion").cast("bigint").alias("n_cells"),
        total("confusion", lambda x: F.when(x["expected"] != x["predicted"], x["n"]).otherwise(0)).alias("n_confused"),
    )


@query("frame_keys", f"SELECT result_id, coalesce(model, '?') || '_' || coalesce(v, '?') AS key, v AS version, {_M} * 100 AS percent FROM (SELECT *, CASE WHEN regexp_matches(r, '{runs.RUN_NAME}') THEN regexp_extract(r, '{runs.RUN_NAME}', 3) ELSE nullif(regexp_extract(r, '{runs.FRAGMENT}', 1), '') END v FROM (SELECT *, trim(coalesce(experiment_name, '')) r FROM {_RUNS}))")
def _(spark, base):
    frame = runs.as_percent(runs.normalized_frame(table(spark, base, _RUNS)), _M)
    return frame.select("result_id", "key", "version", F.col(_M).alias("percent"))


@query("display_names", f"SELECT result_id, CASE model WHEN 'loam/loam-chat' THEN 'Loam Chat' WHEN 'cairn/cairn-s' THEN 'Cairn S' ELSE model END AS name FROM {_RUNS}")
def _(spark, base):
    return table(spark, base, _RUNS).select("result_id", runs.display_model(F.col("model"), {"loam/loam-chat": "Loam Chat", "cairn/cairn-s": "Cairn S"}).alias("name"))


@query("unknown_metrics_of_a_smaller_catalog", "SELECT seq, metric FROM score_records s WHERE metric = (SELECT min(name) FROM metric_defs) OR NOT EXISTS (SELECT 1 FROM metric_defs m WHERE m.name = s.metric)")
def _(spark, base):
    metrics = table(spark, base, "metric_defs")
    first = metrics.agg(F.min("name").alias("name"))
    return scorecard.unknown_metrics(table(spark, base, "score_records"), metrics.join(F.broadcast(first), "name", "left_anti")).select("seq", "metric")  # first is one row


@query("metrics_in_order", "SELECT name, tier, row_number() OVER (ORDER BY tier, name) AS place FROM metric_defs")
def _(spark, base):
    from pyspark.sql import Window

    return scorecard.metrics_for(table(spark, base, "metric_defs")).select("name", "tier", F.row_number().over(Window.orderBy("tier", "name")).cast("bigint").alias("place"))  # a catalog is small


# -- exports -----------------------------------------------------------------------
class SqlJson(export.Variant):
    """The same columns in SQL over ``raw``."""

    _KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}

    def at(self, path, kind):
        text_ = f"json_extract_string(raw, '$.{path}')"
        if kind == "string":
            return text_
        # a decimal number is cut to a whole one
        return f"CAST(trunc(TRY_CAST({text_} AS DOUBLE)) AS BIGINT)" if kind == "bigint" else f"TRY_CAST({text_} AS {self._KINDS[kind]})"

    def first(self, *values):
        return f"coalesce({', '.join(values)})"

    def less(self, a, b):
        return f"coalesce({a}, 0) - coalesce({b}, 0)"

    def mean(self, values):
        return f"list_avg(list_filter([{', '.join(values)}], lambda v: v IS NOT NULL))"

    def day(self, text_):
        return text_

    def version(self, raw):
        return f"regexp_replace({raw}, '{export.VERSION_HEAD}', '')"

    def display(self, slug, names):
        return slug


def _export_sql(columns: list[tuple[str, str]], where: str = "") -> str:
    return "SELECT rec_id, " + ", ".join(f'{c} AS "{h}"' for h, c in columns if h != "DATE") + f" FROM experiment_log WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'{where}"


def _wide(spark: SparkSession, base: str, columns: list, task: str | None) -> DataFrame:
    return export.export_frame(table(spark, base, "experiment_log"), "raw", [c for c in columns if c[0] != "DATE"], ["rec_id"], task)


_TASK = " AND json_extract_string(raw, '$.task') = '{0}'"


@query("export_sorter_columns", _export_sql(export.sorter_columns(b=SqlJson()), _TASK.format("subtype_classification")))
def _(spark, base):
    return _wide(spark, base, export.sorter_columns(), "subtype_classification")


@query("export_extraction_columns", _export_sql(export.extraction_columns(b=SqlJson()), _TASK.format("extraction")))
def _(spark, base):
    return _wide(spark, base, export.extraction_columns(), "extraction")


_SWEEP = dict(export.sorter_columns(b=SqlJson()))
_SWEEP_ROWS = f"""SELECT rec_id, {_SWEEP['Experiment Name']} AS "Experiment Name", {_SWEEP['Prompt Version']} AS "Prompt Version", {_SWEEP['Subtype Accuracy']} AS "Subtype Accuracy", {_SWEEP['SAMPLE (n)']} n
    FROM experiment_log WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'{_TASK.format('subtype_classification')}"""


@query(
    "sweep_with_notes",
    f"""SELECT rec_id, "Experiment Name", "Prompt Version", "Subtype Accuracy", CASE WHEN "Experiment Name" LIKE 'loam%' THEN 'seen ' || length("Experiment Name") END AS "Notes" FROM ({_SWEEP_ROWS})
    WHERE "Prompt Version" IS NOT DISTINCT FROM (SELECT "Prompt Version" FROM ({_SWEEP_ROWS}) ORDER BY coalesce("Subtype Accuracy", 0) DESC, coalesce(n, 0) DESC, rec_id LIMIT 1)""",
)
def _(spark, base):
    log = table(spark, base, "experiment_log")
    names = export.export_frame(log, "raw", export.sorter_columns()[1:2], task="subtype_classification").where("`Experiment Name` like 'loam%'").distinct()
    notes = names.withColumn("Notes", F.concat(F.lit("seen "), F.length("Experiment Name").cast("string")))
    wide = export.sweep_frame(log, "raw", "rec_id", notes=notes)
    return wide.select("rec_id", "Experiment Name", "Prompt Version", "Subtype Accuracy", "Notes")


_HEAT = [(f"Accuracy: {s}", s) for s in sorted(SUBTYPE_LABELS)]
_HEAT_SQL = dict(export.sorter_columns(b=SqlJson()))


@query("chart_heatmap", " UNION ALL ".join(f"SELECT rec_id, v.n AS experiment_name, '{s}' AS key, v.a AS value FROM (SELECT rec_id, {_HEAT_SQL['Experiment Name']} n, {_HEAT_SQL[h]} a FROM experiment_log WHERE json_valid(raw)) v WHERE v.a IS NOT NULL" for h, s in _HEAT))
def _(spark, base):
    wide = _wide(spark, base, export.sorter_columns(), None).withColumnRenamed("Experiment Name", "experiment_name")
    return runs.subtype_heatmap(wide, "rec_id")


@query("chart_failures", " UNION ALL ".join(f"SELECT rec_id, v.n AS experiment_name, '{m}' AS mode, v.a AS n FROM (SELECT rec_id, {_HEAT_SQL['Experiment Name']} n, {_HEAT_SQL[f'Failures: {m}']} a FROM experiment_log WHERE json_valid(raw)) v WHERE v.a > 0" for m in export.SORTER_MODES))
def _(spark, base):
    wide = _wide(spark, base, export.sorter_columns(), None).withColumnRenamed("Experiment Name", "experiment_name")
    return runs.failure_bars(wide, "rec_id")


def _grouped(name: str) -> None:
    SQL[f"chart_{name}"] = f"SELECT coalesce({name}, '?') AS {name}, round(avg({_M}), 9) AS mean, count(*) n_runs FROM {_RUNS} WHERE {_OK} GROUP BY 1"
    key = {"prompt_version": "prompt_version", "model": "model_comparison"}[name]

    def run(spark: SparkSession, base: str) -> DataFrame:
        frame = runs.chart_frames(table(spark, base, _RUNS), _M, "subtype_ci_lo", "subtype_ci_hi", "result_id")[key]
        return frame.select(name, F.round("mean", 9).alias("mean"), "n_runs")

    QUERIES[f"chart_{name}"] = run


_grouped("prompt_version")
_grouped("model")


@query("chart_confidence", f"SELECT experiment_name, average_confidence, {_M} FROM {_RUNS} WHERE {_OK} AND average_confidence IS NOT NULL")
def _(spark, base):
    return runs.chart_frames(table(spark, base, _RUNS), _M, "subtype_ci_lo", "subtype_ci_hi", "result_id")["confidence"]


@query("failures_by_session", f"SELECT session, {q_subtype('expected_subtype')} subtype, count(*) n FROM {PAIRS} WHERE {Q_MODE} <> 'ok' GROUP BY 1, 2")
def _(spark, base):
    rows = failures.ledger(table(spark, base, "sorter_rows")).withColumn("subtype", labels.normalize_subtype(F.col("expected_subtype")))
    return rows.groupBy("session", "subtype").agg(F.count("*").alias("n"))
