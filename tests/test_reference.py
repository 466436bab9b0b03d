"""Hand-computed values of the evaluation operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import labels, parse, text
from gaugeworks.functions.similarity import best_assignment, jaro_winkler, list_score, name_score, seq_ratio, token_set_ratio
from gaugeworks.operators import catalog, classify, clauses, cost, diagnostics, failures, fields, runs, scorecard, stats
from gaugeworks.settings import Settings


def value(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def pairs(spark, rows):
    return spark.createDataFrame(rows, "expected string, predicted string")


# -- labels ----------------------------------------------------------------------
@pytest.mark.parametrize(
    ("raw", "label"),
    [('{"doc_type": "Court Opinion"}', "court_opinion"), ("CONTRACT", "contract"), ("ERROR: contract too long", "contract"), (" `due diligence` ", "due_diligence"), ('"Other"', "other"), (None, ""), ("{broken}", "{broken}")],
)
def test_normalize_label(spark, raw, label):
    assert value(spark, labels.normalize_label(F.col("v")), v=raw) == label


@pytest.mark.parametrize(
    ("raw", "key"),
    [("License Agreement", "license"), ("Non-Compete", "non_compete_no_solicit"), ("services", "other"), ("service_agreement", "service"), ("hosting", "hosting"), ("", "other"), (None, "other"), ("IP Agreement", "ip")],
)
def test_normalize_subtype(spark, raw, key):
    assert value(spark, labels.normalize_subtype(F.col("v")), v=raw) == key


def test_other_normalisers(spark):
    assert value(spark, labels.normalize_consideration(F.col("v")), v="Mixed Cash & Stock (Election)") == "mixed_cash_stock_election"
    assert value(spark, labels.normalize_consideration(F.col("v")), v="All Cash") == "all_cash"
    assert value(spark, labels.normalize_yes_no(F.col("v")), v=" YES. ") == "yes"
    assert value(spark, labels.normalize_yes_no(F.col("v")), v="1.0") == "1 0"
    assert value(spark, labels.normalize_subclass(F.col("v"), ["all_cash", "other"]), v="All-Cash") == "all_cash"
    assert value(spark, labels.normalize_subclass(F.col("v")), v=" Raw ") == "Raw"
    assert value(spark, labels.equivalent_subtypes(F.col("a"), F.col("b")), a="development", b="license") is True
    assert value(spark, labels.equivalent_subtypes(F.col("a"), F.col("b")), a="development", b="maintenance") is False
    assert value(spark, labels.equivalent_subclasses(F.col("a"), F.col("b")), a=None, b=None) is True


def test_failure_modes(spark):
    rows = [(True, True, "a", True), (False, False, "a", False), (False, True, "other", False), (False, True, "a", True), (False, True, "a", None)]
    df = spark.createDataFrame(rows, "subtype_ok boolean, doc_type_ok boolean, contract_subtype string, subtype_ok_equiv boolean")
    assert [r["mode"] for r in failures.with_mode(df).collect()] == ["ok", "function_over_form", "other_fallback", "equivalent_family", "family_confusion"]
    assert spark.range(1).select(labels.docclass_failure(F.lit(None).cast("boolean"), F.lit(False)).alias("x")).first().x == "subclass_miss"


# -- classification -----------------------------------------------------------------
def test_multiclass(spark):
    df = pairs(spark, list(zip("abcab", "abcbb", strict=True)))
    assert classify.accuracy(df, []).first().accuracy == pytest.approx(0.8)
    assert classify.macro_accuracy(df, []).first().macro_accuracy == pytest.approx((0.5 + 1 + 1) / 3)
    assert [tuple(r) for r in classify.top_confusions(classify.confusion(df, []), 5).collect()] == [("a", "b", 1)]
    dense = {r.expected: (r.a, r.b, r.c) for r in classify.dense_confusion(classify.confusion(df, []), ["a", "b", "c"]).collect()}
    assert dense == {"a": (1, 1, 0), "b": (0, 2, 0), "c": (0, 0, 1)}


def test_errors_and_missing(spark):
    df = pairs(spark, [("a", "ERROR: x"), ("a", "a"), ("b", None)])
    assert classify.accuracy(df, []).first().accuracy == pytest.approx(1 / 3)
    assert {(r["class"], r.n) for r in classify.per_class(df, []).collect()} == {("a", 1), ("b", 1)}
    assert classify.accuracy(df.limit(0), []).first().accuracy == 0


def test_binary(spark):
    row = classify.binary(pairs(spark, list(zip(["yes", "no", "yes", "no", "yes"], ["yes", "yes", "yes", "no", "no"], strict=True))), []).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (2, 1, 1, 1) and row.accuracy == pytest.approx(0.6) and row.precision == pytest.approx(2 / 3)


def test_hierarchical(spark):
    rows = [("contract", "contract", "all cash", "all cash"), ("contract", "contract", "mixed cash and stock", "mixed cash stock election"), ("contract", "correspondence", "all stock", "all stock"), ("contract", "contract", "cash", "all_cash")]
    df = spark.createDataFrame(rows, "de string, dp string, se string, sp string")
    r = classify.hierarchical(df, [], ("de", "dp"), ("se", "sp")).first()
    assert (r.doc_type_accuracy, r.subclass_accuracy, r.subclass_accuracy_equiv, r.joint_exact) == (0.75, 0.75, 1.0, 0.5)
    assert classify.score_task(pairs(spark, [("License", "license"), ("supply", "x")]), "subtype", []).first().exact_match == 0.5


# -- text ---------------------------------------------------------------------------
def test_text(spark):
    assert value(spark, text.normalized(F.col("v")), v="Global Technologies, Ltd.") == "GLOBAL TECHNOLOGIES"
    assert value(spark, text.jaccard(F.col("a"), F.col("b")), a="a b c", b="a b") == pytest.approx(2 / 3)
    assert value(spark, text.jaccard(F.col("a"), F.col("b")), a="", b="") == 1
    assert value(spark, text.jaccard(F.col("a"), F.col("b")), a="a/b; c.", b="a b c") == 1
    assert value(spark, fields.free_text_score(F.col("a"), F.col("b")), a="", b="something") == 0
    assert value(spark, fields.free_text_score(F.col("a"), F.col("b")), a="a a b", b="a b b") == pytest.approx(2 / 3)
    assert value(spark, fields.containment_score(F.col("a"), F.col("b")), a="laws of Delaware", b="the laws of the State of Delaware") == pytest.approx(2 / 3)
    assert value(spark, text.is_role(F.col("v")), v="Shipper.") is True
    spans = value(spark, text.clause_spans(F.array("v")), v="The buyer shall pay $5.00 now. Seller ships. The buyer shall pay $5.00 now; and keep records of all")
    assert spans == ["The buyer shall pay $5.00 now. Seller ships.", "The buyer shall pay $5.00 now", "and keep records of all"]
    assert text.cosine is not None and spark.range(1).select(text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("x")).first().x is None


def test_similarity():
    assert name_score("FRANCHISE AGREEMENT", "Goosehead Insurance Agency, LLC Franchise Agreement") == 1
    assert name_score("BETA", "SOVEREIGN STATE BANK OF OHIO") < 0.8
    assert name_score("", "") == 1 and name_score("a", None) == 0
    assert seq_ratio("abcd", "bcde") == pytest.approx(0.75)
    assert token_set_ratio("a b", "a b c") == 1
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)


@pytest.mark.parametrize("seed", range(30))
def test_assignment_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m = map(int, rng.integers(1, 6, 2))
    gain = rng.random((n, m)).round(2)
    pairs_ = best_assignment(gain)
    rows, columns = range(n), range(m)
    best = max(sum(gain[r, c] for r, c in zip(rows, p, strict=False)) for p in itertools.permutations(columns, n)) if n <= m else max(sum(gain[r, c] for r, c in zip(p, columns, strict=False)) for p in itertools.permutations(rows, m))
    assert len(pairs_) == min(n, m) and len({r for r, _ in pairs_}) == len({c for _, c in pairs_}) == min(n, m)
    assert sum(gain[r, c] for r, c in pairs_) == pytest.approx(best)


def test_lists(spark):
    r = list_score("name", ["Beta LLC", "Alpha LLC", "Extra Corp"], ["Alpha LLC", "Beta LLC"], False)
    assert (r["matched"], r["recall"]) == (2, 1) and r["precision"] == pytest.approx(2 / 3)
    assert list_score("name", [], [], False)["f1"] == 1 and list_score("name", [], ["a"], False)["recall"] == 0
    assert list_score("name", ["Shipper Co."], ["Shipper"], True)["recall"] == 1
    df = spark.createDataFrame([(["Beta LLC"], ["Alpha LLC", "Beta LLC"]), (None, ["x"])], "p array<string>, e array<string>")
    assert [x.list_score.matched for x in fields.score_lists(df, "p", "e", F.lit(False)).collect()] == [1, 0]


# -- parsing ------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("pred", "exp", "score"),
    [
        ("March 3, 2024", "03/03/2024", 1), ("March 3, 2024", "March 1, 2024", 0.67), ("March 3, 2024", "2023-01-01", 0), ("", "_____ day of ________, 19____", 1),
        ("March 3, 2024", "_____ day of ________, 19____", 0), ("Executed March 1, 1996 and November 5, 1996", "November 5, 1996", 1), ("10th day of January 2000", "2000-01-10", 1),
        ("2024-01-20", "March 1, 2024", 0.67), ("2024-08-20", "March 1, 2024", 0.33),
    ],
)
def test_dates(spark, pred, exp, score):
    assert value(spark, parse.date_score(F.col("p"), F.col("e")), p=pred, e=exp) == score


@pytest.mark.parametrize(("raw", "amount"), [("$250,001", 250001), ("2M", 2e6), ("1.5k", 1500), ("300 USD", 300), ("2M USD", None), ("nan", None), ("5D", None), ("", None), (None, None)])
def test_money(spark, raw, amount):
    assert value(spark, parse.parse_money(F.col("v")), v=raw) == amount


@pytest.mark.parametrize(("raw", "days"), [("two (2) years", 730), ("thirty (30) days", 30), ("24 months", 720), ("annual", 365), ("1 year", 365), ("soon", None), ("umpteen years", None), (None, None)])
def test_durations(spark, raw, days):
    assert value(spark, parse.parse_duration(F.col("v")), v=raw) == days


# -- fields --------------------------------------------------------------------------
def test_documents(spark):
    rows = [(1, "document_name", "name", "Alpha Deed", "Alpha Deed"), (1, "effective_date", "date", "March 3, 2024", "March 1, 2024"), (1, "notes", "name", "x", ""), (2, "governing_law", "name", None, "Ohio"), (3, "effective_date", None, None, "____")]
    df = spark.createDataFrame(rows, "doc int, field string, field_type string, predicted string, expected string")
    got = {r.doc: r for r in fields.score_documents(df, ["doc"]).collect()}
    assert got[1].overall_score == pytest.approx(0.835) and got[1].ambiguous_fields == ["effective_date"] and got[1].needs_review
    assert got[2].overall_score == 0 and got[3].overall_score == 1
    assert fields.score_documents(df.limit(0), ["doc"]).count() == 0


def test_audit(spark):
    rows = [(1, "name", "Acme Corporation", "Other", "made with Acme Corporation today"), (2, "date", "2006-04-01", "x", "as of April 1, 2006"), (3, "name", "Zeta Works", "", "nothing"), (4, "name", " ", "a", "a")]
    df = spark.createDataFrame(rows, "i int, kind string, p string, e string, doc string")
    got = {r.i: (r.matched_gt, r.verified_in_doc, r.hallucinated) for r in fields.audit_scalars(df, "kind", "p", "e", "doc").collect()}
    assert got[1][1:] == (1, 0) and got[2][1:] == (1, 0) and got[3] == (0, 0, 1) and got[4] == (0, 0, 0)


def test_scores_split_and_unite(spark):
    kinds = ["id", "money", "date", "name", "free_text", "containment"]
    rows = [(i, kinds[i % 6], p, e) for i, (p, e) in enumerate(itertools.product([None, "", "Alpha Beta", "$5", "x" * 3000], repeat=2))] * 2
    df = spark.createDataFrame(rows, "i int, field_type string, predicted string, expected string")
    got = fields.score_scalars(df).collect()
    assert len(got) == 50 and all(0 <= r.score <= 1 for r in got)


# -- clauses -----------------------------------------------------------------------
def test_clauses(spark):
    rows = [(1, ["pay now"], "You pay now."), (2, ["pay now"], "No related clause."), (3, ["a", "b c"], "a only"), (4, [], "no related clause"), (5, None, "something"), (6, ["x"], None)]
    df = clauses.clause_rows(spark.createDataFrame(rows, "i int, spans array<string>, output string"))
    assert [r.outcome for r in df.orderBy("i").collect()] == ["tp", "fn", "fn", "tn", "fp", "fn"]
    m = clauses.clause_metrics(df.where("i < 6"), []).first()
    assert (m.tp, m.fn, m.tn, m.fp) == (1, 2, 1, 1) and m.false_no_related_rate == pytest.approx(1 / 3) and m.false_no_related_rate_fixed == pytest.approx(1 / 1244)
    values = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "v double")
    assert clauses.upper_median(values, [], "v").first().v_median == 3


# -- diagnostics, statistics ---------------------------------------------------------
def test_diagnostics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 9.0), (None, 1.0)], "p double, e double")
    r = diagnostics.errors(df, []).first()
    assert r.n == 3 and r.mae == pytest.approx(5 / 3) and r.median_ae == 1
    assert r.r2 == pytest.approx(1 - 17 / sum((e - 14 / 3) ** 2 for e in (2, 3, 9)))
    assert diagnostics.errors(df.limit(1), []).first().r2 is None
    s = spark.createDataFrame([(1.0,), (0.0,), (0.5,), (1.2,), (None,)], "field_score double")
    r = diagnostics.error_classes(s, []).first()
    assert (r.n, r.exact, r.miss, r.partial) == (4, 2, 1, 1)


def test_wilson_and_bootstrap(spark):
    ci = spark.range(1).select(stats.wilson(F.lit(0.5), F.lit(100)).alias("x")).first().x
    assert (round(ci.lo, 4), round(ci.hi, 4)) == (0.4038, 0.5962)
    assert spark.range(1).select(stats.wilson(F.lit(0.5), F.lit(0)).alias("x")).first().x is None
    assert stats.interval([1.0]) is None
    rng = random.Random(5)
    values = [float(rng.random() < 0.7) for _ in range(200)]
    lo, hi = stats.interval(values, n_boot=500)
    df = spark.createDataFrame([("s", v) for v in values] + [("one", 1.0), ("s", None)], "g string, v double")
    row = stats.bootstrap(df, "g", "v", n_boot=500).collect()
    assert len(row) == 1 and row[0].n == 200 and abs(row[0].lo - lo) < 0.02 and abs(row[0].hi - hi) < 0.02
    assert stats.interval(values, n_boot=100) == stats.interval(values, n_boot=100)
    assert stats.difference([0.0, 0.1, 0.0], [1.0, 0.9, 1.0], n_boot=200)["significant"]


def test_bootstrap_in_chunks(spark, monkeypatch):
    """Tiny chunks and one chunk agree with draws one by one, whatever the magnitude."""
    rng = random.Random(9)
    values = [rng.random() * 1e-9 for _ in range(150)]
    df = spark.createDataFrame([("s", v) for v in values] + [(None, v) for v in values] + [("few", 1.0)] * 40 + [("few", 0.0)] * 40 + [("nan", float("nan"))], "g string, v double")
    lo, hi = stats.interval(values, n_boot=2000)
    near = (hi - lo) * 0.15
    for chunk in (50_000, 20):
        monkeypatch.setattr(stats, "CHUNK", chunk)
        got = {r.g: r for r in stats.bootstrap(df, "g", "v").collect()}
        assert set(got) == {"s", None, "few"} and got["s"].n == 150
        assert all(abs(got[g].lo - lo) < near and abs(got[g].hi - hi) < near for g in ("s", None))
        assert abs(got["few"].half - 0.1095) < 0.012
    assert stats.bootstrap(df.limit(0), "g", "v").count() == 0
    two = df.where("g = 's'").selectExpr("g", "v", "'a' side").unionByName(df.where("g = 's'").selectExpr("g", "v * 2 v", "'b' side"))
    row = stats.bootstrap_difference(two, "side", "a", "b", "g", "v").collect()
    assert len(row) == 1 and row[0].significant and abs(row[0].delta - sum(values) / 150) < 1e-15
    assert stats.bootstrap_difference(two.where("side = 'a'"), "side", "a", "b", "g", "v").count() == 0


# -- runs ---------------------------------------------------------------------------
RUNS = [
    (1, "qwen-a_sorter_v13_subtype_x", "m1", "v13", "2026-08-13", 509, 0.90), (2, "qwen-a_sorter_v13_subtype_y", "m1", "v13", "2026-08-14", 509, 0.943),
    (3, "qwen-a_sorter_v14_subtype_z", "m2", "v14", "2026-08-15", 100, 0.94), (4, "pilot_trace_sorter_v5", "m2", "v13", "2026-08-16", 509, 0.92), (5, None, None, None, None, None, float("nan")),
]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(RUNS, "result_id int, experiment_name string, model string, prompt_version string, run_date string, sample_n bigint, acc double")


def test_runs(frame):
    assert runs.best_run(frame, "acc", "result_id").first().result_id == 2
    assert runs.runner_up(frame, "acc", "result_id").first().result_id == 3
    assert runs.best_run(frame, "acc", "result_id", min_n=600).count() == 0
    s = {r.prompt_version: r for r in runs.group_summary(frame, "prompt_version", "acc", "result_id").collect()}
    assert s["v13"].n_runs == 3 and s["v13"].best_run == RUNS[1][1] and s["v13"].spread == pytest.approx(0.043)
    assert [r.result_id for r in runs.regressions(frame, "acc", "prompt_version", "run_date", "result_id").collect()] == [4]
    assert runs.champion_version(frame, "prompt_version", "acc", "result_id").first()[0] == "v13"
    assert runs.sweep(frame, "prompt_version", "acc", "result_id").count() == 3
    with pytest.raises(ValueError):
        runs.with_metric(frame, "nothing")


def test_run_names(frame):
    got = {r.result_id: r for r in runs.with_name_parts(frame, "experiment_name", {"qwen-a": "Qwen A"}).collect()}
    assert (got[1].model_slug, got[1].prompt_kind, got[1].version, got[1].dimension, got[1].suffix, got[1].friendly_model) == ("qwen-a", "sorter", "v13", "subtype", "x", "Qwen A")
    assert (got[4].model_slug, got[4].version, got[5].version) == ("pilot", "v5", None)


def test_cost(spark):
    prices = spark.createDataFrame([(0, "a/b", 1.0, 2.0), (1, "a/", 10.0, 20.0)], "pos int, known string, per_m_in double, per_m_out double")
    df = spark.createDataFrame([("a/b", 1_000_000, 0), ("a/b-2026", 0, 1_000_000), ("a/c", 1_000_000, None), ("z", 5, 5), ("a/b", 0, 0), (None, 1, 1)], "model string, prompt_tokens bigint, completion_tokens bigint")
    got = [(r.model or "", r.cost_estimated_usd) for r in cost.with_cost(df, prices).collect()]
    assert sorted(got, key=str) == sorted([("a/b", 1.0), ("a/b-2026", 2.0), ("a/c", 10.0), ("z", None), ("a/b", None), ("", None)], key=str)


# -- scorecards -----------------------------------------------------------------------
def test_scorecard(spark):
    metrics = catalog.registry(spark, [{"name": "acc", "tier": "headline"}, {"name": "cost", "tier": 1, "aggregation": "sum"}, {"name": "note", "tier": 2, "aggregation": "none"}, {"name": "own", "agents": ["b"]}])
    rows = [("a", "acc", v, None, i) for i, v in enumerate((0.8, 0.9, 1.0))] + [("a", "cost", v, None, 9) for v in (0.1, 0.2, 0.3)] + [("a", "note", None, s, i) for i, s in enumerate(("x", "y"))] + [("a", "own", 1.0, None, 1), ("a", "acc2", 1.0, None, 1), ("b", "acc", 0.7, None, 1)]
    scores = spark.createDataFrame(rows, "agent string, metric string, value_num double, value_str string, seq bigint")
    card = {(r.agent, r.metric): (r.value_num, r.value_str) for r in scorecard.scorecard(scores, metrics, []).collect()}
    assert card[("a", "acc")][0] == pytest.approx(0.9) and card[("a", "cost")][0] == pytest.approx(0.6) and card[("a", "note")] == (None, "y") and ("a", "own") not in card
    top = scorecard.scorecard(scores, metrics, [], 0)
    assert scorecard.compare_headlines(top.where("agent = 'b'"), top.where("agent = 'a'")).first().delta_b_minus_a == pytest.approx(0.2)
    with pytest.raises(ValueError):
        scorecard.checked(scores, metrics)
    assert scorecard.pruned(scores, metrics).count() == 7
    with pytest.raises(ValueError):
        catalog.registry(spark, [{"name": "x", "tier": 7}])
    table = catalog.bundles(spark, {"b": {"metrics": ["acc", "note"], "agents": {"z": ["cost", "acc"]}}})
    assert [r.metric for r in catalog.bundle_metrics(table, "b", "z").collect()] == ["acc", "note", "cost"]
    assert [r.metric for r in catalog.dashboard(table, metrics, "b", "z").collect()] == ["acc", "cost"]
    assert catalog.invalid_bundle_metrics(table, metrics).count() == 0
    assert catalog.resolve_bundle({"tasks": ["t"]}, None, {}, {"t": "b"}) == "b"


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("match: 0.5\nband: [0.4, 0.9]\nunknown_key: 1\n")
    assert Settings.load(str(path)).match == 0.5 and Settings.load(str(path)).band == (0.4, 0.9) and Settings().with_(match=0.1).match == 0.1


def test_audits_keep_rows_without_items_or_text(spark, tmp_path):
    from gaugeworks.plans.reference import QUERIES

    docs = [("a.txt", "signed by Acme Corporation and Zeta Works"), ("b.txt", None)]
    spark.createDataFrame(docs, "filename string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    given = [(1, "a.txt", "parties", "Acme Corporation; Nobody Known", "Acme Corporation"), (2, "a.txt", "parties", None, "x"), (3, "a.txt", "parties", " ", None), (4, "b.txt", "parties", "Acme Corporation", "Other"), (5, "c.txt", "parties", "Zeta Works", "Zeta Works")]
    given += [(6, "c.txt", "governing_law", "Ohio", "Texas"), (7, "b.txt", "effective_date", "2006-04-01", "2006-04-01"), (8, "c.txt", "effective_date", "2006-04-01", "2009-09-09")]
    spark.createDataFrame(given, "row_id int, filename string, field string, predicted string, expected string").write.parquet(str(tmp_path / "extraction_fields.parquet"))
    got = {r.row_id: tuple(r)[1:] for r in QUERIES["list_audit"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1, 1, 1, 1, 0.5, 0.5), 2: (0, 0, 0, 0, 0, 0, 0), 3: (0, 0, 0, 0, 0, 0, 0), 4: (1, 0, 0, 0, 1, 0, 1), 5: (1, 1, 0, 1, 0, 1, 0)}
    assert {r.row_id: tuple(r)[1:] for r in QUERIES["scalar_audit"](spark, str(tmp_path)).collect()} == {6: (0, 0, 1), 7: (1, 0, 0), 8: (0, 0, 1)}
