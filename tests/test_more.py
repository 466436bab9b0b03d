"""Rounded rates, audits within document scores, rescue, run records, bundles and settings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.operators import catalog, classify, export, fields, runs, stats
from gaugeworks.operators.ordering import with_lag
from gaugeworks.operators.quantiles import at_ranks, bucket_of, medians, with_medians
from gaugeworks.settings import Settings


def test_rates_of_rounded_rates(spark):
    rows = [("a", "yes", "yes")] * 2 + [("a", "yes", "no")] + [("a", "no", "yes")] * 4 + [("b", "no", "no")]
    df = spark.createDataFrame(rows, "g string, expected string, predicted string")
    got = {r.g: r for r in classify.binary(df, ["g"], digits=4).collect()}
    assert (got["a"].precision, got["a"].recall) == (0.3333, 0.6667) and got["a"].f1 == round(2 * 0.3333 * 0.6667 / (0.3333 + 0.6667), 4)
    assert (got["b"].precision, got["b"].f1, got["b"].accuracy) == (0.0, 0.0, 1.0)
    three = spark.createDataFrame([("x", "x"), ("x", "y"), ("x", "y"), ("y", "y"), ("z", "x"), ("z", "z"), ("z", "z")], "expected string, predicted string")
    assert classify.macro_accuracy(three, [], digits=4).first().macro_accuracy == round((0.3333 + 1 + 0.6667) / 3, 4)
    assert classify.macro_accuracy(three.limit(0), [], digits=4).first().macro_accuracy is None


DOCUMENT = "This Agreement between Acme Widgets Inc and Beta Ltd is made on April 3, 2004 and governed by the laws of Delaware."
DOC_FIELDS = [
    (1, "effective_date", "date", "2004-04-03", "April 3, 2004", None, None, DOCUMENT), (1, "governing_law", "containment", "Delaware", "State of Delaware", None, None, DOCUMENT),
    (1, "document_name", "id", "Purple Elephant Treaty", None, None, None, DOCUMENT), (1, "notes", "free_text", " ", "x", None, None, DOCUMENT),
    (1, "parties", None, None, None, ["Acme Widgets", "Gamma GmbH"], ["Acme Widgets Inc"], DOCUMENT), (2, "effective_date", "date", "2004-04-03", "2004-04-03", None, None, None),
    (3, "effective_date", "date", None, "______ (blank)", None, None, ""), (4, "governing_law", "containment", None, None, None, None, DOCUMENT),
]
FIELD_SCHEMA = "doc int, field string, field_type string, predicted string, expected string, pred_items array<string>, exp_items array<string>, text string"


def test_document_scores_with_audits(spark):
    df = spark.createDataFrame(DOC_FIELDS, FIELD_SCHEMA)
    got = {r.doc: r for r in fields.score_documents(df, ["doc"]).collect()}
    assert set(got) == {1, 2, 3}
    audits = {k: v.asDict() for k, v in got[1].audits.items()}
    assert set(audits) == {"effective_date", "governing_law", "document_name", "parties"}  # the blank field isn't audited
    assert audits["document_name"] | {"hallucination_rate": 0} == {"n_predicted": 1, "matched_gt": 0, "verified_in_doc": 0, "true_items": 0, "verified_precision": 0.0, "hallucinated": 1, "hallucination_rate": 0}
    assert (audits["parties"]["n_predicted"], audits["parties"]["true_items"], audits["parties"]["verified_precision"]) == (2, 1, 0.5)
    assert audits["effective_date"]["verified_in_doc"] == 1 and got[1].overall_verified_precision == round((1 + 1 + 0 + 0.5) / 4, 4)
    assert got[2].audits is None and got[2].overall_verified_precision is None and got[3].field_scores == {"effective_date": 1.0}
    assert fields.score_documents(df.limit(0), ["doc"]).count() == 0
    assert "audits" not in fields.score_documents(df, ["doc"], Settings(verify=False)).columns
    again = fields.audited_documents(df.unionByName(df), ["doc"]).first()
    assert again.audits["parties"]["n_predicted"] == 4 and again.overall_verified_precision == got[1].overall_verified_precision


def test_rescue_lifts_low_scores(spark):
    df = spark.createDataFrame([("name", "Acme", "Zebra", 0.9), ("name", "Acme", "Zebra", None), ("name", "", "Zebra", 0.9), ("id", "A1", "B2", 0.9), ("free_text", "a b", "a b", 0.1)], "k string, p string, e string, s double")
    scored = fields.score_scalars(df, "k", "p", "e", similarity="s").collect()
    plain = fields.score_scalars(df, "k", "p", "e").collect()
    assert scored[0].score == 0.9 and scored[1].score == plain[1].score < 0.7 and [r.score for r in scored[2:]] == [0.0, 0.0, 1.0]
    spans = spark.createDataFrame([("f", "governed by Delaware law", ["cats"], [0.8]), ("f", "net thirty days", ["dogs"], [0.2]), ("f", "x", [], None)], "f string, a string, c array<string>, s array<double>")
    assert fields.category_presence(spans, ["f"], "a", "c", similarities="s").first().n_matched == 1 and fields.category_presence(spans, ["f"], "a", "c").first().n_matched == 0


ROWS = [
    ("s", "license", "license", True, True, True, 0.9, dt.datetime(2025, 1, 2), "m2", "v2", 10), ("s", "license", "supply", False, False, True, None, dt.datetime(2025, 1, 1), "m1", "v1", None),
    ("s", "agency", "other", None, None, None, 0.5, None, None, None, 5), ("", "agency", "other", True, True, True, 0.5, None, None, None, 1), (None, None, None, None, None, None, None, None, None, None, None),
]
ROW_SCHEMA = "session string, expected_subtype string, contract_subtype string, subtype_ok boolean, subtype_ok_equiv boolean, doc_type_ok boolean, confidence double, received_at timestamp, model string, prompt_version string, prompt_tokens bigint"


def test_run_records_and_their_log(spark):
    df = spark.createDataFrame(ROWS, ROW_SCHEMA)
    rows = runs.run_records(df, model="model", prompt_version="prompt_version").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.session, r.n_rows, r.model, r.prompt_version, r.timestamp) == ("s", 3, "m1", "v1", dt.datetime(2025, 1, 1))
    assert (r.exact_match, r.subtype_accuracy, r.confidence, r.n_failed, r.prompt_tokens) == (0.6667, 0.3333, 0.7, 2, 15)
    assert r.mode_counts.family_confusion == 1 and r.mode_counts.function_over_form == 1 and r.subtype_accuracy_ci.lo <= 0.3333 <= r.subtype_accuracy_ci.hi
    assert {k: (v.correct, v.total) for k, v in r.per_subtype.items()} == {"license": (1, 2), "agency": (0, 1)}
    assert sum(c.n for c in r.confusion) == 3
    wide = export.export_frame(runs.as_log_records(runs.run_records(df, model="model", prompt_version="prompt_version")), "raw", export.sorter_columns(), task="subtype_classification").first()
    assert (wide["Experiment Name"], wide["SAMPLE (n)"], wide["MODEL"], wide["Prompt Version"], wide["Failures: family_confusion"], wide["n Total: license"], wide["Prompt Tokens"]) == ("s", 3, "m1", "v1", 1, 2, 15)
    assert str(wide["DATE"]) == "2025-01-01" and wide["Subtype Accuracy CI (lo)"] == r.subtype_accuracy_ci.lo
    assert runs.run_records(df.limit(0)).count() == 0


def test_lag_in_blocks_against_one_window(spark):
    from pyspark.sql import Window

    df = spark.range(400).selectExpr("id", "id % 3 g", "cast(id * 37 % 11 as double) d", "cast(id as double) v").withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    order = [F.col("d"), F.col("id")]
    got = with_lag(df.where("g is not null"), "g", F.floor(F.col("d") / 2), order, "v", "before")
    want = df.where("g is not null").withColumn("before", F.lag("v").over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    runs_ = spark.createDataFrame([(1, "a", None, 0.9), (2, "a", dt.datetime(2025, 1, 1), 0.8), (3, "a", dt.datetime(2025, 1, 1), 0.7), (4, None, None, 0.1), (5, "a", None, 0.5)], "id int, g string, d timestamp, m double")
    assert sorted((r.id, r.previous) for r in runs.regressions(runs_, "m", "g", "d", "id").collect()) == [(3, 0.8), (5, 0.9)]


def test_document_bundles_and_more_metrics(spark):
    table = catalog.bundles(spark, {"lease": {"metrics": ["a"], "agents": {"x": ["b"]}}, "bad": {"metrics": ["a"], "agents": {"y": ["nope"]}}})
    metrics = catalog.registry(spark, [{"name": "a", "tier": 0}, {"name": "b", "tier": 1}])
    assert [r.metric for r in catalog.document_bundle(table, metrics, "lease", "x").collect()] == ["a", "b"]
    with pytest.raises(KeyError, match="known"):
        catalog.document_bundle(table, metrics, "none")
    with pytest.raises(KeyError, match="nope"):
        catalog.document_bundle(table, metrics, "bad")
    more = {r.name: r.tier for r in catalog.with_metrics(metrics, [{"name": "b", "tier": 3}, {"name": "c", "tier": "core"}]).collect()}
    assert more == {"a": 0, "b": 3, "c": 1}


def test_settings_overrides():
    s = Settings().configured(field_scoring__match=0.4, coverage=0.9, field_scoring__partial_gt=["x"])
    assert (s.match, s.coverage, s.partial_gt, s.presence) == (0.4, 0.9, frozenset({"x"}), 0.7)
    with pytest.raises(KeyError):
        Settings().configured(no_such=1)
    with pytest.warns(UserWarning, match="no_such"):
        assert Settings.from_mapping({"field_scoring": {"match": 0.3}, "no_such": 1}).match == 0.3


def test_texts(spark):
    row = spark.createDataFrame([(0.1234, None, float("nan"))], "a double, b double, c double").select(*[text.percent(F.col(c)).alias(c) for c in "abc"]).first()
    assert (row.a, row.b, row.c) == ("12.3%", "n/a", "n/a")
    spans = spark.createDataFrame([("One two three four. Five six seven eight; ok\nOne, two three FOUR.",), ("",), (None,)], "t string").select(text.clause_spans(F.array("t")).alias("s")).collect()
    assert spans[0].s == ["One two three four.", "Five six seven eight ok"] and spans[1].s == []


def test_difference_needs_two_values_a_side(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("g", "b", 3.0), ("h", "a", None)], "g string, side string, v double")
    assert stats.bootstrap_difference(df, "side", "a", "b", "g", "v").count() == 0


def test_order_statistics_against_sorting(spark):
    import random
    import statistics

    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), rng.gauss(0, 1e-300), 0.0, -0.0, 5.0, float("inf"), -float("inf"), 1e-310]) for _ in range(301)]
    rows = [("a", v) for v in values] + [(None, v) for v in values[:100]] + [("b", 7.0), ("n", None), ("n", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    keys = sorted(values)
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(keys)], "i int, v double").select("i", bucket_of(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)
    own = {r.g: (r.n, r.low, r.high) for r in at_ranks(df, ["g"], "v", {"low": F.lit(0), "high": F.col("n") - 1}).collect()}
    assert own == {"a": (301, keys[0], keys[-1]), None: (100, min(values[:100]), max(values[:100])), "b": (1, 7.0, 7.0)}
    middle = {r.g: r.m for r in medians(df, ["g"], "v", "m").collect()}
    assert middle["a"] == statistics.median(values) and middle[None] == statistics.median(values[:100]) and middle["b"] == 7.0
    totals = df.groupBy("g").agg(F.count("*").alias("rows"))
    assert {r.g for r in with_medians(totals, df, ["g"], {"v": "m"}).where("m is null").collect()} == {"n"}
    assert medians(df.limit(0), [], "v", "m").count() == 0 and with_medians(df.agg(F.count("*").alias("rows")), df.limit(0), [], {"v": "m"}).first().m is None


def test_drawn_bootstrap_is_that_of_a_list(spark):
    values = [0.1, 0.9, 0.4, 0.7, 0.2]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("one", 9, 1.0), ("g", 9, None)], "g string, o int, v double")
    rows = stats.bootstrap_drawn(df.orderBy(F.rand(1)), "g", "v", "o", n_boot=300).collect()
    assert len(rows) == 1 and (rows[0].lo, rows[0].hi) == stats.interval(values, n_boot=300) and rows[0].n == 5
    assert stats.bootstrap_drawn(df, "g", "v", "o", most=4).count() == 0


def test_frames_of_a_task(spark):
    df = spark.createDataFrame([("s", "Yes", "y"), ("s", "No", "yes"), ("s", "1", "0"), ("s", None, "true")], "session string, expected string, predicted string")
    frames = classify.task_frames(df, "legalbench", ["session"], digits=4)
    assert frames["overall"].first().exact_match == 0.25 and frames["binary"].first().precision == 0.3333
    assert {(r["class"], r.n, r.correct) for r in frames["per_class"].collect()} == {("yes", 2, 1), ("no", 1, 0), ("", 1, 0)}
    assert frames["top_confusions"].count() == 3 and classify.task_frames(df, "multiclass", [])["overall"].first().micro_accuracy == 0.0
    with pytest.raises(ValueError):
        classify.task_frames(df, "chained", [])
