import json

from gaugeworks.operators.drift import cast_value, changes, file_schemas, leftovers, meanings, paths_of, schema_changes, united
from gaugeworks.plans.drifting import RUN_WORDS
from gaugeworks.operators.ordering import with_previous


def schema(record):
    return tuple(sorted(paths_of(record, frozenset({"scores"}))))


BASE = {"task": "x", "n_rows": 50, "prompt_versions": {"sorter": "sorter_v3", "extractor": "extractor_v9"},
        "tokens": {"sorter": {"prompt_tokens": 100, "completion_tokens": 20, "total_tokens": 120, "cost_usd": 0.1}}}


def changed(edit):
    after = json.loads(json.dumps(BASE))
    edit(after)
    return changes(schema(BASE), schema(after), RUN_WORDS)


def test_kinds_of_change():
    assert changed(lambda r: r.update(extra=1)) == [("added", "", "extra")]
    assert changed(lambda r: r.pop("n_rows")) == [("removed", "n_rows", "")]
    assert changed(lambda r: r.update(n_rows="50")) == [("retyped", "n_rows", "n_rows")]
    assert changed(lambda r: r.update(n_docs=r.pop("n_rows"))) == [("renamed", "n_rows", "n_docs")]
    assert changed(lambda r: r.update(usage=r.pop("tokens"))) == [("renamed", "tokens", "usage")]
    assert changed(lambda r: r["tokens"].update(classifier=r["tokens"].pop("sorter"))) == [("renamed", "tokens.sorter", "tokens.classifier")]
    assert changed(lambda r: r["tokens"].update(total_tokens=r["tokens"]["sorter"].pop("total_tokens"))) == [("renamed", "tokens.sorter.total_tokens", "tokens.total_tokens")]
    assert changed(lambda r: r.update(prompt_version=r["prompt_versions"].pop("sorter"))) == [("renamed", "prompt_versions.sorter", "prompt_version")]
    assert changed(lambda r: r.update(prompt_versions=json.dumps(r["prompt_versions"]))) == [("retyped", "prompt_versions", "prompt_versions")]
    assert changed(lambda r: r["tokens"]["sorter"].update(cached_tokens=r["tokens"]["sorter"].pop("completion_tokens"))) == [
        ("added", "", "tokens.sorter.cached_tokens"), ("removed", "tokens.sorter.completion_tokens", ""),
    ]
    assert changed(lambda r: r.update(scores={"a": 1}, other=None)) == []


def log(spark, rows):
    return spark.createDataFrame(rows, "rec_id int, stream int, seq int, file int, raw string")


def test_report_and_table(spark):
    second = json.loads(json.dumps(BASE))
    second["n_docs"] = "1,250"
    del second["n_rows"]
    rows = [(1, 1, 1, 10, json.dumps(BASE)), (2, 1, 1, 10, json.dumps(BASE)), (3, 1, 3, 11, json.dumps(second)), (4, 1, 3, 11, "{broken"), (5, 2, 1, 12, json.dumps(second)), (6, None, 1, 13, json.dumps(BASE)), (7, 3, 1, 14, None)]
    df = log(spark, rows)
    schemas = file_schemas(df, "stream", "seq", "file", "raw")
    report = schema_changes(schemas, RUN_WORDS)
    assert [tuple(r) for r in report.collect()] == [(11, "renamed", "n_rows", "n_docs")]
    table = united(df, ["rec_id"], "raw", meanings(schemas, report)).orderBy("rec_id").collect()
    assert [r.rec_id for r in table] == [1, 2, 3, 5, 6]
    values = [r["n_docs"] if "n_docs" in r else r["n_rows"] for r in table]
    assert [float(v.replace(",", "")) if isinstance(v, str) else v for v in values] == [50, 50, 1250, 1250, 50]
    empty = file_schemas(df.limit(0), "stream", "seq", "file", "raw")
    assert schema_changes(empty).count() == 0


def test_cast_values():
    assert cast_value("$1,250.5", "number") == 1250.5
    assert cast_value(["sorter_v12"], "number") == 12
    assert cast_value("n/a", "number") is None
    assert cast_value(3, "text") == "3"
    for value, want in [([1, 2], None), ("3 of 5", None), ("1.5 s", None), ("abc", None), ("v12", None), ("1,25", None), ("1,250", 1250), ("-€ 3", -3), ("1e3", 1000), ("", None), ("[7]", None), ([], None), (True, 1)]:
        assert cast_value(value, "number") == want, value
    assert cast_value([1, 2], "text") == "[1, 2]" and cast_value([1, 2], "list") == "[1, 2]"


def test_previous_in_blocks(spark):
    df = spark.createDataFrame([(1, s) for s in (1, 2, 5, 9, 20)] + [(2, 3), (None, 1)], "p int, s int")
    got = {(r.p, r.s): r.prev_seq for r in with_previous(df, "p", "s", width=4).collect()}
    assert got == {(1, 1): None, (1, 2): 1, (1, 5): 2, (1, 9): 5, (1, 20): 9, (2, 3): None}


def test_table_has_every_field(spark):
    first = {"timestamp": "2026-01-02", "scores": {"acc": 0.5, "per": {"x": 1}}, "parameters": {"stop": [None, "END"]}, "tokens": {"calls": [{"id": 1}]}}
    second = {"timestamp": 1770000000, "scores": {"acc": 0.25, "per": [{"y": 2}, {"z": 3}], "Acc": 7}, "usage": {"calls": []}, "rec_id": 5}
    df = log(spark, [(1, 1, 1, 10, json.dumps(first)), (2, 1, 2, 11, json.dumps(first)), (3, 1, 3, 12, json.dumps(second))])
    schemas = file_schemas(df, "stream", "seq", "file", "raw", skip=())
    report = schema_changes(file_schemas(df, "stream", "seq", "file", "raw"), RUN_WORDS)
    assert ("renamed", "tokens", "usage") in {tuple(r)[1:] for r in report.collect()}
    table = {r.rec_id: r.asDict() for r in united(df, ["rec_id"], "raw", meanings(schemas, report)).collect()}
    assert [(table[i]["timestamp"], table[i]["scores__acc_2"]) for i in (1, 3)] == [("2026-01-02", 0.5), ("1770000000", 0.25)]
    assert (table[1]["scores__per__x"], json.loads(table[3]["scores__per"])) == (1, [{"y": 2}, {"z": 3}])
    assert json.loads(table[1]["parameters__stop"]) == [None, "END"]
    assert json.loads(table[1]["tokens__calls"]) == [{"id": 1}] and table[3]["tokens__calls"] == "[]"
    assert 7 in table[3].values() and 5 in table[3].values()


def test_table_query_keeps_skipped_fields(spark, tmp_path):
    from gaugeworks.plans.drifting import p5_table

    raw = json.dumps({"timestamp": "t", "scores": {"a": 1}, "parameters": {"b": 2}, "calls": 3})
    rows = spark.createDataFrame([(1, 1, 1, 10, raw)], "rec_id int, stream_id int, file_seq int, file_id int, raw string")
    rows.write.parquet(str(tmp_path / "experiment_log.parquet"))
    got = p5_table(spark, str(tmp_path)).first().asDict()
    assert {k: got[k] for k in ("timestamp", "scores__a", "parameters__b", "calls")} == {"timestamp": "t", "scores__a": 1, "parameters__b": 2, "calls": 3}


def test_renaming_found_at_any_number_of_paths():
    """An object with an unlike name whose children match, in files with few and with 400+ paths."""
    inside = {"prompt": 1, "completion": 2, "latency": 3, "currency": "x"}
    for more in (0, 500):
        rest = {f"k{chr(97 + i % 26)}{chr(97 + i // 26)}": {"w": i} for i in range(more)}
        assert changes(schema({"head": 1, "alpha": inside, **rest}), schema({"head": 1, "omega": inside, **rest})) == [("renamed", "alpha", "omega")]


def test_table_keeps_what_has_no_place(spark, tmp_path):
    from gaugeworks.plans.drifting import p5_table

    first, second = {"n_rows": 50, "cost": 1}, {"n_docs": 60, "cost": "n/a"}
    both = {"n_rows": 70, "n_docs": 80, "cost": [1, 2], "empty": {}, "big": 10**400}
    rows = [(1, 1, 1, 10, first), (2, 1, 2, 11, second), (3, 1, 3, 12, both), (4, None, 1, 13, {"only_here": "x"}), (5, 2, None, 14, {"cost": 3}), (6, 3, 1, 15, {"cost": 4}), (7, 4, 1, 16, {"cost": 5})]
    df = log(spark, [(*r[:4], json.dumps(r[4])) for r in rows]).toDF("rec_id", "stream_id", "file_seq", "file_id", "raw")
    df.write.parquet(str(tmp_path / "experiment_log.parquet"))
    got = {r.rec_id: r.asDict() for r in p5_table(spark, str(tmp_path)).collect()}
    assert got[4]["only_here"] == "x" and got[1]["rest"] is None and got[1]["cost"] == 1
    assert json.loads(got[2]["rest"]) == [["cost", "n/a"]] and got[2]["cost"] is None
    rest = json.loads(got[3]["rest"])
    assert ["cost", [1, 2]] in rest and ["empty", {}] in rest and ["big", 10**400] in rest
    assert {got[3].get("n_rows"), got[3].get("n_docs"), *(v for p, v in rest if p in ("n_rows", "n_docs"))} >= {70, 80}


def test_the_probe_of_a_renamed_object_at_any_size():
    for others in (3, 200, 397, 600):
        rest = {f"f{i}": i for i in range(others)}
        before, after = ({key: {"alpha": 1, "beta": "x"}, **rest} for key in ("tokens", "usage_x"))
        assert changes(schema(before), schema(after)) == [("renamed", "tokens", "usage_x")], others


def test_nested_renamings_settle_from_the_outside():
    before = {"outer": {"call_stats": {"leaf_one": 1, "leaf_two": "x"}, "side": {"w": 2}}, "k": 1}
    after = {"shell": {"stats": {"leaf_one": 1, "leaf_two": "x"}, "side": {"w": "2"}}, "k": 1}
    assert changes(schema(before), schema(after)) == [("renamed", "outer", "shell"), ("renamed", "outer.call_stats", "shell.stats"), ("retyped", "shell.side.w", "shell.side.w")]


def test_deep_lines_give_rows(spark):
    deep = '{"o":' * 3000 + "1" + "}" * 3000
    lists = '{"o":' + "[" * 3000 + "]" * 3000 + "}"
    df = log(spark, [(1, 1, 1, 10, deep), (2, 1, 2, 11, lists)])
    assert sorted(r.n for r in file_schemas(df, "stream", "seq", "file", "raw").selectExpr("size(schema) n").collect()) == [1, 3000]
    got = united(df, ["rec_id"], "raw", {"o": ("o", "list")}).collect()
    assert [r.rec_id for r in got] == [1, 2] and got[0].rest is not None and len(got[1].o) == 6000


def test_leftovers_are_counted(spark):
    df = log(spark, [(i, 1, 1, 10, json.dumps({"a": v, "b": {}, "c": 1})) for i, v in enumerate([1, "3 of 5", [1, 2], {"x": 1}])])
    got = {r.path: r.n for r in leftovers(united(df, ["rec_id"], "raw", {"a": ("a", "number"), "c": ("c", "number")})).collect()}
    assert got == {"a": 2, "b": 4, "a.x": 1}
    assert leftovers(united(df.limit(0), ["rec_id"], "raw", {"a": ("a", "number")})).count() == 0
