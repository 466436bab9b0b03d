"""Sources, sinks, reports, the stream and the entry points."""

import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaugeworks.__main__ import main
from gaugeworks.runtime import bounded_rows, materialised
from gaugeworks.sources import logs, report, traces
from gaugeworks.streaming.manifest import read_manifest, start_scorecard

DATA = "/root/testdata/sf0.001"


def test_entry_points(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {f"p{n}_found" for n in (1, 3, 5, 6, 7)} <= set(queries)
    assert entry.entry(spark).count() > 0


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t1"), ("b", "t2")], "name string, task string")
    logs.append_records(rows, str(tmp_path / "log"))
    logs.append_records(rows.withColumn("timestamp", F.lit("2025")), str(tmp_path / "log"))
    back = logs.read_records(spark, str(tmp_path / "log"), "name string, task string, timestamp string", "t1")
    assert back.count() == 2 and back.where("timestamp is null").count() == 0
    (tmp_path / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception):
        logs.read_records(spark, str(tmp_path / "bad.json"), "name string").collect()


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<b&\x01", 1.5, None), ("ü", 2.0, "x")], "name string, score double, note string")
    path = str(tmp_path / "out.xlsx")
    logs.write_workbook(path, df, "Eval Results", [("score", "double", "d", "s", "1")])
    back = logs.read_sheet(spark, path, "eval results")
    assert [tuple(r) for r in back.collect()] == [("a<b&", 1.5, None), ("ü", 2.0, "x")]
    assert logs.read_sheet(spark, path, "Codebook").count() == 1
    with pytest.raises(KeyError):
        logs.read_sheet(spark, path, "none")
    logs.write_codebook(str(tmp_path / "book.csv"), [("a", "b", 'say "x"\nand y', "", "")])
    assert logs.read_codebook(spark, str(tmp_path / "book.csv")).first()["description"] == 'say "x"\nand y'
    assert logs.workbook_kind(["Subtype Accuracy"]) == "sorter" and logs.workbook_kind(["x"]) == "unknown"


@pytest.fixture
def server():
    calls = {"n": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            calls["n"] += 1
            if calls["n"] == 2:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            if "page=" not in self.path:
                self.send_response(200)
                self.end_headers()
                return
            page = int(self.path.split("page=")[1].split("&")[0])
            data = [{"id": f"t{page}-{i}", "sessionId": "s1", "timestamp": "2025-01-01T00:00:00Z", "input": {"filename": "f"}, "output": {"sorter": {"doc_type": "contract", "expected_subtype": "license", "contract_subtype": "license", "doc_type_ok": True, "subtype_ok": page != 3, "confidence": 0.9}}} for i in range(2)]
            body = json.dumps({"data": data, "meta": {"totalPages": 3}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_trace_source(spark, server, tmp_path):
    spark.dataSource.register(traces.TraceSource)
    load = lambda **o: spark.read.format("gaugeworks_traces").options(url=server, page_size=2, pages_per_task=2, min_interval=0, **o).load()
    rows = traces.sorter_rows(load())
    assert rows.count() == 6 and rows.where("subtype_ok").count() == 4
    assert load(max_items=3).count() == 3
    assert traces.available(server) and not traces.available("http://127.0.0.1:9")
    assert main(["sync", server, str(tmp_path / "runs")]) == 0
    assert spark.read.parquet(str(tmp_path / "runs")).first().n_rows == 6
    sheet = logs.read_sheet(spark, str(tmp_path / "runs.xlsx"), "Eval Results").first()
    assert (sheet["Experiment Name"], sheet["SAMPLE (n)"], sheet["Subtype Accuracy"]) == ("s1", 6.0, 0.6667)
    assert logs.read_codebook(spark, str(tmp_path / "runs-codebook.csv")).count() == 114
    assert len(traces.TraceReader({"url": server, "page_size": "2"}).partitions()) == 1  # one task keeps the interval


def test_report_and_commands(spark, tmp_path):
    table = f"{DATA}/eval_results.parquet"
    found = report.interpret(spark.read.parquet(table), target=0.99)
    assert found.by_severity("warning") and "winner" in found.rendered()
    assert report.interpret(spark.range(1)).notes[0].severity == "warning"
    assert main(["analyze", table, "--out", str(tmp_path / "r.md")]) == 0 and "## Leaders" in (tmp_path / "r.md").read_text()
    assert main(["export", table, str(tmp_path / "r.xlsx")]) == 0


def test_stream(spark, tmp_path):
    lines = [{"agent": "a", "metric": "m", "value_num": v, "ts": t} for v, t in ((1.0, 0.0), (3.0, 60.0), (5.0, 30 * 86400.0))]
    (tmp_path / "in").mkdir()
    for i, x in enumerate(lines):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(x) + "\n")
    for _ in range(2):
        start_scorecard(read_manifest(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        (tmp_path / "in" / "9.json").write_text(json.dumps({"agent": "b", "metric": "m", "value_num": 1.0, "ts": 60 * 86400.0}) + "\n")
    got = [(r.agent, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert ("a", 2, 4.0) in got and len(got) == len(set(got))


def test_bounds(spark):
    with pytest.raises(ValueError):
        bounded_rows(spark.range(11), 10, "rows")
    assert materialised(spark.range(3), "x").count() == 3


def test_export_columns(spark):
    from gaugeworks.operators import export

    sorter, extraction = export.sorter_columns({"q/a": "Q A"}), export.extraction_columns()
    assert len(sorter) == len({h for h, _ in sorter}) == 114 and len(extraction) == len({h for h, _ in extraction}) == 141
    record = {"timestamp": "2025-01-05T10:00:00Z", "model": "q/a", "prompt_versions": {"sorter": "sorter_v7"}, "n_rows": 5, "n_ok": 4, "tokens": {"total_tokens": 9}, "scores": {"sorter": {"per_subtype": {"license": {"accuracy": 0.5}}}, "hallucination_rate": {"parties": 0.5, "term_length": 0.1}}}
    df = spark.createDataFrame([(json.dumps(record),), ("{broken",), (None,)], "raw string")
    row = export.export_frame(df, "raw", sorter).collect()
    assert len(row) == 1 and row[0]["MODEL"] == "Q A" and row[0]["Prompt Version"] == "v7" and row[0]["Rows Failed"] == 1 and row[0]["Accuracy: license"] == 0.5 and row[0]["Total Tokens"] == 9
    assert export.export_frame(df, "raw", extraction).first()["Hallucination Rate (avg)"] == pytest.approx(0.3)


def test_config(tmp_path, monkeypatch):
    from gaugeworks.sources.config import TraceConfig, load_profiles

    path = tmp_path / "env"
    path.write_text("# keys\nexport TRACES_URL='http://x'\nTRACES_PUBLIC_KEY=a\nTRACES_SECRET_KEY=b\n\n")
    monkeypatch.setenv("TRACES_PUBLIC_KEY", "shell")
    assert TraceConfig.load(str(path)).options() == {"url": "http://x", "public_key": "shell", "secret_key": "b"}
    assert TraceConfig.load(str(tmp_path / "none")) is None
    (tmp_path / "p.yaml").write_text("profiles:\n  sorter:\n    doc_bundle: contracts\n")
    assert load_profiles({"sorter": {"tasks": ["t"]}}, str(tmp_path / "p.yaml"))["sorter"] == {"tasks": ["t"], "doc_bundle": "contracts"}


def test_runs_from_every_kind_of_file(spark, tmp_path):
    from gaugeworks.operators import export

    def record(i, task="subtype_classification"):
        score = {"subtype_accuracy": 0.9 - i / 10, "failure_insights": {"n_failed": i, "mode_counts": {"family_confusion": i}}, "per_subtype": {"license": {"accuracy": 0.5 + i / 10}}}
        return {"task": task, "experiment_name": f"run{i}", "model": f"m{i % 2}", "prompt_version": f"sorter_v{i % 2}", "timestamp": f"2025-01-0{i + 1}T00:00:00Z", "n_rows": 40 + i, "scores": {"sorter": score, "overall_extraction_score": 0.5}}

    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(record(i)) for i in range(4)] + ["", json.dumps(record(5, "contract_entity_extraction"))]))
    log = str(tmp_path / "log.jsonl")
    assert main(["export", log, str(tmp_path / "sorter.xlsx")]) == 0 and main(["export", log, str(tmp_path / "sweep"), "--kind", "sweep"]) == 0
    assert main(["export", log, str(tmp_path / "ex.xlsx"), "--kind", "extraction"]) == 0
    assert logs.read_sheet(spark, str(tmp_path / "ex.xlsx"), "Eval Results").first()["Experiment Name"] == "run5"
    back = logs.read_sheet(spark, str(tmp_path / "sweep" / "model_sweep.xlsx"), "Eval Results")
    assert sorted(r["Experiment Name"] for r in back.collect()) == ["run0", "run2"]
    for path in (log, str(tmp_path / "sorter.xlsx")):
        assert main(["analyze", path, "--out", str(tmp_path / "r.md"), "--target", "0.95"]) == 0
        text = (tmp_path / "r.md").read_text()
        assert "run0 with 90.0 %" in text and "5.0 % short" in text and "only 40 documents" in text and "family_confusion leads with 6 of 6" in text and "weakest is license" in text
        assert all(f"## {t}" in text for t in ("Leaders", "Models", "Failure modes", "Subtypes", "Hotspots", "Reliability", "Regressions"))
    assert main(["analyze", log, "--kind", "extraction", "--out", str(tmp_path / "r.md")]) == 0 and "run5 with 50.0 %" in (tmp_path / "r.md").read_text()
    lines = spark.read.text(log).selectExpr("monotonically_increasing_id() id", "value")
    noted = export.sweep_frame(lines, "value", "id", notes={"run2": "again"}).collect()
    assert {r["Experiment Name"]: r["Notes"] for r in noted} == {"run0": None, "run2": "again"}
    assert export.sweep_frame(lines.limit(0), "value", "id").count() == 0


def test_single_reads_spans_and_score_sink(spark, tmp_path):
    import io
    import urllib.error

    class Answer(io.BytesIO):
        status = 200

    sent = []

    def opener(request, timeout=None):
        url = request if isinstance(request, str) else request.full_url
        if "spans" in url:
            return Answer(json.dumps({"data": [{"name": "a", "context": {"span_id": "1", "trace_id": "t"}, "status_code": "OK"}, {"name": "b", "span_id": "2", "status": "ERROR"}]}).encode())
        return Answer(b'{"id": "x y"}')

    def down(request, timeout=None):
        raise urllib.error.URLError("down")

    assert traces.one("http://h", "sessions", "x y", opener=opener) == {"id": "x y"}
    rows = traces.spans(spark, "http://h", "p q", opener=opener).orderBy("name").collect()
    assert [(r.span_id, r.trace_id, r.status) for r in rows] == [("1", "t", "OK"), ("2", None, "ERROR")]
    assert traces.spans(spark, "http://h", "p", limit=1, opener=opener).count() == 1 and traces.spans(spark, "http://h", "p", opener=down) is None
    scores = spark.createDataFrame([("t1", "m", 1.0, None), ("t2", "m", 2.0, "c"), (None, "m", 3.0, None)], "trace_id string, name string, value double, comment string")

    def post(url, auth, body):
        if json.loads(body)["traceId"] == "t1":
            raise OSError("refused")

    assert traces.send_scores(scores, "http://h", None) == 0
    assert traces.send_scores(scores, "http://h", ("a", "b"), post) == 1 and not sent


def test_manifest_checks_metrics_before_writing(spark, tmp_path):
    metrics = spark.createDataFrame([("m", 0)], "name string, tier int")
    scores = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 2.0)], "agent string, metric string, value_num double")
    with pytest.raises(ValueError, match="n"):
        logs.emit_scores(scores, metrics, str(tmp_path / "m"))
    assert not (tmp_path / "m").exists()
    logs.emit_scores(scores.where("metric = 'm'"), metrics, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first().value == '{"agent":"a","metric":"m","value_num":1.0}'
    assert logs.read_scores(spark, str(tmp_path / "m")).first().metric == "m"


def test_sheet_bound(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s.xlsx")
    logs.write_workbook(path, spark.range(5).toDF("x"), "S")
    monkeypatch.setattr(logs, "SHEET_LIMIT", 4)
    with pytest.raises(ValueError, match="more than"):
        logs.read_sheet(spark, path, "S")


def test_snapshot_default_path_and_day(spark, tmp_path, monkeypatch):
    import subprocess

    from pyspark.sql import functions as F

    assert logs.git_snapshot(str(tmp_path)) == {}
    for words in (["init", "-q"], ["-c", "user.name=n", "-c", "user.email=e", "commit", "-q", "--allow-empty", "-m", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *words], check=True)
    (tmp_path / "new").write_text("x")
    found = logs.git_snapshot(str(tmp_path))
    assert len(found["commit"]) == 40 and found["changed"] is True
    monkeypatch.setenv("GAUGEWORKS_LOG", "/x/y.jsonl")
    assert logs.default_log() == "/x/y.jsonl"
    monkeypatch.delenv("GAUGEWORKS_LOG")
    assert logs.default_log().endswith("runs.jsonl")
    df = spark.createDataFrame([("2025-01-05T23:30:00-05:00",), ("soon",), (None,)], "t string")
    assert [str(r.d) for r in df.select(logs.record_day(F.col("t")).alias("d")).collect()] == ["2025-01-06", "None", "None"]


def test_sweep_notes_of_any_number_of_experiments(spark, tmp_path):
    def raw(name, task="subtype_classification"):
        return F.to_json(F.struct(F.lit(task).alias("task"), name.alias("experiment_name"), F.lit("sorter_v1").alias("prompt_version")))

    many = spark.range(20_500).select(F.col("id").alias("rec_id"), raw(F.concat(F.lit("loam-é_"), (F.col("id") % 10_250 + 10_000).cast("string"))).alias("raw"))
    few = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(30_000 + i).cast("bigint").alias("rec_id"), r.alias("raw")) for i, r in enumerate([raw(F.lit("quill_1")), raw(F.lit(None).cast("string")), raw(F.lit("loam_x"), "extraction"), F.lit('{"task"')])])).alias("r")).select("r.*")
    many.union(few).write.parquet(str(tmp_path / "experiment_log.parquet"))
    got = entry.queries()["sweep_with_notes"](spark, str(tmp_path))
    assert got.columns == ["rec_id", "Experiment Name", "Prompt Version", "Subtype Accuracy", "Notes"]
    assert {(r.Notes, r["count"]) for r in got.groupBy("Notes").count().collect()} == {("seen 12", 20_500), (None, 2)}
    assert {r.rec_id for r in got.where("Notes is null").collect()} == {30_000, 30_001} and got.select("rec_id").distinct().count() == 20_502


def test_frame_keys_of_odd_names_and_scores(spark, tmp_path):
    found = {"m_v1\n": None, "m_v1\r": None, "m_v1_x\n": None, "m_v1_a_b\rc": "v1", "m_v1_a_b\u2028c": "v1", "\u00a0m_v1\u3000": "v1", "\tm_v1": None, "m_v1_a_b\nc": None, "x_sorter_v2\n": "v2"}
    rows = [(i, name, "m", None, 1, 0.5) for i, name in enumerate(found)] + [(90, "m_v1", None, None, 1, float("nan")), (91, None, "m", None, 1, None)]
    spark.createDataFrame(rows, "result_id bigint, experiment_name string, model string, run_date timestamp, sample_n bigint, subtype_accuracy double").write.parquet(str(tmp_path / "eval_results.parquet"))
    got = {r.result_id: r for r in entry.queries()["frame_keys"](spark, str(tmp_path)).collect()}
    assert {name: got[i].version for i, name in enumerate(found)} == found
    assert {name: got[i].key for i, name in enumerate(found)} == {name: f"m_{v or '?'}" for name, v in found.items()}
    assert math.isnan(got[90].percent) and got[90].key == "?_v1" and got[91].percent is None and got[0].percent == 50.0
