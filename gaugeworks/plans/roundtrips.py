"""Queries of sources and sinks: what a sink wrote into the shared folder is read back by the
source, and compared with the table it came from. They add to the registry of
:mod:`gaugeworks.plans.reference`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import catalog, export, runs
from gaugeworks.plans.reference import _M, _OK, _RUNS, QUERIES, query
from gaugeworks.runtime import bounded_rows, fresh_path, table
from gaugeworks.settings import Settings
from gaugeworks.sources import config, logs, report, traces
from gaugeworks.streaming import manifest

__all__ = ["QUERIES"]

_LOG = "experiment_log WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'"
_RECORD = "task string, experiment_name string, model string, n_rows string"
_RECORD_SQL = ", ".join(f"json_extract_string(raw, '$.{c.split()[0]}') {c.split()[0]}" for c in _RECORD.split(", "))


def _lines(spark: SparkSession, base: str) -> str:
    """The whole records of the log, written as a log is."""
    path = fresh_path(spark, "log")
    whole = table(spark, base, "experiment_log").where(F.try_parse_json("raw").isNotNull())
    whole.select(F.regexp_replace("raw", r"[\r\n]+", " ").alias("value")).write.text(path)
    return path


@query("source_records", f"SELECT {_RECORD_SQL} FROM {_LOG}")
def _(spark, base):
    return logs.read_records(spark, _lines(spark, base), _RECORD)


@query("source_records_of_a_task", f"SELECT {_RECORD_SQL} FROM {_LOG} AND json_extract_string(raw, '$.task') = 'extraction'")
def _(spark, base):
    return logs.read_records(spark, _lines(spark, base), _RECORD, "extraction")


@query("sink_append_records", f"SELECT experiment_name, model, CAST(sample_n AS VARCHAR) n_rows, true stamped FROM {_RUNS} UNION ALL SELECT 'more', NULL, NULL, true")
def _(spark, base):
    path = fresh_path(spark, "records")
    logs.append_records(table(spark, base, _RUNS).select("experiment_name", "model", F.col("sample_n").alias("n_rows")), path)
    logs.append_records(spark.createDataFrame([("more",)], "experiment_name string"), path)
    back = logs.read_records(spark, path, "experiment_name string, model string, n_rows string, timestamp string")
    return back.select("experiment_name", "model", "n_rows", F.to_date("timestamp").isNotNull().alias("stamped"))


def _manifest(spark: SparkSession, base: str) -> str:
    path = fresh_path(spark, "manifest")
    scores = table(spark, base, "score_records").select("agent", "metric", "value_num", "value_str", "doc_id", "run_id", "metadata", F.col("seq").cast("double").alias("ts"), "seq")
    logs.emit_scores(scores, table(spark, base, "metric_defs"), path)
    return path


@query("sink_manifest", "SELECT seq, agent, metric, value_num, value_str, doc_id, run_id, seq::DOUBLE ts, cardinality(metadata)::BIGINT n_metadata FROM score_records")
def _(spark, base):
    back = logs.read_scores(spark, _manifest(spark, base))
    size = F.when(F.col("metadata").isNotNull(), F.size("metadata").cast("bigint"))
    return back.select("seq", "agent", "metric", "value_num", "value_str", "doc_id", "run_id", "ts", size.alias("n_metadata"))


@query("stream_manifest", "SELECT agent, metric, count(*) n, round(sum(value_num), 6) total FROM score_records WHERE seq // 3600 < (SELECT max(seq) FROM score_records) // 3600 GROUP BY 1, 2")
def _(spark, base):
    """The streaming scorecard run to its end; the newest hour is still open, as its watermark says."""
    path, target = _manifest(spark, base), fresh_path(spark, "windows")
    running = manifest.start_scorecard(manifest.read_manifest(spark, path), target, fresh_path(spark, "state"), late="0 seconds")
    running.awaitTermination()
    rows = spark.read.schema("window struct<start: timestamp, end: timestamp>, agent string, metric string, n bigint, total double, mean double").parquet(target)
    return rows.groupBy("agent", "metric").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"))


@query("workbook_sheet", "SELECT site_id::DOUBLE site_id, site_name, tz_name, locale, duration_unit, date_scale FROM sites")
def _(spark, base):
    path = f"{fresh_path(spark, 'book')}/book.xlsx"
    logs.write_workbook(path, table(spark, base, "sites"), "Sites", [("a", "b", "c", "d", "e")])
    return logs.read_sheet(spark, path, "SITES")


@query("workbook_codebook", "SELECT column_name AS \"column\", CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE 'int' END AS type FROM (DESCRIBE sites)")
def _(spark, base):
    path, sites = f"{fresh_path(spark, 'book')}/book.xlsx", table(spark, base, "sites")
    logs.write_workbook(path, sites, "Sites", [(f.name, f.dataType.simpleString(), "", "", "") for f in sites.schema])
    return logs.read_sheet(spark, path, "Codebook").select("column", "type")


@query("codebook_file", "SELECT site_name AS \"column\", tz_name AS type, 'says \"' || locale || '\", in' || chr(10) || 'two lines' AS description FROM sites")
def _(spark, base):
    path = f"{fresh_path(spark, 'codebook')}/codebook.csv"
    sites = bounded_rows(table(spark, base, "sites"), 10_000, "sites")
    logs.write_codebook(path, [(r.site_name, r.tz_name, f'says "{r.locale}", in\ntwo lines', "", "") for r in sites], spark)
    return logs.read_codebook(spark, path).select("column", "type", "description")


_V = "regexp_replace(coalesce(json_extract_string(raw, '$.prompt_versions.sorter'), json_extract_string(raw, '$.prompt_version')), '^(?:sorter_|contracts_specialist_|legalbench_task_)', '')"
_SORTER_ROWS = f"SELECT rec_id, json_extract_string(raw, '$.experiment_name') n, {_V} v, TRY_CAST(json_extract_string(raw, '$.scores.sorter.subtype_accuracy') AS DOUBLE) a, CAST(trunc(TRY_CAST(json_extract_string(raw, '$.n_rows') AS DOUBLE)) AS BIGINT) r FROM {_LOG} AND json_extract_string(raw, '$.task') = 'subtype_classification'"


@query("sink_sweep_workbook", f"SELECT n AS \"Experiment Name\", v AS \"Prompt Version\", a AS \"Subtype Accuracy\" FROM ({_SORTER_ROWS}) WHERE v IS NOT DISTINCT FROM (SELECT v FROM ({_SORTER_ROWS}) ORDER BY coalesce(a, 0) DESC, coalesce(r, 0) DESC, rec_id LIMIT 1)")
def _(spark, base):
    folder = fresh_path(spark, "sweep")
    path, _n = logs.write_sweep(table(spark, base, "experiment_log"), "raw", "rec_id", folder)
    return logs.read_sheet(spark, path, "Eval Results").select("Experiment Name", F.col("Prompt Version").cast("string").alias("Prompt Version"), F.col("Subtype Accuracy").cast("double").alias("Subtype Accuracy"))


# -- traces, from pages saved as a server gives them ---------------------------------------
PAGE = 500


def _pages(spark: SparkSession, base: str, kind: str, items: DataFrame, order: str) -> str:
    """Pages of ``items`` (order, item) as files in the shared folder; returns its URL."""
    folder = fresh_path(spark, kind)
    if not folder.startswith("file:"):
        raise ValueError("saved pages must lie in a folder that workers can open as files")
    low, last = items.agg(F.min(order), F.max(order)).first()
    if low is not None and low < 0:
        raise ValueError("places must not be negative")
    numbered = items.withColumn("page", F.floor(F.col(order) / PAGE) + 1)
    pages = numbered.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(order, "item"))).alias("rows"))  # PAGE items each
    total = 1 if last is None else last // PAGE + 1
    head = spark.createDataFrame([(p,) for p in range(1, total + 1)], "page bigint")
    body = F.to_json(F.struct(F.coalesce(F.col("rows.item"), F.array()).alias("data"), F.struct(F.lit(total).alias("totalPages")).alias("meta")))

    def save(batches):
        import os

        import pyarrow as pa

        target = folder.removeprefix("file:")
        os.makedirs(target, exist_ok=True)
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(f"{target}/{kind}-{page}.json.part", "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(f"{target}/{kind}-{page}.json.part", f"{target}/{kind}-{page}.json")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    if head.join(pages, "page", "left").select("page", body.alias("body")).mapInArrow(save, "n bigint").agg(F.sum("n")).first()[0] != total:
        raise RuntimeError("pages are missing")
    return folder




_TRACES = """SELECT row_id, session, filename, trace_id, expected_subtype, contract_subtype, coalesce(subtype_ok, false) subtype_ok, coalesce(subtype_ok_equiv, false) subtype_ok_equiv,
    coalesce(doc_type_ok, false) doc_type_ok, confidence FROM sorter_rows"""


def _trace_items(spark: SparkSession, base: str) -> DataFrame:
    output = F.struct("expected_subtype", "contract_subtype", "subtype_ok", "subtype_ok_equiv", "doc_type_ok", "confidence", F.lit("contract").alias("doc_type"))
    item = F.struct(
        F.col("trace_id").alias("id"), F.lit("sorter").alias("name"), F.col("session").alias("sessionId"), F.col("received_at").cast("string").alias("timestamp"),
        F.struct("filename", F.col("row_id").cast("string").alias("model")).alias("input"), F.struct(output.alias("sorter")).alias("output"),
    )
    return table(spark, base, "sorter_rows").select("row_id", item.alias("item"))


@query("source_traces", _TRACES)
def _(spark, base):
    url = _pages(spark, base, "traces", _trace_items(spark, base), "row_id")
    rows = traces.sorter_rows(traces.list_traces(spark, url, pages_per_task=20, min_interval=0))
    return rows.select(F.col("model").cast("bigint").alias("row_id"), "session", "filename", "trace_id", "expected_subtype", "contract_subtype", "subtype_ok", "subtype_ok_equiv", "doc_type_ok", "confidence")


@query("source_scores", "SELECT seq::VARCHAR id, doc_id trace_id, metric AS name, value_num, CASE WHEN value_num IS NULL THEN value_str END value_str FROM score_records")
def _(spark, base):
    item = F.struct(F.col("seq").cast("string").alias("id"), F.col("doc_id").alias("traceId"), F.col("metric").alias("name"), F.col("value_num").alias("value"), F.col("value_str").alias("stringValue"))
    url = _pages(spark, base, "scores", table(spark, base, "score_records").select("seq", item.alias("item")), "seq")
    return traces.list_scores(spark, url, pages_per_task=20, min_interval=0).select("id", "trace_id", "name", "value_num", "value_str")


@query(
    "sync_sessions",
    """SELECT session AS "Experiment Name", count(*)::BIGINT AS "SAMPLE (n)", round(avg(coalesce(doc_type_ok, false)::INT), 4) AS "Doc Type Accuracy", round(avg(coalesce(subtype_ok, false)::INT), 4) AS "Subtype Accuracy",
      round(avg(confidence), 4) AS "Average Confidence" FROM sorter_rows WHERE coalesce(session <> '', false) GROUP BY session""",
)
def _(spark, base):
    """Delivered rows to run records, to log lines, to the columns of the workbook."""
    log = runs.as_log_records(runs.run_records(table(spark, base, "sorter_rows")))
    wide = export.export_frame(log, "raw", export.sorter_columns(), task="subtype_classification")
    return wide.select("Experiment Name", "SAMPLE (n)", "Doc Type Accuracy", "Subtype Accuracy", "Average Confidence")


# -- small tables from mappings ---------------------------------------------------------
_ENTRIES = [{"name": "a", "tier": "headline"}, {"name": "b", "tier": 2, "agents": ["x", "y"]}, {"name": "c", "tier": "3", "aggregation": "sum"}]


@query("registry_rows", "SELECT * FROM (VALUES ('a', 0::INT, 'mean', 'ALL'), ('b', 2, 'mean', 'x,y'), ('c', 3, 'sum', 'ALL')) t(name, tier, aggregation, agents)")
def _(spark, base):
    return catalog.registry(spark, _ENTRIES).select("name", "tier", "aggregation", F.array_join("agents", ",").alias("agents"))


@query("registry_with_more", "SELECT name, tier, aggregation FROM metric_defs WHERE name <> (SELECT min(name) FROM metric_defs) UNION ALL SELECT min(name), 0::INT, 'none' FROM metric_defs UNION ALL SELECT 'new_metric', 1::INT, 'sum'")
def _(spark, base):
    metrics = table(spark, base, "metric_defs")
    name = metrics.agg(F.min("name")).first()[0]
    more = [{"name": name, "tier": 0, "aggregation": "none"}, {"name": "new_metric", "tier": 1, "aggregation": "sum"}]
    return catalog.with_metrics(metrics, more).select("name", "tier", "aggregation")


_DOC_BUNDLES = {"lease": {"metrics": ["family_hit", "grounding"], "agents": {"auditor": ["clause_agree"]}}, "charter": {"metrics": ["span_cover"]}}


@query("document_bundle", "SELECT * FROM (VALUES ('family_hit', 0::INT), ('grounding', 1), ('clause_agree', 10000)) t(metric, pos)")
def _(spark, base):
    return catalog.document_bundle(catalog.bundles(spark, _DOC_BUNDLES), table(spark, base, "metric_defs"), "lease", "auditor")


@query("bundle_gaps", "SELECT * FROM (VALUES ('lease', 'no_such_metric')) t(bundle, metric)")
def _(spark, base):
    broken = _DOC_BUNDLES | {"lease": {"metrics": ["family_hit"], "agents": {"auditor": ["no_such_metric"]}}}
    return catalog.invalid_bundle_metrics(catalog.bundles(spark, broken), table(spark, base, "metric_defs")).select("bundle", "metric")


@query("resolved_bundles", "SELECT * FROM (VALUES ('by type', 'L'), ('by profile', 'own'), ('by task', 'T'), ('fallback', 'F')) t(how, bundle)")
def _(spark, base):
    profiles = config.load_profiles({"a": {"doc_bundle": "own"}, "b": {"tasks": ["x", "y"]}, "c": {"fallback_bundle": "F"}})
    rows = [
        ("by type", catalog.resolve_bundle(profiles["a"], "lease", {"lease": "L"}, {})), ("by profile", catalog.resolve_bundle(profiles["a"], None, {}, {})),
        ("by task", catalog.resolve_bundle(profiles["b"], None, {}, {"y": "T"})), ("fallback", catalog.resolve_bundle(profiles["c"], None, {}, {}, True)),
    ]
    return spark.createDataFrame(rows, "how string, bundle string")


@query("settings_rows", "SELECT * FROM (VALUES ('match', 0.5::DOUBLE), ('coverage', 0.8), ('rescue_below', 0.7)) t(name, value)")
def _(spark, base):
    s = Settings.from_mapping({"field_scoring": {"match": 0.9}, "coverage": 0.8}).configured(field_scoring__match=0.5)
    return spark.createDataFrame([(n, float(getattr(s, n))) for n in ("match", "coverage", "rescue_below")], "name string, value double")


# -- reports -----------------------------------------------------------------------
@query("report_table", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation")
def _(spark, base):
    lines = report.markdown_table(table(spark, base, "nation").select("n_nationkey", "n_name")).split("\n")
    return spark.createDataFrame([(x,) for x in lines[2:]], "line string")


@query("report_winner", f"SELECT 'winner' AS topic, 'info' AS severity, experiment_name AS run FROM {_RUNS} WHERE {_OK} ORDER BY {_M} DESC, sample_n DESC NULLS LAST, result_id LIMIT 1")
def _(spark, base):
    notes = [n for n in report.interpret(table(spark, base, _RUNS)).notes if n.topic == "winner"]
    return spark.createDataFrame([(n.topic, n.severity, n.text.split(" with ")[0]) for n in notes], "topic string, severity string, run string")
