"""The wide projections of run records for workbooks, generated from a few rules.

A record is parsed once into a VARIANT; every column is a path into it. Headers, their
order and their paths are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.runs import display_model
from gaugeworks.taxonomy import SORTER_TASK, SUBTYPE_LABELS

# Headers and paths that both workbooks have.
HEAD = [("SAMPLE (n)", "n_rows", "bigint"), ("Temperature", "parameters.temperature", "double")]
TOKENS = [
    ("Prompt Tokens", "prompt_tokens", "bigint"), ("Completion Tokens", "completion_tokens", "bigint"), ("Total Tokens", "total_tokens", "bigint"), ("Cost USD", "cost_usd", "double"),
    ("Cost Total USD", "cost_total_usd", "double"), ("Cost Estimated USD", "cost_estimated_usd", "double"), ("Rows with Usage", "rows_with_usage", "bigint"),
]
# The sorter's workbook.
SORTER = [
    ("Doc Type Accuracy", "scores.sorter.exact_match", "double"), ("Subtype Accuracy", "scores.sorter.subtype_accuracy", "double"),
    ("Subtype Accuracy (equiv)", "scores.sorter.subtype_accuracy_equiv", "double"), ("Average Confidence", "scores.sorter.confidence", "double"), ("Rows Completed", "n_ok", "bigint"),
]
SORTER_MODES = ["equivalent_family", "family_confusion", "function_over_form", "other_fallback"]
SORTER_TAIL = [
    ("Reasoning Effort", "parameters.reasoning_effort", "string"), ("Max Tokens", "parameters.max_tokens", "bigint"), ("Max Input Chars", "parameters.max_input_chars", "bigint"),
    ("Max Concurrency", "parameters.max_concurrency", "bigint"), ("Dataset", "data_source.project", "string"), ("n Samples", "data_source.n_samples", "bigint"),
    ("Sample Requested", "data_source.sample_requested", "bigint"), ("Stratified", "data_source.stratified", "string"), ("Seed", "data_source.seed", "bigint"),
]
# The extractor's workbook.
FIELDS = ["document_name", "effective_date", "governing_law", "key_obligations", "parties", "renewal_terms", "term_length", "termination_clauses"]
LISTS = ["key_obligations", "parties", "termination_clauses"]
FIELD_HEADERS = ["doc_name", "effective_date", "governing_law", "key_obligations", "Parties", "Renewal Terms", "Term_Length", "Termination_Clauses"]
DIAGNOSTICS = [
    ("Field Exact Rate", "field_exact_rate"), ("Field Partial Rate", "field_partial_rate"), ("Field Miss Rate", "field_miss_rate"), ("n Fields Scored", "n_fields_scored"),
    ("List Precision", "list_precision"), ("List Recall", "list_recall"), ("List F1", "list_f1"), ("List Micro Precision", "list_micro_precision"), ("List Micro Recall", "list_micro_recall"),
    ("List Micro F1", "list_micro_f1"), ("List Micro Matched", "list_micro_matched"), ("List Micro n Expected", "list_micro_n_expected"), ("List Micro n Predicted", "list_micro_n_predicted"),
]
DATES = [("Date MAE (days)", "date_mae_days"), ("Date Median AE (days)", "date_median_ae_days"), ("Date R2", "date_r2"), ("Date n pairs", "date_n_pairs")]
DURATIONS = [("Duration MAE (days)", "duration_mae_days"), ("Duration Median AE (days)", "duration_median_ae_days"), ("Duration R2", "duration_r2"), ("Duration n pairs", "duration_n_pairs")]
COUNTS = [("Money n pairs", "money_n_pairs"), ("Span Count MAE", "span_count_mae"), ("Span Count n docs", "span_count_n_docs"), ("Span Count Signed Mean", "span_count_signed_mean")]
EXTRACTOR_TAIL = [
    ("Reasoning Effort", "parameters.reasoning_effort", "string"), ("Max Tokens", "parameters.max_tokens", "string"), ("Max Input Chars", "parameters.max_input_chars", "bigint"),
    ("Max Concurrency", "parameters.max_concurrency", "bigint"), ("Chunked", "parameters.chunked", "boolean"), ("Chunk Chars", "parameters.chunk_chars", "string"),
    ("Chunk Overlap", "parameters.chunk_overlap", "bigint"), ("Judge", "parameters.judge", "string"), ("Dataset", "data_source.project", "string"),
    ("n Samples", "data_source.n_samples", "bigint"), ("Seed", "data_source.seed", "bigint"),
]


class Variant:
    """Builds columns over a record parsed into the VARIANT column ``__record``."""

    def at(self, path: str, kind: str) -> Column:
        return F.try_variant_get("__record", "$." + path, kind)

    def first(self, *values: Column) -> Column:
        return F.coalesce(*values)

    def less(self, a: Column, b: Column) -> Column:
        return F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))

    def mean(self, values: list[Column]) -> Column:
        known = F.array_compact(F.array(*values))
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))

    def day(self, text: Column) -> Column:
        return F.to_date(F.try_to_timestamp(text))

    def version(self, raw: Column) -> Column:
        return F.regexp_replace(raw, VERSION_HEAD, "")

    def display(self, slug: Column, names: dict[str, str]) -> Column:
        return display_model(slug, names)


# Fixed value: what a prompt version begins with.
VERSION_HEAD = "^(?:sorter_|contracts_specialist_|legalbench_task_)"
VARIANT = Variant()


def _lead(names: dict[str, str], b: Variant) -> list[tuple[str, Column]]:
    (n, n_path, n_kind), (t, t_path, t_kind) = HEAD
    version = b.version(b.first(b.at("prompt_versions.sorter", "string"), b.at("prompt_version", "string")))
    return [
        ("DATE", b.day(b.at("timestamp", "string"))), ("Experiment Name", b.at("experiment_name", "string")), (n, b.at(n_path, n_kind)),
        ("MODEL", b.display(b.at("model", "string"), names)), ("Prompt Version", version), (t, b.at(t_path, t_kind)),
    ]


def _tokens(b: Variant) -> list[tuple[str, Column]]:
    return [(h, b.first(b.at(f"tokens.sorter.{k}", kind), b.at(f"tokens.{k}", kind))) for h, k, kind in TOKENS]


def _interval(header: str, path: str, b: Variant) -> list[tuple[str, Column]]:
    return [(f"{header} CI ({part})", b.at(f"{path}_ci.{part}", "double")) for part in ("lo", "hi", "half")]


def sorter_columns(names: dict[str, str] | None = None, b: Variant = VARIANT) -> list[tuple[str, Column]]:
    """The 114 columns of the sorter's workbook, in order."""
    out = _lead(names or {}, b) + [(h, b.at(p, k)) for h, p, k in SORTER]
    out.append(("Rows Failed", b.less(b.at("n_rows", "bigint"), b.at("n_ok", "bigint"))))
    out += _interval("Subtype Accuracy", "scores.sorter.subtype_accuracy", b) + _interval("Doc Type Accuracy", "scores.sorter.exact_match", b)
    out.append(("Failures: n Failed", b.at("scores.sorter.failure_insights.n_failed", "bigint")))
    out += [(f"Failures: {m}", b.at(f"scores.sorter.failure_insights.mode_counts.{m}", "bigint")) for m in SORTER_MODES]
    for header, leaf, kind in (("Accuracy", "accuracy", "double"), ("Accuracy (equiv)", "accuracy_equiv", "double"), ("n Total", "total", "bigint")):
        out += [(f"{header}: {s}", b.at(f"scores.sorter.per_subtype.{s}.{leaf}", kind)) for s in sorted(SUBTYPE_LABELS)]
    return out + _tokens(b) + [(h, b.at(p, k)) for h, p, k in SORTER_TAIL]


def extraction_columns(names: dict[str, str] | None = None, b: Variant = VARIANT) -> list[tuple[str, Column]]:
    """The columns of the extractor's workbook, in order."""
    of = lambda path: b.at(f"scores.{path}", "double")
    diag = lambda path: of(f"diagnostics.{path}")
    mean = b.mean([of(f"hallucination_rate.{f}") for f in FIELDS])
    out = _lead(names or {}, b) + [("Overall Extraction", of("overall_extraction_score")), ("Field Presence", of("field_presence")), ("Schema Valid?", of("schema_valid"))]
    out += [(h, of(f"per_field.{f}")) for h, f in zip(FIELD_HEADERS, FIELDS, strict=True)]
    out += _interval("Overall Extraction", "scores.overall_extraction_score", b)
    out += [("Overall Verified Precision", of("overall_verified_precision")), ("Hallucination Rate (avg)", mean)]
    out += [(f"H Rate: {f}", of(f"hallucination_rate.{f}")) for f in FIELDS] + [(f"Verified Precision: {f}", of(f"verified_precision.{f}")) for f in FIELDS]
    out += [(f"Entity List F1: {f}", of(f"entity_list_f1.{f}")) for f in LISTS] + [(f"Diag: {h}", diag(k)) for h, k in DIAGNOSTICS]
    for header, key in (("List Precision", "entity_list_precision"), ("List Recall", "entity_list_recall"), ("List Raw F1", "entity_list_raw_f1")):
        out += [(f"Diag: {header}: {f}", diag(f"{key}.{f}")) for f in LISTS]
    for family, heads, pair in (("date", DATES, ["effective_date", "term_length"]), ("duration", DURATIONS, ["renewal_terms", "term_length"])):
        out += [(f"Diag: {h}", diag(k)) for h, k in heads]
        out += [(f"Diag: {family.title()} {m}: {f}", diag(f"{family}_{m.lower()}_per_field.{f}")) for m in ("MAE", "R2") for f in pair]
    out += [(f"Diag: {h}", diag(k)) for h, k in COUNTS]
    out += [(f"Diag: Span MAE: {f}", diag(f"span_count_mae_per_field.{f}")) for f in LISTS] + [(f"Diag: Span Signed Mean: {f}", diag(f"span_count_signed_mean_per_field.{f}")) for f in LISTS]
    out += [(f"Diag: Field Presence: {f}", diag(f"field_presence_per_field.{f}")) for f in [*FIELDS, "contract_value"]]
    out += [(f"Err {p} : {f}", diag(f"error_decomposition.{f}.{p}")) for f in FIELDS for p in ("exact_rate", "partial_rate", "miss_rate")]
    return out + [("Category Presence", of("category_presence"))] + _tokens(b) + [(h, b.at(p, k)) for h, p, k in EXTRACTOR_TAIL]


def export_frame(df: DataFrame, raw: str, columns: list[tuple[str, Column]], keys: list[str] | None = None, task: str | None = None) -> DataFrame:
    """One row per whole record, of one task if that is given, with ``keys`` and the given
    columns; broken lines have none."""
    parsed = df.select(*(keys or []), F.try_parse_json(raw).alias("__record")).where("__record is not null")
    if task is not None:
        parsed = parsed.where(VARIANT.at("task", "string") == task)
    return parsed.select(*(keys or []), *[c.alias(h) for h, c in columns])


def sweep_frame(df: DataFrame, raw: str, row_id: str, version: str | None = None, notes: dict[str, str] | DataFrame | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """The sorter's columns of the runs with the champion's prompt version, with a column
    Notes where ``notes`` (by experiment name) are given: a dict, or for any number of names a
    frame of Experiment Name and Notes with one row a name.

    The champion has the highest subtype accuracy (missing counts as 0), then the most rows,
    then the smallest ``row_id``. Without any record the frame is empty.
    """
    wide = export_frame(df, raw, sorter_columns(names), [row_id], SORTER_TASK)
    if version is None:
        score, n = F.coalesce("Subtype Accuracy", F.lit(0.0)), F.coalesce("`SAMPLE (n)`", F.lit(0))
        best = wide.agg(F.max_by("Prompt Version", F.struct(score, n, -F.col(row_id))).alias("__v"))
        wide = wide.join(F.broadcast(best), F.col("Prompt Version").eqNullSafe(F.col("__v")), "left_semi")  # one row
    else:
        wide = wide.where(F.col("Prompt Version") == version)
    if isinstance(notes, DataFrame):
        told = notes.select(F.col("Experiment Name").alias("__name"), "Notes")
    elif notes:
        told = F.broadcast(df.sparkSession.createDataFrame(sorted(notes.items()), "`__name` string, Notes string"))  # as many as the caller lists
    else:
        return wide
    return wide.join(told, F.col("Experiment Name") == F.col("__name"), "left").drop("__name")


def codebook(columns: list[tuple[str, Column]], frame: DataFrame) -> list[tuple[str, str, str, str, str]]:
    """A row per column of an exported frame: name and type."""
    kinds = dict(frame.dtypes)
    return [(h, kinds.get(h, ""), "", "", "") for h, _ in columns]
