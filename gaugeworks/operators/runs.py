"""Analytics over tables of runs: leaders, trends, regressions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators import failures
from gaugeworks.operators.ordering import with_lag
from gaugeworks.operators.quantiles import with_medians
from gaugeworks.operators.stats import bootstrap, wilson
from gaugeworks.taxonomy import FAILURE_MODES, SORTER_TASK

# Fixed value: the form of a run's name.
RUN_NAME = (
    r"^([a-z0-9.-]+?)_(?:(sorter|contracts_specialist|legalbench_task)_)??(v?\d+)(?:_([a-z]+))?(?:_(.+))?$"
)
FRAGMENT = r"(?:sorter|contracts_specialist|legalbench_task)_(v?\d+)"
# RUN_NAME for the JVM as SQL reads it: only \n ends a line, and $ is the very end.
_JVM_NAME = "(?d)" + RUN_NAME.removesuffix("$") + r"\z"
# Fixed value: the space separators of Unicode, which SQL trims.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def display_model(slug: Column, names: dict[str, str]) -> Column:
    """The display name of a model, or the slug itself."""
    if not names:
        return slug
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, slug), slug)


def with_name_parts(df: DataFrame, name: str, names: dict[str, str] | None = None) -> DataFrame:
    """``df`` with model_slug, prompt_kind, version, dimension and suffix of a run's name; for
    other names the first word and any version fragment. Missing parts are null."""
    raw = F.trim(F.coalesce(name, F.lit("")), F.lit(_SPACES))
    known = raw.rlike(_JVM_NAME)
    blank = lambda c: F.when(c != "", c)
    part = lambda i: F.when(known, blank(F.regexp_extract(raw, _JVM_NAME, i)))
    slug = F.when(known, F.regexp_extract(raw, _JVM_NAME, 1)).otherwise(blank(F.substring_index(raw, "_", 1)))
    version = F.when(known, F.regexp_extract(raw, _JVM_NAME, 3)).otherwise(blank(F.regexp_extract(raw, FRAGMENT, 1)))
    return df.withColumns(
        {"model_slug": slug, "prompt_kind": part(2), "version": version, "dimension": part(4), "suffix": part(5), "friendly_model": display_model(slug, names or {})}
    )


def normalized_frame(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Results with derived date, n, model, version, experiment_key and comparison key."""
    parts = with_name_parts(df, "experiment_name", names)
    model = display_model(F.col("model"), names or {})
    return parts.withColumns(
        {
            "date": F.to_date("run_date"),
            "n": F.col("sample_n").cast("bigint"),
            "experiment_key": F.lower("experiment_name"),
            "key": F.concat(F.coalesce(model, F.lit("?")), F.lit("_"), F.coalesce("version", F.lit("?"))),
        }
    )


def with_metric(df: DataFrame, metric: str) -> DataFrame:
    """Rows whose metric is a number. A missing column is an error."""
    if metric not in df.columns:
        raise ValueError(f"metric {metric!r} is not among {df.columns[:20]}")
    value = F.col(metric).try_cast("double")
    return df.withColumn(metric, value).where(value.isNotNull() & ~F.isnan(value))


def metric_columns(df: DataFrame) -> list[str]:
    """Columns that look like proportions, by their names."""
    hints = ("accuracy", "score", "precision", "recall", "f1", "rate", "confidence")
    return [c for c in df.columns if any(h in c.lower() for h in hints)]


def as_percent(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column) * 100)


def leaders(df: DataFrame, metric: str, k: int, row_id: str, n: str = "sample_n", min_n: int = 0) -> DataFrame:
    """The k best runs with their place: by metric, then n (null last), then id."""
    rows = with_metric(df, metric).where(F.coalesce(n, F.lit(0)) >= min_n)
    order = [F.desc(metric), F.col(n).desc_nulls_last(), F.asc(row_id)]
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # k rows at most


def best_run(df: DataFrame, metric: str, row_id: str, n: str = "sample_n", min_n: int = 0) -> DataFrame:
    return leaders(df, metric, 1, row_id, n, min_n).drop("place")


def runner_up(df: DataFrame, metric: str, row_id: str, n: str = "sample_n", min_n: int = 0) -> DataFrame:
    """The second best run; empty where there is none."""
    return leaders(df, metric, 2, row_id, n, min_n).where("place = 2").drop("place")


def group_summary(df: DataFrame, group: str, metric: str, row_id: str, name: str = "experiment_name", n: str = "sample_n") -> DataFrame:
    """Runs, mean, best, worst, spread and best run of each group; null is the group ``?``."""
    rows = with_metric(df, metric)
    best = F.max_by(F.struct(name, n), F.struct(F.col(metric), -F.col(row_id)))
    return (
        rows.groupBy(F.coalesce(group, F.lit("?")).alias(group))
        .agg(F.count("*").alias("n_runs"), F.avg(metric).alias("mean"), F.max(metric).alias("best"), F.min(metric).alias("worst"), best.alias("__b"))
        .select(group, "n_runs", "mean", "best", "worst", (F.col("best") - F.col("worst")).alias("spread"), F.col(f"__b.{name}").alias("best_run"), F.col(f"__b.{n}").alias("best_n"))
    )


def trend(df: DataFrame, metric: str, lo: str, hi: str, n: str = "sample_n") -> DataFrame:
    """Runs with an interval: the recorded one, else Wilson's where n is 2 or more."""
    rows = with_metric(df, metric)
    ci = wilson(F.col(metric), F.col(n))
    fill = (F.col(lo).isNull() | F.isnan(lo) | F.col(hi).isNull() | F.isnan(hi)) & (F.col(n) >= 2)
    fill = F.coalesce(fill, F.lit(False))
    return rows.withColumns({"lo": F.when(fill, ci["lo"]).otherwise(F.col(lo)), "hi": F.when(fill, ci["hi"]).otherwise(F.col(hi))})


def regressions(df: DataFrame, metric: str, group: str, date: str, row_id: str, threshold: float = 0.02) -> DataFrame:
    """Runs whose metric fell by ``threshold`` or more against the run before it of their group,
    by date (null last) and id. Rows of the null group are left out.

    The window runs per group and day of ``date``, so a group with a great share of all runs
    is spread over its days.
    """
    rows = with_metric(df, metric).where(F.col(group).isNotNull())
    when = F.coalesce(F.col(date).cast("timestamp"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp"))
    before = with_lag(rows.withColumn("__when", when), group, F.unix_date(F.to_date("__when")), [F.col("__when"), F.col(row_id)], metric, "previous")
    return before.drop("__when").withColumn("delta", F.col("previous") - F.col(metric)).where(F.col("delta") >= threshold)


def wide_to_long(df: DataFrame, ids: list[str], columns: dict[str, str], key: str, value: str) -> DataFrame:
    """Columns turned to rows, with short names as keys; null values are left out."""
    renamed = df.select(*ids, *[F.col(c).alias(k) for c, k in columns.items()])
    return renamed.unpivot(ids, list(columns.values()), key, value).where(F.col(value).isNotNull())


def failure_totals(long: DataFrame, mode: str, value: str, n_failed: Column, n_docs: Column) -> DataFrame:
    """Totals of each mode with their share of failures and of documents."""
    sums = long.groupBy(mode).agg(F.sum(value).cast("bigint").alias("n_total"), F.count_if(F.col(value) > 0).alias("n_runs"))
    return sums.withColumns({"pct_of_failures": F.coalesce(F.try_divide("n_total", n_failed), F.lit(0.0)), "pct_of_docs": F.coalesce(F.try_divide("n_total", n_docs), F.lit(0.0))})


def key_summary(long: DataFrame, key: str, value: str, name: str, row_id: str) -> DataFrame:
    """Mean, best, worst, spread and best run of each key over long rows."""
    best = F.max_by(name, F.struct(F.col(value), -F.col(row_id)))
    return long.groupBy(key).agg(
        F.avg(value).alias("mean"), F.max(value).alias("best"), F.min(value).alias("worst"), (F.max(value) - F.min(value)).alias("spread"), best.alias("best_run")
    )


def lowest(summary: DataFrame, key: str, k: int = 5) -> DataFrame:
    return summary.orderBy("mean", key).limit(k)


def highest(summary: DataFrame, value: str, key: str, k: int = 5) -> DataFrame:
    return summary.orderBy(F.desc(value), key).limit(k)


def reliability(df: DataFrame, metric: str, half: Column, n: str = "sample_n") -> DataFrame:
    """Sizes and half-widths of intervals over all runs, in one row."""
    rows = with_metric(df, metric).withColumn("__half", half)
    totals = rows.agg(
        F.count("*").alias("n_runs"), F.min(n).cast("double").alias("min_n"), F.max("__half").alias("max_ci_half"), F.count("__half").alias("runs_with_ci"),
        F.try_divide(F.count("__half"), F.count("*")).alias("runs_with_ci_pct"),
    )
    out = with_medians(totals, rows.select(n, "__half"), [], {n: "median_n", "__half": "median_ci_half"})
    return out.select("n_runs", "median_n", "min_n", "median_ci_half", "max_ci_half", "runs_with_ci", "runs_with_ci_pct")


def champion_version(df: DataFrame, version: str, metric: str, row_id: str, n: str = "sample_n") -> DataFrame:
    """The version of the best run, in one row; a null metric counts as 0."""
    value = F.coalesce(F.when(~F.isnan(metric), F.col(metric)), F.lit(0.0))
    return df.agg(F.max_by(version, F.struct(value, F.coalesce(n, F.lit(0)), -F.col(row_id))).alias(version)).where(F.col(version).isNotNull())


def sweep(df: DataFrame, version: str, metric: str, row_id: str, notes: DataFrame | None = None, on: str = "experiment_name", n: str = "sample_n") -> DataFrame:
    """The runs of the champion version, with notes where there are any."""
    rows = df.join(F.broadcast(champion_version(df, version, metric, row_id, n)), version, "left_semi")  # one row
    return rows if notes is None else rows.join(notes, on, "left")


def sessions(df: DataFrame, session: str = "session", received: str = "received_at") -> DataFrame:
    """One row per session from delivered rows: counts, rates, mean confidence, first moment.

    Sessions that are null or blank are left out. Rates are over rows whose flag is known.
    """
    rate = lambda c: F.avg(F.col(c).cast("double"))
    rows = df.where(F.coalesce(F.col(session) != "", F.lit(False)))
    return rows.groupBy(session).agg(
        F.count("*").alias("n_rows"), rate("doc_type_ok").alias("exact_match"), rate("subtype_ok").alias("subtype_accuracy"),
        rate("subtype_ok_equiv").alias("subtype_accuracy_equiv"), F.avg("confidence").alias("confidence"), F.min(received).alias("first_at"),
        F.count_if(~F.coalesce("subtype_ok", F.lit(False))).alias("n_failed"),
    )


def run_records(df: DataFrame, session: str = "session", received: str = "received_at", model: str | None = None, prompt_version: str | None = None, usage: bool = True) -> DataFrame:
    """One record per session from delivered rows of a sorter, as a run log has it.

    Columns: session, task, model, prompt_version (those of the first row), timestamp (the
    first), n_rows, rates with bootstrap intervals, confidence, n_failed and mode_counts,
    per_subtype (map), confusion (cells), and with the token columns prompt_tokens,
    completion_tokens, total_tokens and cost if ``df`` has them and ``usage``. A missing
    flag is a miss here. Sessions that are null or blank are left out; rates have four digits.
    """
    rows = failures.with_mode(df.where(F.coalesce(F.col(session) != "", F.lit(False))).withColumn("__session", F.col(session)))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    rows = rows.withColumns({"__exact": flag("doc_type_ok"), "__sub": flag("subtype_ok"), "__equiv": flag("subtype_ok_equiv")})
    first = lambda c: F.min_by(c, F.struct(F.col(received).isNull(), received)) if c else F.lit(None).cast("string")
    rate = lambda c: F.round(F.avg(c), 4)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint")
    tokens = {c: total(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens") if usage and c in df.columns}
    if usage and "cost" in df.columns:
        tokens |= {"cost_usd": F.round(F.avg("cost"), 6).alias("cost_usd"), "cost_total_usd": F.round(F.sum("cost"), 6).alias("cost_total_usd")}
    modes = F.struct(*[F.count_if(F.col("mode") == m).alias(m) for m in FAILURE_MODES])
    base = rows.groupBy("__session").agg(
        F.count("*").alias("n_rows"), first(model).alias("model"), first(prompt_version).alias("prompt_version"), F.min(received).alias("timestamp"),
        rate("__exact").alias("exact_match"), rate("__sub").alias("subtype_accuracy"), rate("__equiv").alias("subtype_accuracy_equiv"), rate("confidence").alias("confidence"),
        F.count_if(F.col("mode") != "ok").alias("n_failed"), modes.alias("mode_counts"), *tokens.values(),
    )
    ci = lambda c: bootstrap(rows, "__session", c).select("__session", F.struct(*[F.round(x, 4).alias(x) for x in ("lo", "hi", "half")]).alias(f"{c}_ci"))
    cell = F.struct(*[F.col(c) for c in ("accuracy", "accuracy_equiv", "correct", "equiv", "total")])
    classes = (
        failures.per_subtype(rows, ["__session"])
        .withColumns({"accuracy": F.round("accuracy", 4), "accuracy_equiv": F.round("accuracy_equiv", 4), "equiv": F.col("correct_equiv") - F.col("correct"), "total": F.col("n")})
        .groupBy("__session")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subtype", cell.alias("cell"))))).alias("per_subtype"))
    )
    cells = failures.confusion(rows, ["__session"]).groupBy("__session").agg(F.array_sort(F.collect_list(F.struct("expected", "predicted", "n"))).alias("confusion"))
    out = base
    for more in (ci("__exact"), ci("__sub"), classes, cells):  # one row per session each
        out = out.join(more, "__session", "left")
    named = {"__session": session, "__exact_ci": "exact_match_ci", "__sub_ci": "subtype_accuracy_ci"}
    return out.withColumnsRenamed(named).withColumn("task", F.lit(SORTER_TASK))


def as_log_records(records: DataFrame, session: str = "session", project: str = "") -> DataFrame:
    """(session, raw): records of :func:`run_records` as nested JSON, as lines of a run log are."""
    sorter = F.struct(
        "exact_match", "exact_match_ci", "subtype_accuracy", "subtype_accuracy_ci", "subtype_accuracy_equiv", "confidence",
        F.struct("n_failed", "mode_counts").alias("failure_insights"), "per_subtype", F.col("confusion").alias("confusion_matrix"),
    )
    used = [F.col(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", "cost_total_usd") if c in records.columns]
    record = F.struct(
        F.lit("experiment").alias("type"), "task", F.col(session).alias("experiment_name"), "model", F.struct(F.col("prompt_version").alias("sorter")).alias("prompt_versions"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), "n_rows", F.col("n_rows").alias("n_ok"), F.struct(sorter.alias("sorter")).alias("scores"),
        F.struct(F.struct(*used, F.col("n_rows").alias("rows_with_usage")).alias("sorter")).alias("tokens"), F.struct(F.lit(project).alias("project")).alias("data_source"),
    )
    return records.select(session, F.to_json(record).alias("raw"))


def chart_frames(df: DataFrame, metric: str, lo: str, hi: str, row_id: str) -> dict[str, DataFrame]:
    """The data of each chart: interval plot, versions, models, confidence and cost scatters."""
    t = trend(df, metric, lo, hi)
    return {
        "metric_ci": t.select("experiment_name", "run_date", metric, "lo", "hi").orderBy(F.col("run_date").asc_nulls_last(), "experiment_name"),
        "prompt_version": group_summary(df, "prompt_version", metric, row_id).orderBy(F.desc("mean"), "prompt_version"),
        "model_comparison": group_summary(df, "model", metric, row_id).orderBy(F.desc("mean"), "model"),
        "confidence": with_metric(df, metric).where("average_confidence is not null").select("experiment_name", "average_confidence", metric),
        "cost": with_metric(df, metric).where("cost_estimated_usd > 0").select("experiment_name", "cost_estimated_usd", metric),
        "subtype_heatmap": subtype_heatmap(df, row_id),
        "failure_modes": failure_bars(df, row_id),
    }


def _columns_like(df: DataFrame, prefix: str) -> dict[str, str]:
    return {c: c[len(prefix) :].strip() for c in df.columns if c.startswith(prefix)}


def subtype_heatmap(df: DataFrame, row_id: str, prefix: str = "Accuracy: ", name: str = "experiment_name") -> DataFrame:
    """(row_id, name, key, value) of the columns with a prefix; empty where there are none."""
    columns = _columns_like(df, prefix)
    if not columns:
        return df.select(row_id, name, F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value")).limit(0)
    plain = df.select(row_id, name, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return wide_to_long(plain, [row_id, name], columns, "key", "value")


def failure_bars(df: DataFrame, row_id: str, prefix: str = "Failures: ", name: str = "experiment_name") -> DataFrame:
    """(row_id, name, mode, n) of the failure columns, totals left out."""
    rows = subtype_heatmap(df, row_id, prefix, name).where("key <> 'n Failed' and value > 0")
    return rows.select(row_id, name, F.col("key").alias("mode"), F.col("value").cast("bigint").alias("n"))
