"""Findings on a table of runs, as notes and as Markdown.

Every figure comes from an operator with a bounded result; the rules run on the driver
over those few rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import runs
from gaugeworks.operators.classify import top_confusions
from gaugeworks.operators.stats import wilson


@dataclass
class Note:
    severity: str  # info, warning, critical
    topic: str
    text: str


@dataclass
class Findings:
    notes: list[Note] = field(default_factory=list)

    def add(self, severity: str, topic: str, text: str) -> None:
        self.notes.append(Note(severity, topic, text))

    def by_severity(self, severity: str) -> list[Note]:
        return [n for n in self.notes if n.severity == severity]

    def rendered(self) -> str:
        mark = {"info": "[i]", "warning": "[!]", "critical": "[!!]"}
        return "\n".join(f"{mark[n.severity]} {n.topic}: {n.text}" for n in self.notes)


def percent(x: float | None) -> str:
    return "n/a" if x is None or x != x else f"{100 * x:.1f} %"


#: Groups that a note or a table lists at most; it says how many there are.
LISTED = 20


def _significance(out: Findings, best, second, metric: str) -> None:
    if not (best["ci"] and second["ci"]):
        return
    apart = best["ci"]["lo"] > second["ci"]["hi"]
    gap = percent(best[metric] - second[metric])
    out.add("info" if apart else "warning", "significance", f"{gap} ahead of {second['experiment_name']} ({percent(second[metric])}): the intervals are {'apart' if apart else 'not apart'}")


def _versions(out: Findings, df: DataFrame, metric: str, row_id: str) -> None:
    """Versions with two runs or more; where there are none, all."""
    groups = runs.group_summary(df.where("prompt_version is not null"), "prompt_version", metric, row_id)
    lead = groups.orderBy(F.when(F.col("n_runs") >= 2, 0).otherwise(1), F.desc("mean"), "prompt_version").limit(2).collect()
    if not lead:
        return
    first = f"{lead[0]['prompt_version']} leads with a mean of {percent(lead[0]['mean'])} over {lead[0]['n_runs']} runs"
    rival = len(lead) > 1 and (lead[1]["n_runs"] >= 2 or lead[0]["n_runs"] < 2)
    out.add("info", "version", f"{first}; next is {lead[1]['prompt_version']} with {percent(lead[1]['mean'])}" if rival else first)


def _models(out: Findings, df: DataFrame, metric: str, row_id: str) -> None:
    groups = runs.group_summary(df, "model", metric, row_id)
    n = groups.count()
    if n > 1:
        found = groups.orderBy(F.desc("mean"), "model").limit(LISTED).collect()
        told = ", ".join(f"{m['model']} {percent(m['mean'])}" for m in found)
        out.add("info", "models", told if n <= LISTED else f"the best {LISTED} of {n}: {told}")


def _subtypes(out: Findings, df: DataFrame, row_id: str) -> None:
    weak = runs.lowest(subtype_means(df, row_id), "key", 5).collect()
    if weak:
        out.add("warning", "hotspot", f"weakest is {weak[0]['key']} with a mean of {percent(weak[0]['mean'])}; the lowest: " + ", ".join(f"{r['key']} {percent(r['mean'])}" for r in weak))


#: What a leading failure mode points to.
ADVICE = {
    "family_confusion": "look at what tells the families apart in the prompt",
    "function_over_form": "documents are judged by what they do and not by what they are",
    "other_fallback": "the model gives up where a family is due",
    "equivalent_family": "the misses are within families that count for one another",
}


def _modes(out: Findings, df: DataFrame, row_id: str) -> None:
    modes = mode_totals(df, row_id).orderBy(F.desc("n_total"), "mode").limit(LISTED).collect()
    total = sum(m["n_total"] for m in modes)
    if total:
        top = modes[0]
        hint = ADVICE.get(top["mode"])
        severity = "warning" if top["mode"] in ("family_confusion", "function_over_form") else "info"
        out.add(severity, "failure", f"{top['mode']} leads with {top['n_total']} of {total} failures ({percent(top['n_total'] / total)})" + (f": {hint}" if hint else ""))


def _reliability(out: Findings, df: DataFrame, metric: str) -> None:
    has = {"subtype_ci_lo", "subtype_ci_hi"} <= set(df.columns)
    half = (F.col("subtype_ci_hi") - F.col("subtype_ci_lo")) / 2 if has else F.lit(None).cast("double")
    r = runs.reliability(df, metric, half).first()
    if r["median_ci_half"] is not None:
        noisy = r["median_ci_half"] > 0.03
        out.add("warning" if noisy else "info", "reliability", f"results are {'noisy' if noisy else 'tight'}: the median half-width is {percent(r['median_ci_half'])} over {r['n_runs']} runs")
    if r["runs_with_ci"] < r["n_runs"]:
        out.add("warning" if not r["runs_with_ci"] else "info", "coverage", f"{r['runs_with_ci']} of {r['n_runs']} runs have an interval; others get one from their size")


def _cost(out: Findings, df: DataFrame, best, column: str) -> None:
    if column not in df.columns:
        return
    low, high = df.where(F.col(column) > 0).agg(F.min(column), F.max(column)).first()
    if low is not None:
        own = f"the winner's ${best[column]:,.4f}, " if best[column] is not None and best[column] == best[column] else ""
        out.add("info", "cost", f"{own}from ${low:,.4f} to ${high:,.4f} a run")


def _regressions(out: Findings, df: DataFrame, metric: str, row_id: str) -> None:
    if not {"prompt_version", "run_date"} <= set(df.columns):
        return
    falls = runs.regressions(df, metric, "prompt_version", "run_date", row_id)
    worst = falls.orderBy(F.desc("delta"), row_id).limit(1).collect()
    if worst:
        out.add("critical", "regression", f"{falls.count()} runs fell; {worst[0]['experiment_name']} fell most, by {percent(worst[0]['delta'])} against the run of {worst[0]['prompt_version']} before it")


def interpret(df: DataFrame, metric: str = "subtype_accuracy", target: float | None = None, row_id: str = "result_id", min_n: int = 0, cost: str = "cost_estimated_usd") -> Findings:
    """Winner and runner-up with their intervals, target, versions, models, weak subtypes,
    failure modes, reliability, cost and regressions, as notes in this order."""
    out = Findings()
    if metric not in df.columns:
        out.add("warning", "metric", f"{metric} is missing")
        return out
    top = runs.leaders(df, metric, 2, row_id, min_n=min_n)
    rows = top.withColumn("ci", wilson(F.col(metric), F.col("sample_n"))).orderBy("place").collect()
    if not rows:
        out.add("warning", "metric", f"no run has {metric}")
        return out
    best = rows[0]
    equal = best["subtype_accuracy_equiv"] if metric == "subtype_accuracy" and "subtype_accuracy_equiv" in df.columns else None
    more = f", {percent(equal)} with equivalents" if equal is not None and equal == equal else ""
    out.add("info", "winner", f"{best['experiment_name']} with {percent(best[metric])} over n={best['sample_n']}{more}")
    if best["sample_n"] is not None and best["sample_n"] < 50:
        out.add("warning", "sample", f"the winner has only {best['sample_n']} documents")
    if len(rows) > 1:
        _significance(out, best, rows[1], metric)
    if target is not None:
        met = best[metric] >= target
        out.add("info" if met else "warning", "target", f"{percent(best[metric])} against {percent(target)}" + ("" if met else f", {percent(target - best[metric])} short"))
    if "prompt_version" in df.columns:
        _versions(out, df, metric, row_id)
    if "model" in df.columns:
        _models(out, df, metric, row_id)
    _subtypes(out, df, row_id)
    _modes(out, df, row_id)
    _reliability(out, df, metric)
    _cost(out, df, best, cost)
    _regressions(out, df, metric, row_id)
    return out


def subtype_means(df: DataFrame, row_id: str) -> DataFrame:
    """Mean, best, worst and spread of each subtype over the runs, from columns ``Accuracy: ...``."""
    return runs.key_summary(runs.subtype_heatmap(df, row_id).where(~F.isnan("value")), "key", "value", "experiment_name", row_id)


def mode_totals(df: DataFrame, row_id: str) -> DataFrame:
    """Totals of each failure mode, from columns ``Failures: ...``."""
    return runs.failure_bars(df, row_id).groupBy("mode").agg(F.sum("n").alias("n_total"), F.count("*").alias("n_runs"))


def markdown_table(df: DataFrame, rows: int = 40) -> str:
    """The first rows of a frame as a Markdown table."""
    found = df.limit(rows + 1).collect()
    show = lambda v: "" if v is None or v != v else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(show(v) for v in r) + " |" for r in found[:rows]]
    return "\n".join(lines + (["", "More rows are not shown."] if len(found) > rows else []))


def build_report(df: DataFrame, metric: str = "subtype_accuracy", row_id: str = "result_id", target: float | None = None, cells: DataFrame | None = None, min_n: int = 0) -> str:
    """A Markdown report: findings, leaders, versions, models, failure modes, subtypes, hotspots,
    confusions (if ``cells`` of a confusion matrix are given), reliability, cost, regressions.
    Sections without any rows are left out."""
    has = set(df.columns)
    name = [c for c in ("experiment_name", "model", "prompt_version", "sample_n", metric) if c in has]
    best_first = lambda g: runs.group_summary(df, g, metric, row_id).orderBy(F.desc("mean"), g)
    subtypes = subtype_means(df, row_id)
    half = (F.col("subtype_ci_hi") - F.col("subtype_ci_lo")) / 2 if {"subtype_ci_lo", "subtype_ci_hi"} <= has else F.lit(None).cast("double")
    frames: list[tuple[str, DataFrame | None]] = [
        ("Leaders", runs.leaders(df, metric, 10, row_id, min_n=min_n).orderBy("place").select("place", *name)),
        ("Prompt versions", best_first("prompt_version") if "prompt_version" in has else None),
        ("Models", best_first("model") if "model" in has else None),
        ("Failure modes", mode_totals(df, row_id).orderBy(F.desc("n_total"), "mode")),
        ("Subtypes", subtypes.orderBy(F.desc("mean"), "key")),
        ("Hotspots", runs.lowest(subtypes, "key", 5)),
        ("Confusions", None if cells is None else top_confusions(cells, 10)),
        ("Reliability", runs.reliability(df, metric, half)),
        ("Cost", with_cost_rows(df, metric, name, row_id) if "cost_estimated_usd" in has else None),
        ("Regressions", runs.regressions(df, metric, "prompt_version", "run_date", row_id).orderBy(F.desc("delta"), row_id).select(*name, "previous", "delta") if {"prompt_version", "run_date"} <= has else None),
    ]
    parts = [("Findings", interpret(df, metric, target, row_id, min_n).rendered())]
    parts += [(title, markdown_table(f)) for title, f in frames if f is not None]
    return "# Run report\n\n" + "\n\n".join(f"## {title}\n\n{body}" for title, body in parts if title == "Findings" or body.count("\n") > 1) + "\n"


def with_cost_rows(df: DataFrame, metric: str, name: list[str], row_id: str) -> DataFrame:
    """Runs with a cost, the cheapest point of the metric first."""
    rows = runs.with_metric(df, metric).where("cost_estimated_usd > 0")
    return rows.withColumn("points_per_usd", 100 * F.col(metric) / F.col("cost_estimated_usd")).orderBy(F.desc("points_per_usd"), row_id).select(*name, "cost_estimated_usd", "points_per_usd")
