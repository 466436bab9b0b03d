"""Bundles and profiles of metrics as dimension tables.

A bundle row is (bundle, agent, metric, pos): agent null for the bundle's own metrics,
else an addition for that agent.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.runtime import bounded_rows

METRIC_SCHEMA = "name string, tier int, aggregation string, agents array<string>, units string, description string"


def registry(spark: SparkSession, entries: list[dict] | str) -> DataFrame:
    """The metric catalog from dictionaries or a YAML file; tiers by number or name."""
    if isinstance(entries, str):
        import yaml

        loaded = yaml.safe_load(Path(entries).read_text()) or {}
        entries = loaded.get("metrics", loaded) if isinstance(loaded, dict) else loaded
        if isinstance(entries, dict):
            entries = [{"name": k, **(v or {})} for k, v in entries.items()]
    names = {"headline": 0, "core": 1, "diagnostic": 2, "log": 3}
    rows = []
    for e in entries:
        tier = e.get("tier", 3)
        tier = names[tier.lower()] if isinstance(tier, str) and not tier.isdigit() else int(tier)
        if not 0 <= tier <= 3:
            raise ValueError(f"tier {tier} of {e['name']} is not between 0 and 3")
        rows.append((e["name"], tier, e.get("aggregation", "mean"), list(e.get("agents", ["ALL"])), e.get("units"), e.get("description")))
    return spark.createDataFrame(rows, METRIC_SCHEMA)


def bundles(spark: SparkSession, table: dict[str, dict]) -> DataFrame:
    """{bundle: {"metrics": [...], "agents": {agent: [...]}}} as rows."""
    rows = []
    for name, spec in table.items():
        rows += [(name, None, m, i) for i, m in enumerate(spec.get("metrics", []))]
        for agent, more in (spec.get("agents") or {}).items():
            rows += [(name, agent, m, 10_000 + i) for i, m in enumerate(more)]
    return spark.createDataFrame(rows, "bundle string, agent string, metric string, pos int")


def bundle_metrics(table: DataFrame, bundle: str, agent: str | None = None) -> DataFrame:
    """(metric, pos) of a bundle with an agent's additions, each metric once, in order."""
    own = table.where((F.col("bundle") == bundle) & (F.col("agent").isNull() | (F.col("agent") == (agent or ""))))
    return own.groupBy("metric").agg(F.min("pos").alias("pos")).orderBy("pos")


def invalid_bundle_metrics(table: DataFrame, metrics: DataFrame) -> DataFrame:
    """Bundle rows, additions included, whose metric the catalog doesn't have."""
    return table.join(metrics.select(F.col("name").alias("metric")), "metric", "left_anti")


def document_bundle(table: DataFrame, metrics: DataFrame, doc_type: str, agent: str | None = None) -> DataFrame:
    """(metric, pos) of the bundle of a document type, checked: an unknown type is a KeyError,
    and so is a metric of it, additions for any agent included, that the catalog lacks."""
    own = table.where(F.col("bundle") == doc_type)
    if not own.limit(1).collect():
        known = [r[0] for r in bounded_rows(table.select("bundle").distinct().orderBy("bundle"), 10_000, "bundles")]
        raise KeyError(f"unknown document type {doc_type!r}; known: {known}")
    if bad := invalid_bundle_metrics(own, metrics).select("metric").limit(1).collect():
        raise KeyError(f"unknown metric {bad[0][0]!r} in {doc_type!r}")
    return bundle_metrics(table, doc_type, agent)


def with_metrics(metrics: DataFrame, entries: list[dict]) -> DataFrame:
    """The catalog with further metrics; one of the same name is replaced."""
    more = registry(metrics.sparkSession, entries)
    kept = metrics.join(F.broadcast(more.select("name")), "name", "left_anti")  # as many as the caller lists
    return kept.select("name", "tier", "aggregation", "agents").unionByName(more.select("name", "tier", "aggregation", "agents"))


def dashboard(table: DataFrame, metrics: DataFrame, bundle: str, agent: str | None = None, max_tier: int = 1) -> DataFrame:
    """The metrics of a bundle up to a tier, in the bundle's order."""
    names = bundle_metrics(table, bundle, agent)
    bounded_rows(metrics, 100_000, "metrics")
    known = metrics.where(F.col("tier") <= max_tier).select(F.col("name").alias("metric"), "tier")
    return names.join(F.broadcast(known), "metric").orderBy("pos")


def resolve_bundle(profile: dict, doc_type: str | None, doc_bundles: dict[str, str], task_bundles: dict[str, str], fallback: bool = False) -> str:
    """The bundle of a profile: its document type's, its own document bundle, that of its first
    task; with ``fallback`` its fallback bundle."""
    if doc_type is not None:
        if doc_type not in doc_bundles:
            raise KeyError(doc_type)
        return doc_bundles[doc_type]
    if profile.get("doc_bundle"):
        return profile["doc_bundle"]
    for task in profile.get("tasks", []):
        if task in task_bundles:
            return task_bundles[task]
    if fallback and profile.get("fallback_bundle"):
        return profile["fallback_bundle"]
    raise ValueError("the profile has no bundle")
