"""Scorecards of emitted scores, with the metric catalog as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.runtime import bounded_rows

CATALOG_LIMIT = 100_000


def metrics_for(metrics: DataFrame, max_tier: int | None = None, tier: int | None = None, agent: str | None = None) -> DataFrame:
    """Metrics of a tier, up to a tier, of an agent (or of all agents), in order of tier and name."""
    rows = metrics
    if max_tier is not None:
        rows = rows.where(F.col("tier") <= max_tier)
    if tier is not None:
        rows = rows.where(F.col("tier") == tier)
    if agent is not None:
        rows = rows.where(F.array_contains("agents", "ALL") | F.array_contains("agents", agent))
    return rows.orderBy("tier", "name")


def unknown_metrics(scores: DataFrame, metrics: DataFrame) -> DataFrame:
    """Scores of metrics that the catalog doesn't have."""
    return scores.join(metrics.select(F.col("name").alias("metric")), "metric", "left_anti")


def checked(scores: DataFrame, metrics: DataFrame) -> DataFrame:
    """``scores``, or ValueError if one has an unknown metric."""
    if bad := unknown_metrics(scores, metrics).select("metric").limit(1).collect():
        raise ValueError(f"unknown metric {bad[0][0]!r}")
    return scores


def pruned(scores: DataFrame, metrics: DataFrame, max_tier: int = 1) -> DataFrame:
    """Scores of metrics up to a tier; unknown metrics are dropped."""
    bounded_rows(metrics, CATALOG_LIMIT, "metrics")
    names = metrics.where(F.col("tier") <= max_tier).select(F.col("name").alias("metric"))
    return scores.join(F.broadcast(names), "metric", "left_semi")


def scorecard(scores: DataFrame, metrics: DataFrame, by: list[str], max_tier: int = 3) -> DataFrame:
    """One value per group and metric: sum, mean or last by the metric's aggregation.

    The last value is that of the largest seq. A mean without numbers is the last value as
    text. A metric counts for an agent if the catalog lists the agent or ALL. Columns:
    by, agent, metric, n, value_num, value_str.
    """
    bounded_rows(metrics, CATALOG_LIMIT, "metrics")
    defs = metrics.where(F.col("tier") <= max_tier).select(F.col("name").alias("metric"), "aggregation", "agents")
    rows = scores.join(F.broadcast(defs), "metric").where(F.array_contains("agents", "ALL") | F.array_contains("agents", F.col("agent")))
    last = F.max_by(F.struct("value_num", "value_str"), "seq")
    agg = rows.groupBy(*by, "agent", "metric").agg(
        F.first("aggregation").alias("how"), F.count("*").alias("n"), F.sum("value_num").alias("s"), F.avg("value_num").alias("m"), last.alias("last")
    )
    number = F.when(F.col("how") == "sum", F.col("s")).when((F.col("how") != "none") & F.col("m").isNotNull(), F.col("m")).when(F.col("how") != "sum", F.col("last.value_num"))
    text = F.when((F.col("how") == "none") | ((F.col("how") != "sum") & F.col("m").isNull()), F.col("last.value_str"))
    return agg.select(*by, "agent", "metric", "n", number.alias("value_num"), text.alias("value_str"))


def compare_headlines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two scorecards side by side (full outer) with the difference b minus a."""
    x = a.select("metric", F.col("value_num").alias("a"))
    y = b.select("metric", F.col("value_num").alias("b"))
    return x.join(y, "metric", "full_outer").withColumn("delta_b_minus_a", F.col("b") - F.col("a"))
