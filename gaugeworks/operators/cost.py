"""Token counts and costs. Prices are a parameter; none are built in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.runtime import bounded_rows

PRICES_LIMIT = 100_000


def with_cost(df: DataFrame, prices: DataFrame, model: str = "model", prompt: str = "prompt_tokens", completion: str = "completion_tokens", out: str = "cost_estimated_usd") -> DataFrame:
    """``df`` with a cost by ``prices`` (pos, known, per_m_in, per_m_out).

    A model has the price of its exact name, else that of the first known name (by pos) it
    begins with, so dated names roll to their base. Unknown models and rows without tokens
    get null. The price table is small, which is checked; the distinct models meet it, not
    the rows. Priced models are broadcast to the rows if they are few, which is checked as
    well; many are joined by a shuffle.
    """
    bounded_rows(prices, PRICES_LIMIT, "prices")
    models = df.select(F.col(model).alias("__m")).where("__m is not null").distinct()
    hits = models.join(F.broadcast(prices), F.expr("startswith(trim(__m), known)"))
    best = F.min_by(F.struct("per_m_in", "per_m_out"), F.struct((F.trim("__m") != F.col("known")).cast("int"), F.col("pos")))
    priced = hits.groupBy("__m").agg(best.alias("__p"))
    p, c = F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0))
    cost = F.when(p + c > 0, p * F.col("__p.per_m_in") / 1e6 + c * F.col("__p.per_m_out") / 1e6)
    if len(priced.select("__m").limit(PRICES_LIMIT + 1).collect()) <= PRICES_LIMIT:
        priced = F.broadcast(priced)
    return df.join(priced, F.col(model) == F.col("__m"), "left").withColumn(out, cost).drop("__m", "__p")


def tokens_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Sums of tokens, mean (cost_usd) and sum (cost_total_usd) of costs per group."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    return df.groupBy(*by).agg(
        total("prompt_tokens"), total("completion_tokens"), total("total_tokens"), F.coalesce(F.avg("cost"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_total_usd"), F.count("*").alias("rows_with_usage"),
    )
