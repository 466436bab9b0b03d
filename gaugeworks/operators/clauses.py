"""Clause-level correctness: spans that must stand verbatim in an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import bare, clause_covered, jaccard, said_no_related
from gaugeworks.operators.classify import ratio, with_rates
from gaugeworks.operators.quantiles import at_ranks
from gaugeworks.taxonomy import POSITIVE_DENOMINATOR


def clause_rows(df: DataFrame, spans: str = "spans", output: str = "output") -> DataFrame:
    """``df`` with the outcome of each pair and its Jaccard (null for absent categories).

    A null output is an empty one; null spans count as none. An answer that holds every span
    is right even if it also says that there is no related clause.
    """
    out, has = F.coalesce(output, F.lit("")), F.coalesce(F.size(spans) > 0, F.lit(False))
    none, covered = said_no_related(out), F.coalesce(clause_covered(F.col(spans), out), F.lit(False))
    return df.withColumns(
        {
            "outcome": F.when(has, F.when(covered, "tp").otherwise("fn")).otherwise(F.when(none, "tn").otherwise("fp")),
            "no_related": none,
            "jaccard": F.when(has, jaccard(F.array_join(spans, " "), bare(out))),
        }
    )


def clause_metrics(rows: DataFrame, by: list[str], denominator: int | None = POSITIVE_DENOMINATOR) -> DataFrame:
    """Pooled counts, rates, mean Jaccard and rates of "no related clause" per group.

    jaccard_median is the upper median of the positives.
    """
    count = lambda o: F.count_if(F.col("outcome") == o)
    positive = F.col("outcome").isin("tp", "fn")
    false_none = F.count_if(positive & F.col("no_related"))
    n_pos = F.count_if(positive)
    cells = rows.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), n_pos.alias("n_positive"), count("tp").alias("tp"), count("tn").alias("tn"), count("fp").alias("fp"),
        count("fn").alias("fn"), F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("jaccard_mean"),
        ratio(F.count_if("no_related"), F.count("*")).alias("no_related_rate"), ratio(false_none, n_pos).alias("false_no_related_rate"),
        ratio(false_none, F.lit(denominator) if denominator is not None else n_pos).alias("false_no_related_rate_fixed"),
    )
    return with_rates(cells)


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at position n div 2 (from 0) of each group's values in order; groups of any
    size, see :mod:`gaugeworks.operators.quantiles`. Groups without a value are left out."""
    return at_ranks(rows, by, value, {f"{value}_median": F.floor(F.col("n") / 2)}).drop("n")
