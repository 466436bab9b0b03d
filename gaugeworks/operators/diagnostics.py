"""Run-level diagnostics of extracted fields in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.parse import parse_date, parse_duration, parse_money
from gaugeworks.operators.classify import ratio
from gaugeworks.operators.quantiles import with_medians


def error_classes(df: DataFrame, by: list[str], score: str = "field_score") -> DataFrame:
    """Counts and shares of exact, partial and missed fields."""
    rows = df.where(F.col(score).isNotNull())
    n, s = F.count("*"), F.col(score)
    exact, miss = F.count_if(s >= 1), F.count_if(s <= 0)
    return rows.groupBy(*by).agg(n.alias("n"), exact.alias("exact"), miss.alias("miss"), (n - exact - miss).alias("partial"), ratio(exact, n).alias("exact_rate"))


def presence(df: DataFrame, by: list[str], value: str = "predicted") -> DataFrame:
    """Share of rows whose value is neither null nor ''."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(value) != "", F.lit(False)).cast("double")).alias("presence"))


def errors(pairs: DataFrame, by: list[str], pred: str = "p", exp: str = "e") -> DataFrame:
    """n, mean and median absolute error, and the coefficient of determination of raw
    predictions (null below two pairs or without variance) of pairs where both are known."""
    d = F.abs(F.col(pred) - F.col(exp))
    rows = pairs.where(F.col(pred).isNotNull() & F.col(exp).isNotNull()).select(*by, pred, exp, d.alias("__d"))
    total = F.count("*") * F.var_pop(exp)
    r2 = F.when((F.count("*") >= 2) & (total > 0), 1 - F.sum(d * d) / total)
    totals = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mae"), r2.alias("r2"))
    return with_medians(totals, rows, by, {"__d": "median_ae"}).select(*by, "n", "mae", "median_ae", "r2")


def date_pairs(df: DataFrame) -> DataFrame:
    day = lambda c: F.unix_date(parse_date(F.col(c))).cast("double")
    return df.withColumns({"p": day("predicted"), "e": day("expected")})


def duration_pairs(df: DataFrame) -> DataFrame:
    return df.withColumns({"p": parse_duration(F.col("predicted")).cast("double"), "e": parse_duration(F.col("expected")).cast("double")})


def money_pairs(df: DataFrame) -> DataFrame:
    return df.withColumns({"p": parse_money(F.col("predicted")), "e": parse_money(F.col("expected"))})


def _z(c: str) -> Column:
    return F.coalesce(F.col(f"list_score.{c}"), F.lit(0))


def list_macro(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean precision, recall and F1 of list fields; null counts as 0."""
    rows = df.where("list_score is not null")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(_z(c).cast("double")).alias(c) for c in ("precision", "recall", "f1")])


def list_micro(df: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of the summed counts."""
    sums = df.where("list_score is not null").groupBy(*by).agg(*[F.sum(_z(c)).cast("bigint").alias(c) for c in ("matched", "n_predicted", "n_expected")])
    p, r = ratio(F.col("matched"), F.col("n_predicted")), ratio(F.col("matched"), F.col("n_expected"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def span_drift(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute and signed difference of predicted and expected list lengths."""
    rows = df.where("list_score.n_expected is not null")
    d = (_z("n_predicted") - F.col("list_score.n_expected")).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("span_mae"), F.avg(d).alias("span_bias"))
