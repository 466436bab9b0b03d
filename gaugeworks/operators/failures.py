"""Why rows failed, per group and per family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.labels import failure_mode, normalize_subtype
from gaugeworks.operators.classify import ratio
from gaugeworks.taxonomy import FAILURE_MODES


def with_mode(df: DataFrame) -> DataFrame:
    """``df`` with its failure mode, or ok."""
    return df.withColumn("mode", failure_mode(F.col("subtype_ok"), F.col("doc_type_ok"), F.col("contract_subtype"), F.col("subtype_ok_equiv")))


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Totals and the count of each mode per group."""
    rows = with_mode(df)
    failed = F.count_if(F.col("mode") != "ok")
    modes: list[Column] = [F.count_if(F.col("mode") == m).alias(m) for m in FAILURE_MODES]
    return rows.groupBy(*by).agg(F.count("*").alias("n_total"), failed.alias("n_failed"), ratio(failed, F.count("*")).alias("rate"), *modes)


def ledger(df: DataFrame) -> DataFrame:
    """The failed rows with their mode."""
    return with_mode(df).where(F.col("mode") != "ok")


def per_subtype(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Strict and equivalence-aware accuracy per expected family."""
    ok, eq = F.coalesce("subtype_ok", F.lit(False)), F.coalesce("subtype_ok_equiv", F.lit(False))
    rows = df.withColumn("subtype", normalize_subtype(F.col("expected_subtype")))
    n = F.count("*")
    return rows.groupBy(*(by or []), "subtype").agg(
        n.alias("n"), F.count_if(ok).alias("correct"), F.count_if(ok | eq).alias("correct_equiv"),
        ratio(F.count_if(ok), n).alias("accuracy"), ratio(F.count_if(ok | eq), n).alias("accuracy_equiv"),
    )


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of expected against predicted families, failed rows included."""
    return df.groupBy(*(by or []), normalize_subtype(F.col("expected_subtype")).alias("expected"), normalize_subtype(F.col("contract_subtype")).alias("predicted")).agg(F.count("*").alias("n"))
