"""Queries of the operators in this subpackage, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.canonical import Vocabulary, map_values
from gaugeworks.llm.encode import count_tokens, encode
from gaugeworks.llm.pack import pack
from gaugeworks.llm.pii import find_spans, redact
from gaugeworks.llm.topn import top_n
from gaugeworks.runtime import bounded_rows, table


# Words in names of contracts that don't tell their kind, and endings run together with names.
CONTRACT_WORDS = Vocabulary(
    plain=(
        "agreement", "agreements", "agmt", "agrmt", "agt", "agr", "contract", "contracts", "deed", "form", "of", "the", "and", "for",
        "amended", "restated", "draft", "master", "exclusive", "executed", "signed", "copy", "final", "w", "with", "exhibits", "to", "a", "in",
    ),
    tails=("agreement", "agmt", "contract", "deed", "s"),
)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    fields = ["expected_subtype", "contract_subtype"]
    return map_values(table(spark, base, "sorter_rows"), "row_id", fields, table(spark, base, "subtype_catalog"), ["other"], CONTRACT_WORDS)


def p2_unmatched(spark: SparkSession, base: str) -> DataFrame:
    """How often each field holds a value that means no entry."""
    return p2_found(spark, base).groupBy("field").agg(F.count_if(F.col("subtype_key") == "unmatched").alias("n_unmatched"), F.count("*").alias("n"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    runs = table(spark, base, "eval_results").where(
        F.col("prompt_version").isNotNull() & F.col("model").isNotNull() & F.col("subtype_accuracy").isNotNull() & ~F.isnan("subtype_accuracy")
    )
    order = [F.col("subtype_accuracy").desc(), F.col("sample_n").desc_nulls_last(), F.col("result_id").asc()]
    narrow = runs.select("result_id", "prompt_version", "model", "subtype_accuracy", "sample_n")
    return top_n(narrow, ["prompt_version", "model"], order, 3).select("result_id", "place")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode(table(spark, base, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, base: str) -> DataFrame:
    """Every document, or piece of one above the capacity, in a container of each budget."""
    sizes = count_tokens(table(spark, base, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", table(spark, base, "pack_budgets"))


def p9_use(spark: SparkSession, base: str) -> DataFrame:
    """How full the containers of each budget are."""
    bins = p9_packed(spark, base).where("container is not null").groupBy("budget_id", "container").agg(F.sum("n_tokens").alias("used"))
    caps = table(spark, base, "pack_budgets")
    bounded_rows(caps, 1000, "budgets")
    return (
        bins.groupBy("budget_id")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
        .join(F.broadcast(caps.select("budget_id", "capacity_tokens")), "budget_id")
        .withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
    )


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return find_spans(table(spark, base, "documents"), "doc_id", "text")


def p10_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every document with typed placeholders for personal data."""
    return redact(table(spark, base, "documents"), "doc_id", "text")


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_unmatched": p2_unmatched,
        "p4_found": p4_found,
        "p8_ids": p8_ids,
        "p9_packed": p9_packed,
        "p9_use": p9_use,
        "p10_found": p10_found,
        "p10_redacted": p10_redacted,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            SELECT result_id, place FROM (
              SELECT result_id, row_number() OVER (PARTITION BY prompt_version, model
                ORDER BY subtype_accuracy DESC, sample_n DESC NULLS LAST, result_id) AS place
              FROM eval_results
              WHERE prompt_version IS NOT NULL AND model IS NOT NULL
                AND subtype_accuracy IS NOT NULL AND NOT isnan(subtype_accuracy))
            WHERE place <= 3
        """,
    }
