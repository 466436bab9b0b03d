"""Problem 5: the drifting layouts of experiment_log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.drift import SKIP, Words, file_schemas, leftovers, meanings, schema_changes, united
from gaugeworks.runtime import materialised, table


# Words for the same thing in the field names of run logs, and words that say nothing.
RUN_WORDS = Words(
    same=(
        ("prompt", "prompts", "input", "in"), ("completion", "output", "out"), ("rows", "docs", "documents", "records", "row", "doc"),
        ("sorter", "classifier"), ("tokens", "token", "usage"), ("version", "versions", "vers"), ("cost", "price", "spend"),
        ("total", "sum", "overall"), ("estimated", "est", "estimate"), ("cached", "cache"), ("sample", "samples"), ("ok", "success"),
    ),
    both=(("prompts", ("prompt", "version")),),
    empty=frozenset({"usd", "avg", "mean", "n", "num", "stage", "agent", "the", "of", "count", "with"}),
)


def _schemas(spark: SparkSession, base: str, whole: bool = False) -> DataFrame:
    log = table(spark, base, "experiment_log")
    return materialised(file_schemas(log, "stream_id", "file_seq", "file_id", "raw", SKIP, ordered=not whole, whole=whole), "schemas")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return schema_changes(_schemas(spark, base), RUN_WORDS).withColumnRenamed("file", "file_id")


def p5_table(spark: SparkSession, base: str) -> DataFrame:
    """All records in one layout, with every field.

    Renamings are those of the report. Below the keys that it leaves out, fields go by
    their own path: there keys such as subtypes are data, and would be taken for renamed.
    Both come from one pass over the records.
    """
    schemas = _schemas(spark, base, whole=True)
    everything = schemas.select("stream", "seq", "file", F.col("everything").alias("schema"))
    meaning = meanings(everything, schema_changes(schemas, RUN_WORDS))
    return united(table(spark, base, "experiment_log"), ["rec_id", "file_id", "stream_id"], "raw", meaning)


def p5_change_counts(spark: SparkSession, base: str) -> DataFrame:
    return p5_found(spark, base).groupBy("change", "path_before", "path_after").agg(F.count("*").alias("files"))


def p5_leftovers(spark: SparkSession, base: str) -> DataFrame:
    """What found no place in a column of p5_table."""
    return leftovers(p5_table(spark, base))
