"""Problem 3: experiment_log and score_records brought to UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.instants import with_utc_millis
from gaugeworks.runtime import bounded_rows, table

SITES_LIMIT = 100_000


def _site_columns(spark: SparkSession, base: str) -> DataFrame:
    """Zone and locale of each site; of a repeated site the first by name."""
    rows = bounded_rows(table(spark, base, "sites").select("site_id", "tz_name", "locale"), SITES_LIMIT, "sites")
    first: dict = {}
    for r in sorted(rows, key=lambda r: (str(r.tz_name), str(r.locale))):
        first.setdefault(r.site_id, (r.site_id, r.tz_name, r.locale))
    return F.broadcast(spark.createDataFrame(list(first.values()), "site_id int, tz_name string, locale string"))


def instants(spark: SparkSession, base: str) -> DataFrame:
    """(src, rec_id, utc_ms) of every record, utc_ms null where no instant is stated."""
    scores = table(spark, base, "score_records").select(
        F.lit("score_records").alias("src"), F.col("seq").alias("rec_id"), F.col("ts").alias("said"), "site_id"
    )
    whole = F.try_parse_json("raw")
    log = (
        table(spark, base, "experiment_log")
        .select("rec_id", "site_id", whole.alias("record"))
        .where(F.col("record").isNotNull())
        .select(
            F.lit("experiment_log").alias("src"), "rec_id", F.try_variant_get("record", "$.timestamp", "string").alias("said"), "site_id"
        )
    )
    both = scores.unionByName(log.select("src", "rec_id", "said", "site_id"))
    return with_utc_millis(both.join(_site_columns(spark, base), "site_id", "left"), "said", "tz_name", "locale").select(
        "src", "rec_id", "said", "site_id", "utc_ms"
    )


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return instants(spark, base).where(F.col("utc_ms").isNotNull()).select("src", "rec_id", "utc_ms")
