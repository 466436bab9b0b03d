"""Problem 1: lengths and dates of extraction_fields in days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.quantities import lengths_from_last_days, site_units, with_days
from gaugeworks.runtime import materialised, spread, table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    sites, hours = site_units(table(spark, base, "sites"), table(spark, base, "duration_units"))
    fields = table(spark, base, "extraction_fields").where(F.col("field").isin("term_length", "renewal_terms", "effective_date"))
    kind = F.when(F.col("field") == "effective_date", "date").when(F.col("field") == "term_length", "term").otherwise("length")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in ("predicted", "expected")]))
    long = fields.select("row_id", "extraction_id", "site_id", kind.alias("kind"), each.alias("v")).select(
        "row_id", "extraction_id", "site_id", "kind", "v.side", "v.value"
    )
    read = with_days(spread(long.where("value is not null"), "row_id"), "kind", "value", "site_id", sites, hours)
    told = read.where("days is not null or last_day is not null").select("row_id", "extraction_id", "side", "days", "last_day", (F.col("kind") == "date").alias("is_date"))
    found = lengths_from_last_days(materialised(told, "lengths"), "extraction_id", "side", "is_date")
    return found.where("days is not null").select("row_id", "side", "days")
