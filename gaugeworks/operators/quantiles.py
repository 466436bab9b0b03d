"""Exact order statistics of groups of any size, without a group in one task.

Values are counted by buckets of a monotone scale first; a running sum over a group's
buckets, a few thousand at most however many rows it has, tells in which bucket a rank
lies. Only the rows of those buckets are counted by value, and a running sum over
these finds the value of the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets to a doubling of the value.
PER_OCTAVE = 256


def bucket_of(value: Column) -> Column:
    """A whole number that never falls as ``value`` grows: its sign and, in steps, its logarithm."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1100.0)) * PER_OCTAVE) + 1100 * PER_OCTAVE
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, a column per rank): the values at ranks from 0, given as columns over ``n``, the
    number of values of the group. Null and NaN values don't count; null is a group."""
    v = F.col(value).cast("double")
    base = rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, (v + F.lit(0.0)).alias("__v")).withColumn("__b", bucket_of(F.col("__v")))
    keys = [f"__k{i}" for i in range(len(by))]
    base = base.withColumnsRenamed(dict(zip(by, keys, strict=True)))
    counts = base.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    all_ = Window.partitionBy(*keys)
    summed = counts.withColumns({"__end": F.sum("__c").over(all_.orderBy("__b")), "n": F.sum("__c").over(all_)})
    start = F.col("__end") - F.col("__c")
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("bigint").alias("rank")) for name, r in ranks.items()]))
    wanted = summed.withColumn("__r", asked).where((F.col("__r.rank") >= start) & (F.col("__r.rank") < F.col("__end")))
    wanted = wanted.select(*keys, "__b", "n", F.col("__r.name").alias("name"), (F.col("__r.rank") - start).alias("rank"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in (*keys, "__b")]
    some = wanted.select(*keys, "__b").distinct()
    inside = base.join(some, same(base, some), "left_semi").groupBy(*keys, "__b", "__v").agg(F.count("*").alias("__c"))
    inside = inside.withColumn("__end", F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy("__v")))
    hit = wanted.join(inside, same(wanted, inside)).where((F.col("rank") < F.col("__end")) & (F.col("rank") >= F.col("__end") - F.col("__c")))
    found = hit.groupBy(*[wanted[k].alias(c) for k, c in zip(keys, by, strict=True)]).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in ranks]
    )
    return found if by else found.where("n is not null")


def medians(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """(by, out): the median of each group, between the two middle values of an even number."""
    n = F.col("n")
    found = at_ranks(rows, by, value, {"__lo": F.floor((n - 1) / 2), "__hi": F.floor(n / 2)})
    return found.select(*by, ((F.col("__lo") + F.col("__hi")) / 2).alias(out))


def with_medians(totals: DataFrame, rows: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """``totals``, a row per group of ``rows`` by ``by``, with the median of each column of
    ``columns`` under a name; null where a group has no value."""
    out = totals
    for value, name in columns.items():
        side = medians(rows, by, value, name)
        if by:
            side = side.withColumnsRenamed({c: f"__m_{c}" for c in by})
            match = [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in by]
            out = out.join(side, match, "left").drop(*[f"__m_{c}" for c in by])
        else:
            out = out.join(F.broadcast(side), F.lit(True), "left")  # both are one row
    return out
