"""The row before, without gathering a whole partition key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, part: str, seq: str, out: str = "prev_seq", width: int = 4096) -> DataFrame:
    """(part, seq, out): the next smaller ``seq`` of the same ``part``, null for the first.

    ``df`` is reduced to its distinct pairs with both columns non-null. Windows run over
    (part, seq div width), so a part with very many rows is split; only the last seq of
    each such block goes on to a second window, which is ``width`` times smaller.
    """
    pairs = df.where(F.col(part).isNotNull() & F.col(seq).isNotNull()).select(part, seq).distinct()
    pairs = pairs.withColumn("__block", F.floor(F.col(seq) / width))
    inner = Window.partitionBy(part, "__block").orderBy(seq)
    near = pairs.withColumn("__near", F.lag(seq).over(inner))
    ends = pairs.groupBy(part, "__block").agg(F.max(seq).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(part).orderBy("__block")))
    return near.join(ends, [part, "__block"], "left").select(part, seq, F.coalesce("__near", "__end").alias(out))


def with_lag(df: DataFrame, part: str, block: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before in the same ``part``, null for the first.

    ``order`` is the order within a part; ``block`` never falls along it and splits parts with
    very many rows. Windows run over (part, block), and only the last value of each block
    goes on to a second window over the blocks of a part. ``value`` has no nulls.
    """
    rows = df.withColumn("__block", block)
    inner = Window.partitionBy(part, "__block").orderBy(*order)
    near = rows.withColumn(out, F.lag(value).over(inner))
    # the values of one sort key that sorts as ``order`` does
    last = F.max_by(value, F.struct(*[_ascending(c) for c in order]))
    ends = rows.groupBy(part, "__block").agg(last.alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(part).orderBy("__block"))).where("__end is not null")
    return near.join(ends, [part, "__block"], "left").select(*df.columns, F.coalesce(out, "__end").alias(out))


def _ascending(key: Column) -> Column:
    """A column that sorts nulls last when it is compared as part of a struct."""
    return F.struct(key.isNull().alias("none"), key.alias("key"))
