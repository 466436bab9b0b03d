"""Confidence intervals."""

from __future__ import annotations

import functools
import operator
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(p: Column, n: Column, z: float = 1.96) -> Column:
    """struct<lo, hi, half> of a proportion, cut to [0, 1]; null below one observation."""
    p, n = p.cast("double"), F.when(n >= 1, n.cast("double"))
    z2 = z * z
    over = lambda a, b: F.try_divide(F.lit(a) if isinstance(a, float) else a, b)
    denominator = 1 + over(z2, n)
    centre = (p + over(z2, 2 * n)) / denominator
    margin = z * F.sqrt(F.greatest(F.lit(0.0), over(p * (1 - p), n) + over(z2, 4 * n * n))) / denominator
    lo, hi = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.when(n.isNotNull() & p.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), ((hi - lo) / 2).alias("half")))


def _bounds(n_boot: int, alpha: float) -> tuple[int, int]:
    return max(0, round(alpha / 2 * n_boot) - 1), min(n_boot - 1, round((1 - alpha / 2) * n_boot) - 1)


def resampled_means(values: list[float], n_boot: int, seed: int) -> list[float]:
    """Means of resamples drawn one by one from a seeded generator; for short lists."""
    rng = random.Random(seed)
    n = len(values)
    return [sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(n_boot)]


def interval(values: list[float], n_boot: int = 2000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float] | None:
    """Percentile interval of the mean of a short list; None below two values."""
    if len(values) < 2:
        return None
    means = sorted(resampled_means(values, n_boot, seed))
    lo, hi = _bounds(n_boot, alpha)
    return means[lo], means[hi]


def difference(a: list[float], b: list[float], n_boot: int = 2000, alpha: float = 0.05, seed: int = 42) -> dict | None:
    """Mean of b minus mean of a with its interval; of one generator b is drawn first."""
    if len(a) < 2 or len(b) < 2:
        return None
    rng = random.Random(seed)
    mean = lambda v: sum(v[rng.randrange(len(v))] for _ in range(len(v))) / len(v)
    diffs = sorted(mean(b) - mean(a) for _ in range(n_boot))
    lo, hi = (diffs[i] for i in _bounds(n_boot, alpha))
    return {"delta": sum(b) / len(b) - sum(a) / len(a), "ci_lo": lo, "ci_hi": hi, "significant": lo > 0 or hi < 0}


#: Distinct values of a group that one row of the resampling holds.
CHUNK = 50_000
#: Draws that are held at once.
BLOCK = 4_000_000


def chunk_sums(values: np.ndarray, counts: np.ndarray, drawn: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each replicate b the sum of ``drawn[b]`` draws with replacement from ``values``, each
    of which stands ``counts`` times.

    Where values occur many times the counts of a replicate are drawn at once (multinomial),
    else the draws themselves; both have the same distribution.
    """
    n, k = int(counts.sum()), len(values)
    out = np.zeros(len(drawn))
    if n > 16 * k:
        step = max(1, BLOCK // k)
        for b in range(0, len(drawn), step):
            out[b : b + step] = rng.multinomial(drawn[b : b + step], counts / n) @ values
        return out
    each = np.repeat(values, counts)
    step = max(1, BLOCK // max(1, int(drawn.max(initial=1))))
    for b in range(0, len(drawn), step):
        part = drawn[b : b + step]
        ends = np.cumsum(part)
        sums = np.concatenate([[0.0], np.cumsum(each[rng.integers(n, size=int(ends[-1]))])])
        out[b : b + step] = sums[ends] - sums[ends - part]
    return out


def _chunks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, __vs, __ns, __at, __sizes, __seed): the distinct values of each group with their counts, at
    most about CHUNK to a row; sizes are the draws that each chunk of the group stands for."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, (v + F.lit(0.0)).alias("__v")).agg(F.count("*").alias("__n"))
    groups = counts.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK)).cast("int").alias("__k"))
    chunk = F.pmod(F.xxhash64("__v"), F.col("__k")).cast("int").alias("__chunk")
    rows = (
        _joined(counts, groups, by)
        .groupBy(*by, chunk)
        .agg(F.array_sort(F.collect_list(F.struct("__v", "__n"))).alias("__vn"), F.sum("__n").alias("__size"))
    )
    totals = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__chunk", "__size"))).alias("__sizes"))
    at = F.array_position("__sizes.__chunk", F.col("__chunk"))
    named = {"vs": F.col("__vn.__v"), "ns": F.col("__vn.__n"), "at": at, "sizes": F.col("__sizes.__size"), "seed": F.xxhash64(*by)}
    return _joined(rows, totals, by).select(*by, *[c.alias(f"__{k}") for k, c in named.items()])


def _joined(rows: DataFrame, per_group: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of their group; null is a group."""
    side = per_group.withColumnsRenamed({c: f"__g_{c}" for c in by})
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by])
    return rows.join(side, same).drop(*[f"__g_{c}" for c in by])


def _sums(df: DataFrame, by: list[str], value: str, n_boot: int, seed: int) -> DataFrame:
    """(by, n, total, sums): for each group the number and sum of its values, and the sums of
    ``n_boot`` resamples.

    A resample of n values is n draws with replacement. Groups with very many distinct values
    are several chunks: the draws are dealt to the chunks by one multinomial draw, which each
    chunk repeats from the seed of its group, and the chunks' sums are added up. So no task
    ever holds a group, and the distribution is exact.
    """
    source = _chunks(df, by, value)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("__vs", "__ns", "__at", "__sizes", "__seed")}
            ns, totals, sums = [], [], []
            for v, c, at, sizes, own in zip(*(x.to_pylist() for x in columns.values()), strict=True):
                v, c, sizes = np.array(v), np.array(c, np.int64), np.array(sizes, np.int64)
                n = int(sizes.sum())
                key = [seed, own & 0xFFFFFFFFFFFFFFFF]
                drawn = np.full(n_boot, n) if len(sizes) == 1 else np.random.default_rng(key).multinomial(n, sizes / n, size=n_boot)[:, at - 1]
                ns.append(int(c.sum()))
                totals.append(float(v @ c))
                sums.append(chunk_sums(v, c, drawn, np.random.default_rng([*key, at])).tolist())
            arrays = [*(batch.column(i) for i in range(len(by))), pa.array(ns, pa.int64()), pa.array(totals, pa.float64()), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*by, "n", "total", "sums"])

    parts = source.mapInArrow(run, f"{keys}, n bigint, total double, sums array<double>")
    add = lambda acc, x: F.when(F.size(acc) == 0, x).otherwise(F.zip_with(acc, x, lambda p, q: p + q))
    # a group has a row per CHUNK distinct values here
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.aggregate(F.collect_list("sums"), F.array().cast("array<double>"), add).alias("sums"),
    )


def _at(values: Column, n_boot: int, alpha: float) -> tuple[Column, Column]:
    lo, hi = _bounds(n_boot, alpha)
    return values[lo], values[hi]


def bootstrap(df: DataFrame, by: str, value: str, n_boot: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """n, mean, lo, hi, half of the mean of each group, groups of any size; null is a group.

    Null and NaN values don't count; groups below two values are left out.
    """
    rows = _sums(df, [by], value, n_boot, seed).where("n >= 2")
    means = F.array_sort(F.transform("sums", lambda x: x / F.col("n")))
    ready = rows.select(by, "n", (F.col("total") / F.col("n")).alias("mean"), means.alias("__means"))
    lo, hi = _at(F.col("__means"), n_boot, alpha)
    return ready.select(by, "n", "mean", lo.alias("lo"), hi.alias("hi"), ((hi - lo) / 2).alias("half"))


def bootstrap_drawn(df: DataFrame, by: str, value: str, order: str, most: int = 2_000, n_boot: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """n, mean, lo, hi of groups of up to ``most`` values, drawn one by one in the order of
    ``order`` from a seeded generator, which gives the same figures as :func:`interval` on
    the list. Larger groups and those below two values are left out; they are for
    :func:`bootstrap`."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(by, v.alias("__v"), F.col(order).alias("__o"))
    small = rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).withColumnRenamed(by, "__g")
    listed = rows.join(small, F.col(by).eqNullSafe(F.col("__g"))).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__o", "__v"))).alias("__l"))

    @F.arrow_udf("struct<lo: double, hi: double>")
    def drawn(lists: pa.Array) -> pa.Array:
        found = [interval(x, n_boot, alpha, seed) for x in lists.to_pylist()]
        return pa.array([{"lo": lo, "hi": hi} for lo, hi in found], pa.struct([("lo", pa.float64()), ("hi", pa.float64())]))

    values = F.transform("__l", lambda x: x["__v"])
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return listed.select(by, F.size("__l").cast("bigint").alias("n"), mean.alias("mean"), drawn(values).alias("__ci")).select(by, "n", "mean", "__ci.*")


def bootstrap_difference(df: DataFrame, side: str, a: str, b: str, by: str, value: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """delta, ci_lo, ci_hi and significant of side ``b`` against ``a`` per group, resampled as in
    :func:`bootstrap`; groups with a side below two values are left out."""
    rows = _sums(df.where(F.col(side).isin(a, b)), [by, side], value, n_boot, seed).where("n >= 2")
    rows = rows.withColumns({"__mean": F.col("total") / F.col("n"), "__means": F.transform("sums", lambda x: x / F.col("n"))})
    of = lambda s: F.max(F.when(F.col(side) == s, F.struct("__mean", "__means")))
    both = rows.groupBy(by).agg(of(a).alias("x"), of(b).alias("y")).where("x is not null and y is not null")
    ready = both.select(by, (F.col("y.__mean") - F.col("x.__mean")).alias("delta"), F.array_sort(F.zip_with("y.__means", "x.__means", lambda p, q: p - q)).alias("__d"))
    lo, hi = _at(F.col("__d"), n_boot, 0.05)
    return ready.select(by, "delta", lo.alias("ci_lo"), hi.alias("ci_hi"), ((lo > 0) | (hi < 0)).alias("significant"))
