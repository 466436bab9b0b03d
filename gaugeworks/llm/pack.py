"""Filling containers of fixed capacity with items, by best-two-fit.

A bin is filled greedily with the largest item that still fits. When nothing fits
any more and room is left, its smallest item is given back and replaced by the two
unpacked items that fill the widened gap most tightly, if they fill more of it.

Items are spread over shards by a hash of their id; the number of shards follows the
total size and the number of items, so that one shard is a task of bounded size whatever
the size of the table and of the items, and at most the last bin of a shard is slack. An item is split only if it
exceeds the capacity: into full containers and one rest.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.runtime import materialised

#: Full containers' worth of items in a shard.
SHARD_BINS = 8_192
#: Items in a shard.
SHARD_ITEMS = 500_000


class _Sizes:
    """Unpacked items by size, with the sizes present in order."""

    def __init__(self, sizes: list[int]):
        self.items: dict[int, list[int]] = {}
        for i in sorted(range(len(sizes)), key=lambda i: -i):
            self.items.setdefault(sizes[i], []).append(i)
        self.present = sorted(self.items)

    def fit(self, room: int) -> int:
        """The largest size present that is at most ``room``; 0 if there is none."""
        at = bisect.bisect_right(self.present, room)
        return self.present[at - 1] if at else 0

    def take(self, size: int) -> int:
        item = self.items[size].pop()
        if not self.items[size]:
            del self.items[size]
            del self.present[bisect.bisect_left(self.present, size)]
        return item

    def give(self, size: int, item: int) -> None:
        if size not in self.items:
            self.items[size] = []
            bisect.insort(self.present, size)
        self.items[size].append(item)

    def pair(self, room: int, least: int) -> tuple[int, int]:
        """The two sizes with the largest sum in (least, room]; (0, 0) if there are none."""
        best, found = least, (0, 0)
        low, high = 0, bisect.bisect_right(self.present, room - 1) - 1
        while low <= high:
            a, b = self.present[low], self.present[high]
            total = a + b
            if total > room:
                high -= 1
                continue
            if low < high or len(self.items[a]) > 1:
                if total > best:
                    best, found = total, (a, b)
                    if best == room:
                        break
            elif low == high:
                break
            low += 1
        return found


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices of ``sizes``, each of which is between 1 and ``capacity``."""
    left, bins = _Sizes(sizes), []
    while left.present:
        size = left.present[-1]
        content = [(size, left.take(size))]
        room = capacity - size
        while room and (size := left.fit(room)):
            content.append((size, left.take(size)))
            room -= size
        if room and left.present:
            smallest, item = content[-1]
            a, b = left.pair(room + smallest, smallest)
            if a:
                content[-1:] = [(a, left.take(a)), (b, left.take(b))]
                left.give(smallest, item)
        bins.append([i for _, i in content])
    return bins


def pack(sizes: DataFrame, row_id: str, size: str, budgets: DataFrame, shard_bins: int = SHARD_BINS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(budget_id, container, row_id, piece, start_at, n_tokens) of every item and budget.

    ``sizes`` has one row per item; ``budgets`` (budget_id, capacity_tokens) is a small
    fixed table. container is unique within a budget. Items of size null or 0 take no
    room and get container null; items above the capacity get several pieces, start_at
    tells where in the item a piece begins. A capacity below 1 or null is an error.
    Equal sizes are packed in the order of their id, so results repeat. A row id that
    occurs twice is two items.
    """
    rows = budgets.select("budget_id", F.col("capacity_tokens").alias("capacity")).limit(1001).collect()
    if len(rows) > 1000 or any(r.capacity is None or r.capacity < 1 for r in rows):
        raise ValueError("budgets must be few and their capacities at least 1")
    items = materialised(sizes.select(F.col(row_id).alias("rec"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size")), "sizes")
    total, n_items = items.agg(F.sum("size"), F.count_if(F.col("size") > 0)).first()
    total = total or 0
    spark = sizes.sparkSession
    if not rows:
        return spark.createDataFrame([], f"budget_id int, container bigint, {row_id} {items.schema['rec'].dataType.simpleString()}, piece int, start_at bigint, n_tokens bigint")
    kind = items.schema["rec"].dataType.simpleString()
    plans = [(r.budget_id, r.capacity, max(1, math.ceil(total / (shard_bins * r.capacity)), math.ceil(n_items / shard_items))) for r in rows]
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("bigint").alias("capacity"), F.lit(s).alias("shards")) for b, c, s in plans]))
    spread = items.where("size > 0").select("rec", "size", each.alias("b")).select("rec", "size", "b.*")
    spread = spread.withColumn("shard", F.pmod(F.xxhash64("rec"), F.col("shards")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        budget, shard = key
        pdf = pdf.sort_values(["rec", "size"], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        ids, whole = pdf["rec"].tolist(), pdf["size"].tolist()
        parts = [(i, p, p * capacity, min(capacity, n - p * capacity)) for i, n in zip(range(len(ids)), whole, strict=True) for p in range(-(-n // capacity))]
        bins = best_two_fit([x[3] for x in parts], capacity)
        out = [(budget, (int(shard) << 32) + k, ids[parts[j][0]], parts[j][1], parts[j][2], parts[j][3]) for k, content in enumerate(bins) for j in content]
        return pd.DataFrame(out, columns=["budget_id", "container", "rec", "piece", "start_at", "n_tokens"])

    packed = spread.groupBy("budget_id", "shard").applyInPandas(run, f"budget_id int, container bigint, rec {kind}, piece int, start_at bigint, n_tokens bigint")
    nothing = items.where("size <= 0").select("rec", each.alias("b")).select(
        F.col("b.budget_id").cast("int").alias("budget_id"), F.lit(None).cast("bigint").alias("container"), "rec",
        F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_at"), F.lit(0).cast("bigint").alias("n_tokens"),
    )
    return packed.unionByName(nothing).withColumnRenamed("rec", row_id)
