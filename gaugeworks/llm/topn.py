"""The N best rows of every group, by secondary sort.

Rows are hash-partitioned by group, sorted within partitions by group, score and
identifier, and streamed in Arrow batches: the first N rows of each run go on, the
rest are passed over. No group is ever buffered. Before the shuffle the same pass
runs on each input partition, so a group with a third of all rows sends at most N
rows per task, and ties fall the same way everywhere because the order is total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _first_of_runs(n: int, place: str):
    """Batches sorted by ``__group``; of each run the first ``n`` rows, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("__group")
            group = batch.column(at)
            starts = np.ones(batch.num_rows, bool)
            starts[1:] = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
            first = group[0].as_py()
            index = np.arange(batch.num_rows, dtype=np.int64)
            begin = np.maximum.accumulate(np.where(starts, index, 0))
            places = index - begin + 1
            if first == last:
                head = int(np.argmax(starts[1:])) + 1 if starts[1:].any() else batch.num_rows
                places[:head] += seen
            last, seen = group[-1].as_py(), int(places[-1])
            keep = pa.array(places <= n)
            names = [f.name for f in batch.schema]
            columns = [*batch.columns]
            if place in names:
                columns[names.index(place)] = pa.array(places)
            else:
                names.append(place)
                columns.append(pa.array(places))
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    return run


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their place from 1.

    ``order`` must be total within a group (end it with an identifier); rows equal in all
    of it take places in no particular order, but still different ones. Null is a group
    of its own, as is NaN. An empty table gives an empty result. Other columns are
    carried along whatever their type; a column that has the name of ``place`` is
    replaced.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    kept = df.drop(place)
    schema = T.StructType([*kept.schema.fields, T.StructField("__group", T.StringType()), T.StructField(place, T.LongType())])
    keyed = kept.withColumn("__group", F.to_json(F.struct(*[F.col(g).cast("string").alias(f"c{i}") for i, g in enumerate(groups)])))
    local = keyed.sortWithinPartitions("__group", *order).mapInArrow(_first_of_runs(n, place), schema)
    whole = local.repartition("__group").sortWithinPartitions("__group", *order).mapInArrow(_first_of_runs(n, place), schema)
    return whole.drop("__group")
