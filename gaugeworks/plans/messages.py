"""Problem 7: one copy of each trace of a file in sorter_rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.redelivery import MessageStore, buckets_for, is_message, with_message_key
from gaugeworks.runtime import fresh_path, table


def stored_messages(spark: SparkSession, base: str) -> tuple[MessageStore, DataFrame]:
    """The store after two merges, and the keyed input.

    The first merge takes the batches up to the middle of the batch numbers as
    history, the second those after it (and rows without a number) as incoming.
    """
    rows = table(spark, base, "sorter_rows")
    keyed = with_message_key(rows, "trace_id", "filename", "message")
    low, high, n = rows.agg(F.min("batch_id"), F.max("batch_id"), F.count("*")).first()
    store = MessageStore(spark, fresh_path(spark, "messages"), "message", "received_at", "row_id", buckets_for(n))
    cut = None if low is None else (low + high) // 2
    if cut is not None:
        store.merge(keyed.where(F.col("batch_id") <= cut))
    store.merge(keyed.where(F.col("batch_id").isNull() | (F.col("batch_id") > cut) if cut is not None else F.lit(True)))
    store.vacuum()
    return store, keyed


def p7_kept(spark: SparkSession, base: str) -> DataFrame:
    """Every message once, whole."""
    store, keyed = stored_messages(spark, base)
    found = store.read()
    return (keyed.limit(0) if found is None else found).drop("message")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """The rows that aren't kept, although they are messages."""
    store, _ = stored_messages(spark, base)
    messages = table(spark, base, "sorter_rows").where(is_message(F.col("trace_id"), F.col("filename"))).select("row_id")
    kept = store.read()
    return messages if kept is None else messages.join(kept.select("row_id"), "row_id", "left_anti")


_PLACED = r"""
      SELECT *, row_number() OVER (PARTITION BY t, f ORDER BY received_at NULLS LAST, row_id) AS place FROM (
        SELECT *,
          regexp_replace(regexp_replace(lower(trim(trace_id)), '^(?:urn:uuid:|trace:)', ''), '[{}\-]', '', 'g') AS t,
          lower(nfc_normalize(trim(regexp_extract(CASE WHEN contains(filename, '%') THEN url_decode(filename) ELSE filename END, '[^/\\]*$')))) AS f
        FROM sorter_rows WHERE trace_id IS NOT NULL AND filename IS NOT NULL)
      WHERE t <> '' AND f <> ''
"""
P7_SQL = f"SELECT row_id FROM ({_PLACED}) WHERE place > 1"
P7_KEPT_SQL = f"SELECT * EXCLUDE (place, t, f) FROM ({_PLACED}) WHERE place = 1"
