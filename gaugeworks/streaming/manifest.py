"""A running scorecard over a folder to which score lines are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.sources.logs import SCORE_SCHEMA


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCORE_SCHEMA).json(path)


def windowed_scores(scores: DataFrame, every: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Counts, sums and means per agent, metric and window of event time; scores later than
    ``late`` are left to batch merges, which bounds the state."""
    timed = scores.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "agent", "metric").agg(F.count("*").alias("n"), F.sum("value_num").alias("total"), F.avg("value_num").alias("mean"))


def start_scorecard(scores: DataFrame, target: str, checkpoint: str, every: str = "1 hour", late: str = "7 days") -> StreamingQuery:
    """Writes finished windows to ``target``; exactly once through the checkpoint."""
    return windowed_scores(scores, every, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
