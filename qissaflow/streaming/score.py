"""Scoring narratives as they arrive: a file source, features and a linear score, and a checkpoint in place of a progress file.

The stream has no windows or late-data rules of its own; ``hits_by_day`` shows hits per day of arrival with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qissaflow.operators import profiles, scoring

SCHEMA = "pred_id bigint, file string, text string, loaded_at timestamp"


def read_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: str = SCHEMA, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)


def scored(narratives: DataFrame, level: float = 0.5) -> DataFrame:
    """pred_id, file, loaded_at, score and hit of every narrative; batch tables and streams alike."""
    features = profiles.features(narratives, ["pred_id", "file", "loaded_at"], "text", "train74")
    return scoring.linear_score(features, scoring.DEMO, scoring.INTERCEPT, "score").select("pred_id", "file", "loaded_at", "score", (F.col("score") >= level).alias("hit"))


def write_scores(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append scores to a table; what the checkpoint has seen is not scored again."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def hits_by_day(stream: DataFrame, late: str = "21 days") -> DataFrame:
    day = F.window("loaded_at", "1 day")["start"].alias("day")
    return stream.withWatermark("loaded_at", late).groupBy(day).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
