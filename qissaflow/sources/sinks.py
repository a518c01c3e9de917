"""Writing candidates, predictions, classes and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_candidates(df: DataFrame, path: str, score: str = "lr_score") -> None:
    """By falling score, in ranges, so that no task sorts everything."""
    df.orderBy(F.desc(score), "file", "idx").write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """The rows of each model and their comparison."""
    df.select("file", F.length("text").alias("text_length"), F.col("lr_prob").alias("lr_probability"), F.col("lr_pred").alias("lr_prediction")).write.mode("overwrite").json(f"{path}/lr")
    df.select("file", F.length("text").alias("text_length"), F.col("xgb_prob").alias("xgb_probability"), F.col("xgb_pred").alias("xgb_prediction")).write.mode("overwrite").json(f"{path}/xgb")
    df.where("lr_pred = 1 AND xgb_pred = 1").select("file", F.substring("text", 1, 300).alias("preview"), ((F.col("lr_prob") + F.col("xgb_prob")) / 2).alias("mean_probability")).write.mode("overwrite").json(f"{path}/consensus")


def write_classes(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").partitionBy(column).json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
