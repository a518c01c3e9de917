"""Books on disk as tables of lines, and labelled texts, predictions and reports in JSON and CSV.

A corpus is a tree author/work/file. Files are read whole, invalid bytes are dropped, and lines end at any of the three line ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def book_lines(spark: SparkSession, folder: str, pattern: str = "*-ara1", author: str | None = None) -> DataFrame:
    """path, author, work, pos, line and loaded_at of every line of the files that match, also of one author only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    parts = F.split("path", "/")
    named = files.select("path", F.element_at(parts, -3).alias("author"), F.element_at(parts, -2).alias("work"), "content", F.col("modificationTime").alias("loaded_at"))
    if author is not None:
        named = named.where(F.col("author") == author)
    text = F.regexp_replace(F.expr("make_valid_utf8(CAST(content AS STRING))"), "�", "")
    lines = named.select("path", "author", "work", "loaded_at", F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "line"))
    return lines.where("NOT startswith(element_at(split(path, '/'), -1), '.')")


LABELLED = "id string, text_ar string, label int, source string, genre string"


def labelled_json(spark: SparkSession, path: str, without_empty: bool = False) -> DataFrame:
    """Labelled narratives, a list of objects; without empty ones a missing label counts as 0."""
    df = spark.read.schema(LABELLED).json(path, multiLine=True)
    return df.where("length(text_ar) > 0").withColumn("label", F.coalesce("label", F.lit(0))) if without_empty else df


def labelled_csv(spark: SparkSession, positives: str, negatives: str, seed: int = 42) -> DataFrame:
    """Two files as one table with a label, in an order that the seed decides."""
    read = lambda path, y: spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("label", F.lit(y))
    return read(positives, 1).unionByName(read(negatives, 0), allowMissingColumns=True).orderBy(F.rand(seed))


PREDICTION = "file string, text string, lr_prob double, xgb_prob double, lr_pred int, xgb_pred int, consensus int"


def predictions_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path, multiLine=True)


def reports_json(spark: SparkSession, *paths: str) -> DataFrame:
    """Model reports with their coefficients as a map, a row for each."""
    schema = "n_features int, cv_auc_mean double, cv_auc_std double, test_auc double, n_positives int, n_negatives int, best_c double, coefficients map<string,double>"
    return spark.read.schema(schema).json(list(paths), multiLine=True)


def compared_reports(reports: DataFrame, first: str, second: str) -> DataFrame:
    """Difference and gain in percent of two reports' cross-validated areas, and the better one; reports has name and cv_auc_mean."""
    a, b = (reports.where(F.col("name") == n).select(F.col("cv_auc_mean").alias(c)) for n, c in ((first, "a"), (second, "b")))
    return a.crossJoin(b).selectExpr("a", "b", "b - a AS difference", "100 * (b - a) / a AS gain", f"CASE WHEN b > a THEN '{second}' ELSE '{first}' END AS winner")


def not_done(files: DataFrame, done: DataFrame, column: str = "path") -> DataFrame:
    return files.join(done.select(column).distinct(), column, "left_anti")
