"""The registered queries of this subpackage, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qissaflow.llm import abuse, charform, copies, leaks, packing, pieces, spans, splits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` and ``text`` of every record of the two tables of narratives."""
    quick = _table(spark, sf_dir, "all_predictions").selectExpr("pred_id AS id", "text")
    return quick.unionByName(_table(spark, sf_dir, "strict_analysis_300").selectExpr("ex_id AS id", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copied_pairs(_narratives(spark, sf_dir), "id", "text")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_groups(_narratives(spark, sf_dir), "id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.long_texts(_table(spark, sf_dir, "all_predictions"), "pred_id", "text")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.text_pieces(_table(spark, sf_dir, "all_predictions"), "pred_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_table(spark, sf_dir, "all_predictions"), "pred_id", "text")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_shares(_table(spark, sf_dir, "all_predictions"), "pred_id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charform.look_alike_pairs(_narratives(spark, sf_dir), "id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.tied_files(_table(spark, sf_dir, "all_predictions"), "file")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.splits(_table(spark, sf_dir, "all_predictions"), "pred_id", "file")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.too_large(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "heldout_items")
    return leaks.leaked_items(_table(spark, sf_dir, "documents"), "doc_id", "text", items, "id", "text_ar")


def _texts_and_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str, str, str]:
    return _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "doc_labels"), "doc_id", "text", "toxic"


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abusive(*_texts_and_labels(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(*_texts_and_labels(spark, sf_dir))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(*_texts_and_labels(spark, sf_dir), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_groups, p2_found, p2_pieces, p3_found, p3_shares, p4_found, p5_found, p5_splits, p6_found, p6_containers, p7_found, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in own}


# SQL for DuckDB; the other queries are tested against brute force in tests/llm.
ORACLES = {
    "p2_found": """
        SELECT pred_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: length(x))), 0) > 2000 AS INTEGER) AS unbroken
        FROM all_predictions WHERE length(text) > 2000""",
    "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 4096",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
