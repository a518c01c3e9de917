"""Cutting the lines of marked-up books into narratives.

A line is a continuation (``~~``), a head (``# ``) or another; nothing before the end of the header counts. Lines of one book
are numbered by a running count of the places where a unit begins. So that a book of any length is no single task, the
count is taken in two steps: within ranges of ``RANGE`` lines, and over the ranges of a book, of which there are few.

Kinds: ``scan`` and ``v50`` end a unit at every other line, ``cascade`` adds other lines that aren't blank to an open unit. Kept units have
80 to 3000 Arabic letters (``scan``, ``v50``: letters; ``cascade``: characters of the block, after cleaning and without the chain).

Defined results: a line delivered again counts once, as delivered last; a null line is a blank one; a book without an end of
its header has no units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qissaflow.functions.dialect import SPARK
from qissaflow.functions.isnad import isnad_matn
from qissaflow.functions.text import clean_metadata, clean_v50, letters_block, letters_lo, strip

RANGE, LEAST, MOST = 10_000, 80, 3000
HEADER = "#META#Header#End#"
# Heads that open a unit without a text of its own.
CHAPTERS = ("باب", "فصل")


def latest_lines(df: DataFrame) -> DataFrame:
    """path, pos and line of each line once."""
    rows = df.groupBy("path", "pos").agg(F.max(F.struct("loaded_at", "line")).alias("last"))
    return rows.select("path", "pos", F.coalesce("last.line", F.lit("")).alias("line"))


def _body(lines: DataFrame) -> DataFrame:
    """The lines after the first end of a header, without later ones."""
    header = lines.where(F.contains("line", F.lit(HEADER))).groupBy("path").agg(F.min("pos").alias("header"))
    body = lines.join(header, "path").where("pos > header").where(~F.contains("line", F.lit(HEADER)))
    kind = F.expr("CASE WHEN startswith(line, '~~') THEN 'cont' WHEN startswith(line, '# |') THEN 'section' WHEN startswith(line, '# ') THEN 'head' ELSE 'other' END")
    return body.withColumn("kind", kind).drop("header")


def _units(body: DataFrame, begins: str) -> DataFrame:
    """``unit``: how many lines of the book up to this one begin a unit."""
    marked = body.withColumns({"begins": F.expr(f"CAST({begins} AS INT)"), "range": F.expr(f"pos div {RANGE}")})
    ranges = marked.groupBy("path", "range").agg(F.sum("begins").alias("n"))
    over = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("path", "range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(ranges, ["path", "range"]).withColumn("unit", F.col("before") + F.sum("begins").over(inside)).drop("range", "before", "begins")


def _joined(members: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", "own")))
    return members.groupBy("path", "unit").agg(parts.alias("parts")).select("path", "unit", F.expr("array_join(transform(parts, x -> x.own), ' ')").alias("text"))


def _numbered(units: DataFrame) -> DataFrame:
    return units.withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("unit")) - 1).select("path", "idx", "text", "n_ar")


def _own(df: DataFrame) -> DataFrame:
    return df.withColumn("own", F.expr(strip(SPARK, "CASE WHEN kind = 'other' THEN line ELSE substring(line, 3) END")))


def scan_units(lines: DataFrame) -> DataFrame:
    """path, idx, text and n_ar."""
    units = _units(_body(latest_lines(lines)), "kind <> 'cont'")
    texts = _joined(_own(units.where("kind IN ('cont', 'head')")))
    return _numbered(texts.withColumn("n_ar", F.expr(letters_lo(SPARK, "text"))).where(f"n_ar BETWEEN {LEAST} AND {MOST}"))


def v50_units(lines: DataFrame) -> DataFrame:
    """As ``scan_units``, with page and manuscript marks taken away before the count and heads of chapters left out."""
    units = _own(_units(_body(latest_lines(lines)), "kind <> 'cont'").where("kind IN ('cont', 'head')"))
    chapter = F.expr(" OR ".join(f"contains(own, '{c}')" for c in CHAPTERS))
    texts = _joined(units.where(~((F.col("kind") == "head") & chapter)))
    texts = texts.withColumn("text", F.expr(clean_v50(SPARK, "text")))
    return _numbered(texts.withColumn("n_ar", F.expr(letters_lo(SPARK, "text"))).where(f"n_ar BETWEEN {LEAST} AND {MOST}"))


def cascade_raw(lines: DataFrame) -> DataFrame:
    """path, unit and cleaned text of the units of the production scan, before the chain is taken away."""
    units = _units(_body(latest_lines(lines)), "kind IN ('head', 'section')")
    first = units.where("kind IN ('cont', 'head')").groupBy("path", "unit").agg(F.min("pos").alias("opened"))
    members = units.join(first, ["path", "unit"]).where("kind IN ('cont', 'head') OR (kind = 'other' AND pos > opened)")
    texts = _joined(_own(members).where("kind <> 'other' OR own <> ''"))
    return texts.withColumn("text", F.expr(clean_metadata(SPARK, "text")))


def cascade_units(lines: DataFrame) -> DataFrame:
    texts = cascade_raw(lines).withColumn("text", isnad_matn("text")["matn"])
    return _numbered(texts.withColumn("n_ar", F.expr(letters_block(SPARK, "text"))).where(f"n_ar BETWEEN {LEAST} AND {MOST}"))
