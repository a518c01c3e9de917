"""Rows that must stay together in one split (problem 5), by random-mate contraction.

Only the distinct files take part in it, each reduced to the authors (year of death and name) that it names; files of several authors are
the edges. The splits are then dealt by size: for each size of group the driver holds how many there are (as many rows as there are sizes) and
which ranks go to which split, and groups find theirs by their rank among those of their size.

Defined results: a row without a file is a group of its own, and so is a file that names no author; rows delivered again go with their file;
an empty table has no groups; columns other than the id and the file are not read.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from qissaflow.llm.packing import ranked
from qissaflow.llm.scratch import forget, written

_SEVERAL = re.compile(r"\s*[+&]\s*|_+wa_+(?=\d)", re.IGNORECASE)
_AUTHOR = re.compile(r"\s*(\d+)(.*)", re.DOTALL)


def authors(file: str) -> list[str]:
    """Year of death and name of each author that a file value names, in one spelling; none if it names none."""
    last = re.split(r"[/\\]", unquote(file).strip())[-1]
    out = set()
    for part in _SEVERAL.split(last.split(".")[0]):
        if m := _AUTHOR.fullmatch(part):
            name = "".join(c for c in unicodedata.normalize("NFKD", m[2]).casefold() if c.isalpha())
            if name:
                out.add(f"{int(m[1])} {name}")
    return sorted(out)


def components(edges: DataFrame) -> DataFrame:
    """``v`` and the ``label`` of its component, for every vertex of the edges (a, b).

    In each round every vertex throws a coin; a tail with heads among its neighbours is merged into the smallest of them.
    On average a quarter of the vertices that still have an edge goes in a round, so rounds grow as the logarithm of their
    number, and the sizes of components don't matter."""
    edges = written(edges.where("a <> b").distinct(), "edges")
    labels = written(edges.select("a").union(edges.select("b")).distinct().selectExpr("a AS v", "a AS label"), "labels")
    k = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).where(f"xxhash64({k}, a) & 1 = 0 and xxhash64({k}, b) & 1 = 1")
        mates = written(both.groupBy("a").agg(F.min("b").alias("mate")), "mates")
        old = (labels, edges, mates)
        labels = written(labels.join(mates, F.col("label") == F.col("a"), "left").select("v", F.coalesce("mate", "label").alias("label")), "labels")
        one = edges.join(mates, "a", "left").select(F.coalesce("mate", "a").alias("x"), "b")
        two = one.join(mates.withColumnRenamed("a", "b"), "b", "left").select("x", F.coalesce("mate", "b").alias("y"))
        edges = written(two.where("x <> y").selectExpr("least(x, y) AS a", "greatest(x, y) AS b").distinct(), "edges")
        forget(*old)
        k += 1
    return labels


def file_groups(df: DataFrame, file_column: str) -> DataFrame:
    """``file`` and ``group_id`` of every distinct non-null value; a value that names no author is its own group."""
    named = F.udf(authors, ArrayType(StringType()))
    files = df.where(F.col(file_column).isNotNull()).select(F.col(file_column).alias("file")).distinct()
    files = written(files.withColumn("authors", named("file")), "files")
    edges = files.where("size(authors) > 1").select(F.col("authors")[0].alias("a"), F.explode(F.slice("authors", 2, 1 << 30)).alias("b"))
    first = files.select("file", F.coalesce(F.get("authors", F.lit(0)), F.concat(F.lit("file "), "file")).alias("v"))
    return first.join(components(edges), "v", "left").select("file", F.coalesce("label", "v").alias("group_id"))


def tied_files(df: DataFrame, file_column: str) -> DataFrame:
    """For each group of two or more values its smallest value as ``file_a`` and each of the others as ``file_b``."""
    groups = written(file_groups(df, file_column), "groups")
    first = groups.groupBy("group_id").agg(F.min("file").alias("file_a"))
    return groups.join(first, "group_id").where("file <> file_a").select("file_a", F.col("file").alias("file_b"))


def dealt(counts: dict[int, int], shares: dict[str, float]) -> list[tuple[int, int, int, str]]:
    """(size, first rank, rank after the last, split) for ``counts[size]`` groups of each size, the largest first, each
    to the split that lacks most rows."""
    total = sum(s * n for s, n in counts.items())
    lacks = {k: x * total for k, x in shares.items()}
    out = []
    for size in sorted(counts, reverse=True):
        at = 0
        while at < counts[size]:
            best, *rest = sorted(lacks, key=lambda k: -lacks[k])
            n = max(1, min(counts[size] - at, int((lacks[best] - (lacks[rest[0]] if rest else 0)) / size)))
            out.append((size, at, at + n, best))
            lacks[best] -= n * size
            at += n
    return out


def splits(df: DataFrame, id_column: str, file_column: str, shares: dict[str, float] | None = None) -> DataFrame:
    """The id and the split of every row. A row without a file is tied to no other."""
    rows = df.select(F.col(id_column).alias("id"), F.col(file_column).alias("file"))
    groups = file_groups(df, file_column).withColumnRenamed("file", "f")
    rows = rows.join(groups, F.col("file") == F.col("f"), "left").select("id", F.coalesce("group_id", F.concat(F.lit("row "), F.col("id").cast("string"))).alias("group_id"))
    rows = written(rows, "rows")
    sized = written(rows.groupBy("group_id").agg(F.count("*").alias("size")), "sizes")
    counts = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    table = df.sparkSession.createDataFrame(dealt(counts, shares or {"train": 0.8, "validation": 0.1, "test": 0.1}), "size long, low long, high long, split string")
    placed = ranked(sized, ["group_id"]).join(F.broadcast(table), "size").where("rank >= low and rank < high").select("group_id", "split")
    return rows.join(placed, "group_id").select(F.col("id").alias(id_column), "split")
