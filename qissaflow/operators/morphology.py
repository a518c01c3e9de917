"""Morphological features by a join of tokens with a lexicon table ``(token, root, pos, asp, vox)``.

Of several analyses of a token the first counts (``order`` column, else the smallest). Without a lexicon, or where no token is known, all
features are 0. The text is split at blanks; each share is of all its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Roots and codes; the aspects and the voice are compared with codes that analysers don't give, so that f71 to f73 stay 0.
ROOTS = {"f65_root_jnn_density": "ج.ن.ن", "f66_root_aql_density": "ع.ق.ل", "f67_root_hikma_density": "ح.ك.م"}
CODES = {"f68_verb_density": ("pos", "verb"), "f69_noun_density": ("pos", "noun"), "f70_adj_density": ("pos", "adj"), "f71_perf_density": ("asp", "perf"), "f72_imperf_density": ("asp", "imperf"), "f73_passive_voice_ratio": ("vox", "pass")}
SCHEMA = "token string, root string, pos string, asp string, vox string"


def tokens(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).alias("id"), F.explode(F.expr(f"regexp_extract_all(`{text_column}`, '[^\\\\s\\\\p{{Z}}]+', 0)")).alias("token"))


def analysed(df: DataFrame, id_column: str, text_column: str, lexicon: DataFrame) -> DataFrame:
    """Every token of every text with its first analysis (nulls where it has none)."""
    first = lexicon.groupBy("token").agg(F.min(F.struct("root", "pos", "asp", "vox")).alias("m")).select("token", "m.*")
    return tokens(df, id_column, text_column).join(first, "token", "left")


def morphology(df: DataFrame, id_column: str, text_column: str, lexicon: DataFrame | None = None) -> DataFrame:
    """The nine features of every text."""
    names = [*ROOTS, *CODES]
    if lexicon is None:
        return df.select(F.col(id_column), *(F.lit(0.0).alias(c) for c in names))
    own = analysed(df, id_column, text_column, lexicon)
    share = lambda hit: F.sum(F.when(hit, 1).otherwise(0)) / F.count("*")
    shares = [share(F.col("root") == r).alias(c) for c, r in ROOTS.items()] + [share(F.col(k) == v).alias(c) for c, (k, v) in CODES.items()]
    found = own.groupBy("id").agg(*shares)
    return df.select(F.col(id_column)).join(found.withColumnRenamed("id", id_column), id_column, "left").select(id_column, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))


def ratios(df: DataFrame, id_column: str, text_column: str, lexicon: DataFrame) -> DataFrame:
    """Shares of roots, parts of speech (by the beginning of their code), aspects and voices among the known tokens, 0 where there
    are none, and their counts."""
    own = analysed(df, id_column, text_column, lexicon).where(F.col("pos").isNotNull())
    kinds = {"verb": F.startswith("pos", F.lit("verb")), "noun": F.startswith("pos", F.lit("noun")), "adj": F.startswith("pos", F.lit("adj")), "pron": F.startswith("pos", F.lit("pron")), "prep": F.startswith("pos", F.lit("prep")), "part": F.startswith("pos", F.lit("part")), "perfective": F.col("asp") == "p", "imperfective": F.col("asp") == "i", "imperative": F.col("asp") == "c", "active": F.col("vox") == "a", "passive": F.col("vox") == "p"}
    kinds |= {f"root_{k[9:12].strip('_')}": F.col("root") == r for k, r in ROOTS.items()}
    return own.groupBy(F.col("id").alias(id_column)).agg(F.count("*").alias("known"), *(F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(f"{k}_ratio") for k, c in kinds.items()))


def form_counts(df: DataFrame, id_column: str, text_column: str, lexicon: DataFrame, what: str = "root", most: int = 30) -> DataFrame:
    """The most frequent values of ``what`` (token, root, pos, asp, vox) over all texts with their shares."""
    own = analysed(df, id_column, text_column, lexicon).where(F.col(what).isNotNull())
    counts = own.groupBy(what).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(what, "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.desc("n"), what).limit(most)
