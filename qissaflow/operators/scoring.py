"""Linear scores of feature columns as expressions: standardised, weighted and squashed, with what each feature adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# An illustrative model of eight features (mean, spread, weight); fitted ones come from ``models``.
DEMO = {
    "f00_has_junun": (0.2, 0.4, 0.9), "f16_aql_density": (0.01, 0.02, 0.3), "f18_paradox_junun_aql": (0.1, 0.3, 0.7), "f24_hikma_density": (0.005, 0.01, 0.2),
    "f29_qala_density": (0.03, 0.03, 0.4), "f40_validation_density": (0.01, 0.02, 0.5), "f52_has_authority": (0.2, 0.4, 0.3), "f62_has_wasf": (0.3, 0.45, -0.6),
}
INTERCEPT = -0.4


def part(name: str, mean: float, spread: float, weight: float) -> str:
    """What a feature adds to the score; a spread of 0 counts as 1, NaN and infinite values as 0."""
    clean = f"CASE WHEN {name} IS NULL OR CAST({name} AS STRING) IN ('NaN', 'Infinity', '-Infinity') THEN 0.0E0 ELSE {name} END"
    return f"{weight!r}E0 * (({clean}) - {mean!r}E0) / {spread or 1.0!r}E0"


def linear_score(features: DataFrame, model: dict[str, tuple[float, float, float]], intercept: float, out: str = "lr_prob") -> DataFrame:
    """``features`` with the probability of a linear model."""
    total = " + ".join(["%rE0" % intercept, *(part(k, *v) for k, v in model.items())])
    return features.withColumn(out, F.expr(f"1.0E0 / (1.0E0 + exp(-({total})))"))


def contributions(features: DataFrame, id_columns: list[str], model: dict[str, tuple[float, float, float]], most: int = 10) -> DataFrame:
    """For each row its features that add most to a linear score (exact Shapley values of a linear model), the largest first."""
    items = F.array(*(F.struct((-F.abs(F.expr(part(k, *v)))).alias("size"), F.lit(k).alias("feature"), F.expr(part(k, *v)).alias("added")) for k, v in model.items()))
    ranked = features.select(*id_columns, F.posexplode(F.slice(F.array_sort(items), 1, most)).alias("rank", "item"))
    return ranked.select(*id_columns, (F.col("rank") + 1).alias("rank"), "item.feature", F.col("item.added").alias("added"))
