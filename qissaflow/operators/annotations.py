"""Prompts for a language model and what it answers: building prompts, calling an injected function in batches, parsing annotations to
columns and features, and checking them against labels.

No model is called here: ``ask`` is a function from a list of prompts to a list of answers (JSON), run in Arrow batches on the executors.
An answer that isn't JSON of the schema gives nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a verdict; those of an annotation with what they may be.
VERDICT = "label int, confiance double, paradoxe boolean, transgression boolean, suspension_morale boolean, justification string"
CHOICES = {
    "forme_textuelle": ["khabar", "nadira", "shicr", "hikma", "wasf", "autre"],
    "junun_operateur.sous_type": ["majnun", "mucattah", "mudallah", "macruh", "mustas_tuh", "absent"],
    "junun_operateur.nomination": ["nomme", "anonyme", "isnad_seulement"],
    "junun_operateur.fonction": ["alibi_de_parole", "perception_spirituelle", "transgression_sociale", "feinte", "folie_amour", "absent"],
    "parole_centrale.type_acte": ["sual_jawab", "qawl_hikma", "insulte_paradoxale", "silence_signifiant", "recitation_shicr", "absent"],
    "mecanisme_narratif": ["renversement", "paradoxe_lexical", "revelation", "ironie", "absent"],
    "validation.validateur": ["calife", "savant", "foule", "narrateur", "absent"],
    "validation.mode": ["rire", "don", "admiration", "assentiment", "pleurs", "absent"],
    "scene_enonciative.lieu": ["cour", "rue", "mosquee", "desert", "marche", "prison", "autre", "absent"],
}
FLAGS = ("parole_centrale.contenu_paradoxal", "scene_enonciative.temoignage_direct", "est_majnun_aqil")
POSITIONS = ("autorite", "pair", "tiers", "absent")
ANNOTATION = """forme_textuelle string, junun_operateur struct<sous_type: string, nomination: string, fonction: string>,
    actants array<struct<role_fonctionnel: string, position_relative: string, terme_arabe: string>>,
    parole_centrale struct<type_acte: string, contenu_paradoxal: boolean>, mecanisme_narratif string, validation struct<validateur: string, mode: string>,
    scene_enonciative struct<lieu: string, temoignage_direct: boolean>, est_majnun_aqil boolean, confiance double"""


def prompt(text: Column | str, instruction: str, examples: list[tuple[str, int]] = ()) -> Column:
    """An instruction, examples with their labels, and the text."""
    shown = "".join(f"\n\nTexte : {t}\nRéponse : {label}" for t, label in examples)
    return F.concat(F.lit(f"{instruction}{shown}\n\nTexte : "), text, F.lit("\nRéponse : "))


def answered(df: DataFrame, id_column: str, prompt_column: str, ask: Callable[[list[str]], list[str]], done: DataFrame | None = None) -> DataFrame:
    """id and answer; rows whose id is in ``done`` are not asked again."""
    rows = df.select(F.col(id_column).alias("id"), F.col(prompt_column).alias("prompt"))
    if done is not None:
        rows = rows.join(done.select(F.col(id_column).alias("id")), "id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ask(batch.column(1).to_pylist()), pa.string())], ["id", "answer"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, answer string").withColumnRenamed("id", id_column)


def verdicts(answers: DataFrame, answer_column: str = "answer") -> DataFrame:
    return answers.withColumn("verdict", F.from_json(answer_column, VERDICT)).select("*", "verdict.*").drop("verdict")


def actant_features(answers: DataFrame, id_column: str, answer_column: str = "answer") -> DataFrame:
    """One-hot columns of every choice, the flags, counts of actants by position and the confidence; absent fields count as 0."""
    a = answers.select(id_column, F.from_json(answer_column, ANNOTATION).alias("a"))
    one = lambda condition, name: F.expr(f"CAST(coalesce({condition}, FALSE) AS DOUBLE)").alias(name)
    hot = [one(f"a.{field} = '{v}'", f"{field.split('.')[-1]}_{v}") for field, values in CHOICES.items() for v in values]
    flags = [one(f"a.{field}", field.split(".")[-1]) for field in FLAGS]
    counts = [F.expr(f"CAST(coalesce(size(filter(coalesce(a.actants, array()), x -> x.position_relative = '{p}')), 0) AS DOUBLE)").alias(f"actants_{p}") for p in POSITIONS]
    return a.select(id_column, *hot, *flags, *counts, F.coalesce("a.confiance", F.lit(0.0)).alias("confiance"))


def agreement(judged: DataFrame, one: str, other: str) -> DataFrame:
    """Observed and expected agreement of two columns of 0 and 1, and kappa, in one row."""
    rows = judged.where(F.col(one).isNotNull() & F.col(other).isNotNull())
    cells = rows.agg(F.count("*").alias("n"), F.sum(one).alias("a"), F.sum(other).alias("b"), F.sum((F.col(one) == F.col(other)).cast("int")).alias("same"))
    return cells.selectExpr("n", "same / n AS observed", "(a * b + (n - a) * (n - b)) / (CAST(n AS DOUBLE) * n) AS expected").selectExpr("*", "(observed - expected) / nullif(1 - expected, 0) AS kappa")
