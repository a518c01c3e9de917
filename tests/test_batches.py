"""Features in Arrow batches against those in SQL, and the model queries that go over the whole corpus."""

import os

import numpy as np
import pytest

from qissaflow.functions.dialect import SPARK
from qissaflow.functions.lexicons import SMALL, TRAIN
from qissaflow.operators import models, profiles, rules
from qissaflow.plans import model_queries

FOLDER = "/root/testdata/sf0.001"


def test_batches_have_the_features_of_sql(spark):
    terms = [x for k in (*TRAIN, "VETO", "CONTEXT", "MORPHO", "NEG_AQL") for x in (TRAIN.get(k) or SMALL[k])]
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "abc 123", "مجنون", "قلت", "ذهب", "😀 قال مجنون 😀", "مجنون " * 3000, "قال\n% ما\x00من"]
    texts += [rng.choice([" ", "، ", "", " ا" * 45]).join(rng.choice(terms, rng.integers(1, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    one, other = (sorted(map(tuple, f(df, ["id"], "text", "train74").collect())) for f in (profiles.features, profiles.features_in_batches))
    assert one == other and len(one) == len(texts)
    assert profiles.features_in_batches(df.limit(0), ["id"], "text").collect() == []
    with pytest.raises(ValueError, match="cascade74"):
        profiles.features_in_batches(df, ["id"], "text", "cascade74")


def test_batches_read_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1 AS id, CAST(unhex('D982D8A7D984FF20') AS STRING) AS text")
    assert profiles.features_in_batches(df, ["id"], "text").first().f28_has_qala == 1.0


def test_self_training_adds_a_row_once(spark):
    rng = np.random.default_rng(0)
    rows = [(f"i{k}", float(a), int(a > 0)) for k, a in enumerate(rng.normal(size=80) * 3)]
    data = models.prepared(spark.createDataFrame(rows, "id string, a double, label int").coalesce(1), ["a"], "id", "label").cache()
    far = [(None, 9.0), ("p1", -9.0), ("p2", 0.0), ("i0", 9.0)]
    pool = models.VectorAssembler(inputCols=["a"], outputCol="x").transform(spark.createDataFrame(far, "id string, a double").coalesce(1)).selectExpr("id", "x", "1 AS fold")
    _, added = models.self_training(data, pool, ["a"], "id", rounds=3)
    assert added == [2, 0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_redundant_features_reads_the_texts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "redundant", lambda features, columns, ranks: seen.append(features) or columns[:2])
    assert model_queries.redundant_features(spark, FOLDER).count() == 2
    assert set(model_queries.COLUMNS) <= set(seen[0].columns) and seen[0].count() == spark.read.parquet(f"{FOLDER}/all_predictions.parquet").count()
    assert not any("all_predictions" in f for f in seen[0].inputFiles())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_router_reads_the_texts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "train_router", lambda rows, route: (seen.append(rows), (None, rows.withColumn("prediction", models.F.lit(0.0))))[1])
    got = model_queries.router(spark, FOLDER)
    assert got.columns == ["pred_id", "route", "learned"] and not any("all_predictions" in f for f in seen[0].inputFiles())
    text = spark.read.parquet(f"{FOLDER}/all_predictions.parquet").selectExpr("pred_id", "coalesce(text, '') AS t")
    want = text.selectExpr("pred_id", f"{rules.routes(SPARK)['expert']} - 1 AS route")
    assert sorted(map(tuple, got.select("pred_id", "route").collect())) == sorted(map(tuple, want.collect()))
