"""Queries that fit models on the labelled items and apply them, and others beyond SQL text."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qissaflow.functions.text import words
from qissaflow.functions.dialect import DUCK, SPARK
from qissaflow.operators import annotations, explain, models, morphology, profiles, rules
from qissaflow.sources.shared import shared_folder, written
from qissaflow.streaming import score as stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "heldout_items").where("length(text_ar) > 0")


COLUMNS = [k for b in profiles.train74(SPARK).values() for k in b]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = profiles.features(_items(spark, sf_dir), ["id", "label"], "text_ar", "train74").coalesce(1).cache()
    # written and read back: the plan of 65 expressions would be optimised again for each of the many jobs of a fit
    path = f"{shared_folder(spark)}/labelled-{uuid.uuid4().hex}"
    models.prepared(features, COLUMNS, "id", "label").write.parquet(path)
    return spark.read.parquet(path)


def _corpus(spark: SparkSession, sf_dir: str, more: dict[str, str]) -> DataFrame:
    """The features of the whole corpus, and columns of expressions over it. Worked out once, written and read back: a fit goes over
    its rows several times. Unscaled, since most features are 0 then and take no room."""
    rows = table(spark, sf_dir, "all_predictions").selectExpr("pred_id", "text", *(f"{v} AS {k}" for k, v in more.items()))
    return models.clean(written(profiles.features_in_batches(rows, ["pred_id", *more], "text"), "corpus"), COLUMNS)


def _pool(spark: SparkSession, sf_dir: str, more: dict[str, str] = {}) -> DataFrame:
    """The whole corpus with the vector x, scaled by the labelled items."""
    items = models.clean(profiles.features_in_batches(_items(spark, sf_dir), ["id"], "text_ar"), COLUMNS)
    rows = _corpus(spark, sf_dir, more)
    return models.VectorAssembler(inputCols=COLUMNS, outputCol="x").transform(models.scaled(rows, models.scaler(items, COLUMNS))).select("pred_id", *more, "x")


def lr_train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    _, report = models.train_logistic(rows, COLUMNS, rounds=20)
    own = [(k, *map(float, (v, report["best_c"], report["cv_auc_mean"], report["held_out_auc"], report["refit_auc"]))) for k, v in report["coefficients"].items()]
    return spark.createDataFrame(own, "feature string, coefficient double, best_c double, cv_auc double, held_out_auc double, refit_auc double")


def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lr_train_report(spark, sf_dir).select("feature", "coefficient").orderBy(F.desc(F.abs("coefficient")), "feature").limit(15)


def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted regression over the whole corpus."""
    model, _ = models.train_logistic(_labelled(spark, sf_dir), COLUMNS, grid=(0.01,), rounds=20)
    return model.transform(_pool(spark, sf_dir)).select("pred_id", vector_to_array("probability")[1].alias("lr"))


def dual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models over the whole corpus, each with its own scaling, and their consensus."""
    rows = _labelled(spark, sf_dir)
    lr, _ = models.train_logistic(rows, COLUMNS, grid=(0.01,), rounds=20)
    boosted, _ = models.train_boosted(rows, maxIter=20)
    one = lr.transform(_pool(spark, sf_dir)).select("pred_id", "x", vector_to_array("probability")[1].alias("lr"))
    both = boosted.transform(one).select("pred_id", "lr", vector_to_array("probability")[1].alias("xgb"))
    return both.withColumn("consensus", ((F.col("lr") >= 0.5) & (F.col("xgb") >= 0.5)).cast("int"))


def gbt_train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, auc = models.train_boosted(_labelled(spark, sf_dir), maxIter=30)
    own = [(c, float(v), float(auc)) for c, v in zip(COLUMNS, model.featureImportances.toArray())]
    return spark.createDataFrame(own, "feature string, importance double, held_out_auc double")


def tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = models.train_tree(_labelled(spark, sf_dir), COLUMNS)
    return spark.createDataFrame(list(enumerate(lines)), "line int, rule string")


def tree_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts most in the boosted trees' score of every labelled item."""
    rows = _labelled(spark, sf_dir)
    model, _ = models.train_boosted(rows, maxIter=10)
    return explain.tree_shapley(model, rows, COLUMNS, "id")


def kernel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, auc = models.train_kernel(_labelled(spark, sf_dir), COLUMNS)
    return spark.createDataFrame([(float(auc),)], "held_out_auc double")


def distill_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest that follows the corpus's own probabilities."""
    rows = _pool(spark, sf_dir, {"lr_prob": "lr_prob"}).where("lr_prob IS NOT NULL AND NOT isnan(lr_prob)")
    return models.distill(rows, "lr_prob")[1].select("pred_id", "lr_prob", F.col("prediction").alias("student"))


TEXT = "coalesce(text, '')"


def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pool(spark, sf_dir, {"route": f"{rules.routes(SPARK, TEXT)['expert']} - 1"})
    return models.train_router(rows, "route")[1].select("pred_id", "route", F.col("prediction").cast("int").alias("learned"))


def self_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    pool = _pool(spark, sf_dir).select(F.concat(F.lit("pool "), F.col("pred_id").cast("string")).alias("id"), "x", F.lit(1).alias("fold"))
    _, added = models.self_training(rows, pool, COLUMNS, "id", rounds=3)
    return spark.createDataFrame(list(enumerate(added)), "round int, added int")


def active_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cycles in which the items' own labels stand for the annotator."""
    rows = _labelled(spark, sf_dir)
    _, own = models.active_learning(rows.where("fold < 2"), rows.where("fold >= 2"), lambda asked: asked.select("id").join(rows.select("id", "label"), "id"), COLUMNS, "id", cycles=3, batch=20)
    return own.groupBy("label").agg(F.count("*").alias("n"))


def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stack(_labelled(spark, sf_dir), "id", 3)[1]


def word2vec_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _items(spark, sf_dir).selectExpr("id", f"{words(SPARK, 'text_ar')} AS toks")
    return models.word_vectors(texts, "toks", size=50, rounds=3)[1].select("id", vector_to_array("vector").alias("vector"))


def tfidf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five labelled items next to each hundredth narrative, and their vote."""
    items = _items(spark, sf_dir).selectExpr("id", "coalesce(label, 0) AS label", f"{words(SPARK, 'text_ar')} AS toks")
    asked = table(spark, sf_dir, "all_predictions").where("text IS NOT NULL AND pred_id % 100 = 0").selectExpr("concat('q', pred_id) AS id", f"{words(SPARK, 'text')} AS toks")
    both = models.tfidf(items.select("id", "toks").unionByName(asked), "id", "toks")
    own = both.join(items.select("id"), "id", "left_semi")
    near = models.nearest_texts(both.join(asked.select("id"), "id", "left_semi"), own)
    return models.vote(near, items.select(F.col("id").alias("neighbour"), "label"))


def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return models.nearest_vectors(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding").select("query", "neighbour", "rank")


def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = profiles.features(_items(spark, sf_dir).where("label IS NOT NULL"), ["id", "label"], "text_ar", "train74", "aql")
    return models.mutual_information(features, [k for k in profiles.train74(SPARK)["aql"]], "label")


def redundant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = models.redundant(_corpus(spark, sf_dir, {}), COLUMNS, {c: k for k, c in enumerate(COLUMNS)})
    return spark.createDataFrame([(c,) for c in kept], "feature string")


LEXICON = [("قال", "ق.و.ل", "verb", "p", "a"), ("يقول", "ق.و.ل", "verb", "i", "a"), ("مجنون", "ج.ن.ن", "noun", None, None), ("عقل", "ع.ق.ل", "noun", None, None), ("حكمة", "ح.ك.م", "noun", None, None), ("من", None, "prep", None, None), ("رجل", "ر.ج.ل", "noun", None, None)]


def morphology_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, morphology.SCHEMA)
    return morphology.morphology(table(spark, sf_dir, "all_predictions"), "pred_id", "text", lexicon)


def morphology_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.ratios(table(spark, sf_dir, "all_predictions"), "pred_id", "text", spark.createDataFrame(LEXICON, morphology.SCHEMA))


def form_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.form_counts(table(spark, sf_dir, "all_predictions"), "pred_id", "text", spark.createDataFrame(LEXICON, morphology.SCHEMA))


def annotation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for the examples, answered by rules in place of a language model, and the answers as features."""
    rows = table(spark, sf_dir, "strict_analysis_300").where("text IS NOT NULL")
    asked = rows.select("ex_id", annotations.prompt(F.col("text"), "Annote ce khabar.").alias("prompt"))

    def by_rules(prompts: list[str]) -> list[str]:
        import json

        return [json.dumps({"forme_textuelle": "khabar" if "قال" in p else "autre", "mecanisme_narratif": "absent", "est_majnun_aqil": "مجنون" in p, "confiance": 0.5, "scene_enonciative": {"temoignage_direct": "رأيت" in p}}) for p in prompts]

    return annotations.actant_features(annotations.answered(asked, "ex_id", "prompt", by_rules), "ex_id")


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a stream of files, scored, written with a checkpoint, and read back."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    parent, name = table(spark, sf_dir, "all_predictions").inputFiles()[0].rsplit("/", 1)
    narratives = stream.read_stream(spark, parent, "*.parquet" if parent.endswith(".parquet") else name)
    stream.write_scores(stream.scored(narratives), f"{where}/scores", f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/scores").select("pred_id", F.round("score", 9).alias("score"), "hit")


QUERIES = {
    f.__name__: f
    for f in (
        lr_train_report, top_coefficients, lr_scores, dual_scores, gbt_train_report, tree_rules, tree_shapley, kernel_report, distill_rf, router, self_training, active_learning, stacking, word2vec_mean, tfidf_knn, knn_embeddings,
        mutual_information, redundant_features, morphology_features, morphology_ratios, form_counts, annotation_features, stream_score,
    )
}


def _morphology_sql() -> dict[str, str]:
    own = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in LEXICON) + ") AS l(token, root, pos, asp, vox)"
    toks = r"SELECT pred_id, unnest(regexp_extract_all(text, '[^\s\p{Z}]+')) AS token FROM all_predictions"
    shares = {c: f"root = '{r}'" for c, r in morphology.ROOTS.items()} | {c: f"{k} = '{v}'" for c, (k, v) in morphology.CODES.items()}
    some = ", ".join(f"avg(CASE WHEN {v} THEN 1.0 ELSE 0.0 END) AS {k}" for k, v in shares.items())
    counts = f"SELECT root, count(*) AS n FROM ({toks}) AS t JOIN {own} USING (token) WHERE root IS NOT NULL GROUP BY root"
    return {
        "morphology_features": f"SELECT pred_id, {', '.join(f'CAST(coalesce({c}, 0) AS DOUBLE) AS {c}' for c in shares)} FROM all_predictions LEFT JOIN (SELECT pred_id, {some} FROM ({toks}) AS t LEFT JOIN {own} USING (token) GROUP BY pred_id) AS f USING (pred_id)",
        "form_counts": f"SELECT root, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM ({counts}) ORDER BY n DESC, root LIMIT 30",
    }


def _information_sql() -> str:
    base = profiles.features_sql("(SELECT * FROM heldout_items WHERE length(text_ar) > 0 AND label IS NOT NULL)", ["id", "label"], "text_ar", "train74", "aql")
    long = f"SELECT * FROM (UNPIVOT ({base}) ON {', '.join(profiles.train74(DUCK)['aql'])} INTO NAME feature VALUE v)"
    cut = f"SELECT feature, label, CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / (hi - lo) * 10) AS INTEGER), 9) ELSE 0 END AS bin FROM (SELECT *, min(v) OVER (PARTITION BY feature) AS lo, max(v) OVER (PARTITION BY feature) AS hi FROM ({long}))"
    cells = f"SELECT feature, bin, label, CAST(count(*) AS DOUBLE) AS n FROM ({cut}) GROUP BY feature, bin, label"
    sums = "sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, label) AS l"
    return f"SELECT feature, round(sum(n / t * ln(n * t / (b * l))), 9) AS mi FROM (SELECT *, {sums} FROM ({cells})) GROUP BY feature"


ORACLES = _morphology_sql() | {
    "mutual_information": _information_sql(),
    "knn_embeddings": """SELECT query, neighbour, rank FROM (SELECT q.vec_id AS query, x.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 9) DESC, x.vec_id) AS rank
        FROM embeddings AS q JOIN embeddings AS x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id) WHERE rank <= 5""",
}
