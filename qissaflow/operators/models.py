"""Fitting and applying classifiers of narratives: scaling, cross-validated logistic regression, boosted and single trees, kernel
machine, text index, neighbours, word vectors, distillation, routing, self-training, active learning.

Every model is fitted on labelled rows, which are few beside the corpus, with Spark ML, and judged on folds that it has not seen;
folds are a hash of the id. Scores are applied as expressions or with ``transform``, in one pass over the corpus.

Defined results: null labels are left out of fitting; null and NaN features count as 0; a feature without spread is scaled by 1;
without rows of both labels fitting raises ``ValueError``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler, Word2Vec
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRID = (0.001, 0.01, 0.1, 1.0, 10.0)
# Settings of the boosted trees.
BOOSTED = {"maxDepth": 5, "stepSize": 0.1, "maxIter": 100, "subsamplingRate": 0.8, "seed": 42}


def clean(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in columns})


def scaler(features: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population spread of each column; a spread of 0 becomes 1."""
    row = features.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scaled(features: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return features.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scales.items()})


def prepared(features: DataFrame, columns: list[str], id_column: str, label_column: str, folds: int = 5) -> DataFrame:
    """Labelled rows with the columns x (vector), label, weight (balanced) and fold."""
    rows = clean(features.where(F.col(label_column).isNotNull()), columns)
    n = {r["label"]: r["count"] for r in rows.groupBy(F.col(label_column).cast("int").alias("label")).count().collect()}
    if len(n) != 2:
        raise ValueError("rows of both labels are needed")
    total = sum(n.values())
    rows = scaled(rows, scaler(rows, columns))
    rows = rows.withColumns({"label": F.col(label_column).cast("double"), "fold": F.pmod(F.xxhash64(id_column), F.lit(folds)).cast("int")})
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])))
    return VectorAssembler(inputCols=columns, outputCol="x").transform(rows).select(id_column, "x", "label", "weight", "fold")


def _auc(predictions: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", numBins=0).evaluate(predictions)


def train_logistic(rows: DataFrame, columns: list[str], grid: tuple[float, ...] = GRID, folds: int = 5, rounds: int = 100) -> tuple[object, dict]:
    """The logistic regression refitted with the strength that is best by cross-validation, and a report of it."""
    n = rows.count()
    lr = LogisticRegression(featuresCol="x", weightCol="weight", standardization=False, maxIter=rounds)
    params = ParamGridBuilder().addGrid(lr.regParam, [1 / (c * n) for c in grid]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=params, evaluator=BinaryClassificationEvaluator(numBins=0), numFolds=folds, foldCol="fold").fit(rows)
    best = max(range(len(grid)), key=lambda k: cv.avgMetrics[k])
    held = lr.copy({lr.regParam: 1 / (grid[best] * n)}).fit(rows.where("fold > 0")).transform(rows.where("fold = 0"))
    model = cv.bestModel
    report = {
        "n_features": len(columns), "best_c": grid[best], "cv_auc_mean": cv.avgMetrics[best], "cv_auc_std": cv.stdMetrics[best] if cv.stdMetrics else None, "held_out_auc": _auc(held), "refit_auc": _auc(model.transform(rows)),
        "intercept": model.intercept, "coefficients": dict(zip(columns, model.coefficients.toArray().tolist())),
    }
    return model, report


def train_boosted(rows: DataFrame, **settings: float) -> tuple[object, float]:
    """Boosted trees fitted on all folds but the first, and their AUC on it."""
    model = GBTClassifier(featuresCol="x", weightCol="weight", **(BOOSTED | settings)).fit(rows.where("fold > 0"))
    return model, _auc(model.transform(rows.where("fold = 0")))


def train_tree(rows: DataFrame, columns: list[str], depth: int = 5, least: int = 20) -> tuple[object, list[str]]:
    """A single tree and its rules, one line each."""
    model = DecisionTreeClassifier(featuresCol="x", weightCol="weight", maxDepth=depth, minInstancesPerNode=least).fit(rows)
    text = model.toDebugString
    for k in reversed(range(len(columns))):
        text = text.replace(f"feature {k} ", f"{columns[k]} ")
    return model, [line for line in text.split("\n")[1:] if line.strip()]


def train_kernel(rows: DataFrame, columns: list[str], gamma: float = 0.05, width: int = 128, seed: int = 42) -> tuple[object, float]:
    """A machine with a Gaussian kernel, by random Fourier features and a linear machine on them; its AUC on the first fold."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 * gamma) ** 0.5, (width, len(columns))), rng.uniform(0, 2 * np.pi, width)
    x = vector_to_array("x")
    lit = lambda xs: F.array(*map(F.lit, map(float, xs)))
    dot = [F.cos(F.aggregate(F.zip_with(x, lit(w[k]), lambda p, q: p * q), F.lit(float(b[k])), lambda s, v: s + v)) * (2 / width) ** 0.5 for k in range(width)]
    mapped = rows.withColumn("x", array_to_vector(F.array(*dot)))
    model = LinearSVC(featuresCol="x", weightCol="weight", regParam=0.01, maxIter=30).fit(mapped.where("fold > 0"))
    return model, _auc(model.transform(mapped.where("fold = 0")))


def stack(rows: DataFrame, id_column: str, folds: int = 5) -> tuple[object, DataFrame]:
    """A regression and a single tree, each judging folds it has not seen, and a regression on what both say. The meta model and its rows
    (id, label, one, other, p)."""
    from pyspark.ml.functions import vector_to_array

    parts = []
    for k in range(folds):
        seen, held = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        one = LogisticRegression(featuresCol="x", weightCol="weight", regParam=0.1, standardization=False, maxIter=30).fit(seen).transform(held)
        one = one.select(id_column, "x", "label", "weight", vector_to_array("probability")[1].alias("one"))
        other = DecisionTreeClassifier(featuresCol="x", weightCol="weight", maxDepth=3).fit(seen).transform(one)
        parts.append(other.select(id_column, "label", "weight", "one", vector_to_array("probability")[1].alias("other")))
    base = VectorAssembler(inputCols=["one", "other"], outputCol="meta").transform(reduce(DataFrame.unionByName, parts))
    model = LogisticRegression(featuresCol="meta", weightCol="weight", maxIter=30).fit(base)
    return model, model.transform(base).select(id_column, "label", "one", "other", vector_to_array("probability")[1].alias("p"))


def distill(rows: DataFrame, soft_column: str, trees: int = 20, depth: int = 5) -> tuple[object, DataFrame]:
    """A forest that follows soft labels; ``rows`` has x. The model and its predictions."""
    model = RandomForestRegressor(featuresCol="x", labelCol=soft_column, numTrees=trees, maxDepth=depth, seed=42).fit(rows)
    return model, model.transform(rows)


def train_router(rows: DataFrame, route_column: str) -> tuple[object, DataFrame]:
    """A multinomial regression that learns routes (whole numbers from 0); the model and its predictions."""
    model = LogisticRegression(featuresCol="x", labelCol=route_column, family="multinomial", maxIter=50, regParam=0.01).fit(rows)
    return model, model.transform(rows)


def word_vectors(texts: DataFrame, tokens_column: str, size: int = 200, least: int = 5, window: int = 5, rounds: int = 10) -> tuple[object, DataFrame]:
    """Vectors of words, and for each text their mean (zeros where no word is known)."""
    model = Word2Vec(inputCol=tokens_column, outputCol="vector", vectorSize=size, minCount=least, windowSize=window, maxIter=rounds, seed=42).fit(texts)
    return model, model.transform(texts)


def tfidf(texts: DataFrame, id_column: str, tokens_column: str, terms: int = 5000, longest: int = 3) -> DataFrame:
    """id, term and weight of the most frequent phrases of up to ``longest`` tokens: count times ln((1 + n) / (1 + df)) + 1, each text of length 1."""
    base = texts.select(F.col(id_column).alias("id"), F.col(tokens_column).alias("w"))
    grams = [base.select("id", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {k - 1}, 0)), i -> array_join(slice(w, i, {k}), ' '))") if k == 1 else F.expr(f"CASE WHEN size(w) >= {k} THEN transform(sequence(1, size(w) - {k - 1}), i -> array_join(slice(w, i, {k}), ' ')) ELSE array() END")).alias("term")).where("term <> ''") for k in range(1, longest + 1)]
    grams[0] = base.select("id", F.explode("w").alias("term"))
    counts = reduce(DataFrame.unionByName, grams).groupBy("id", "term").agg(F.count("*").alias("n"))
    known = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(terms)
    size = base.agg(F.count("*").alias("docs"))
    weighted = counts.join(F.broadcast(known), "term").crossJoin(F.broadcast(size))  # one row on the right
    weighted = weighted.withColumn("w", F.col("n") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def nearest_texts(queries: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """query, neighbour, similarity and rank: the k texts of the index with the largest cosine, by a join on terms. Both have
    id, term and weight; a query isn't its own neighbour."""
    q, x = queries.select(F.col("id").alias("query"), "term", F.col("weight").alias("a")), index.select(F.col("id").alias("neighbour"), "term", F.col("weight").alias("b"))
    sims = q.join(x, "term").where("query <> neighbour").groupBy("query", "neighbour").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return sims.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_vectors(queries: DataFrame, vectors: DataFrame, id_column: str, vector_column: str, k: int = 5, rows: int = 2048) -> DataFrame:
    """query, neighbour and rank by cosine: a stated set of queries against all vectors, exactly, block by block. A block has about ``rows``
    vectors on either side; each pair of blocks gives its k best, of which the k best are kept."""
    import numpy as np
    import pyarrow as pa

    def blocks(df: DataFrame, name: str) -> DataFrame:
        count = max(1, -(-df.count() // rows))
        own = df.where(F.col(vector_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
        held = own.groupBy(F.pmod(F.xxhash64("id"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("items"))
        return held.select(F.col("items.id").alias(f"{name}_ids"), F.flatten("items.v").alias(f"{name}_v"))

    def best(batches):
        for batch in batches:
            out = []
            for qi, qv, xi, xv in zip(*(batch.column(c).to_pylist() for c in range(4))):
                q, x = np.array(qv).reshape(len(qi), -1), np.array(xv).reshape(len(xi), -1)
                unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                sims = np.round(unit(q) @ unit(x).T, 9)
                ids = np.array(xi)
                for a, row in zip(qi, sims):
                    keep = ids != a
                    order = np.lexsort((ids[keep], -row[keep]))[:k]
                    out += [(a, int(i), float(s)) for i, s in zip(ids[keep][order], row[keep][order])]
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query", "neighbour", "similarity"])

    pairs = blocks(queries, "q").crossJoin(blocks(vectors, "x")).select("q_ids", "q_v", "x_ids", "x_v")
    found = pairs.mapInArrow(best, "query bigint, neighbour bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """query, label, confidence and neighbours of the majority among neighbours; ``labels`` has neighbour and label. A tie goes to the smaller label."""
    counts = neighbours.join(labels, "neighbour").groupBy("query", "label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("neighbour")).alias("own"))
    per = Window.partitionBy("query")
    ranked = counts.withColumns({"of": F.sum("n").over(per), "r": F.row_number().over(per.orderBy(F.desc("n"), "label"))})
    return ranked.where("r = 1").select("query", "label", (F.col("n") / F.col("of")).alias("confidence"), F.col("own").alias("neighbours"))


def self_training(labelled: DataFrame, pool: DataFrame, columns: list[str], id_column: str, rounds: int = 5, high: float = 0.95, low: float = 0.05) -> tuple[object, list[int]]:
    """In each round the confident rows of the pool join the labelled ones, each once. The last model and how many rows each round added.

    Which rows joined follows from the models so far, so the pool is neither joined with itself nor written: a row joins in the round
    of the first model that is sure of it."""
    from pyspark.ml.functions import vector_to_array

    rest = pool.join(F.broadcast(labelled.select(id_column)), id_column, "left_anti").select(id_column, "x", "fold", F.lit(None).cast("double").alias("label"))
    own, added, model = labelled, [], None
    for _ in range(rounds):
        model = LogisticRegression(featuresCol="x", weightCol="weight", standardization=False, regParam=0.1, maxIter=50).fit(own)
        p = vector_to_array(F.col("probability"))[1]
        sure = F.when(p > high, 1.0).when(p < low, 0.0)
        judged = model.transform(rest).select(id_column, "x", "fold", "label", sure.alias("sure"))
        n = judged.where("label IS NULL AND sure IS NOT NULL").count()
        added.append(n)
        if not n:
            break
        rest = judged.select(id_column, "x", "fold", F.coalesce("label", "sure").alias("label"))
        own = labelled.unionByName(rest.where("label IS NOT NULL").withColumn("weight", F.lit(1.0)).select(labelled.columns))
    return model, added


def uncertain(scored: DataFrame, prob_column: str, id_column: str, n: int = 50) -> DataFrame:
    """The ``n`` rows of which a model is least sure."""
    return scored.where(F.col(prob_column).isNotNull() & ~F.isnan(prob_column)).orderBy(F.abs(F.col(prob_column) - 0.5), id_column).limit(n)


def active_learning(labelled: DataFrame, pool: DataFrame, annotate, columns: list[str], id_column: str, cycles: int = 10, batch: int = 50):
    """Cycles of fitting, choosing the least certain rows and having them labelled: ``annotate`` takes their table (id, x) and returns
    id and label. The last model and the labelled rows."""
    from pyspark.ml.functions import vector_to_array

    model = None
    for _ in range(cycles):
        model = LogisticRegression(featuresCol="x", weightCol="weight", standardization=False, regParam=0.1, maxIter=50).fit(labelled)
        rest = pool.join(labelled.select(id_column), id_column, "left_anti")
        chosen = uncertain(model.transform(rest).withColumn("p", vector_to_array("probability")[1]), "p", id_column, batch).select(id_column, "x", "fold")
        new = chosen.join(annotate(chosen), id_column).select(id_column, "x", F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight"), "fold")
        if new.isEmpty():
            break
        labelled = labelled.unionByName(new)
    return model, labelled


def align(pairs: DataFrame, source: str, target: str, size: int, ridge: float = 1e-6):
    """The linear map from one space of vectors to another, by normal equations, which are sums over all pairs (``size`` squared numbers)."""
    import numpy as np

    cells = pairs.select(F.posexplode(source).alias("i", "a"), F.col(source).alias("s"), F.col(target).alias("t"))
    sums = lambda c: [F.sum(F.col("a") * F.col(c)[j]).alias(f"{c}{j}") for j in range(size)]
    rows = sorted(cells.groupBy("i").agg(*sums("s"), *sums("t")).collect(), key=lambda r: r["i"])
    xx, xy = (np.array([[r[f"{c}{j}"] for j in range(size)] for r in rows]) for c in "st")
    return np.linalg.solve(xx + ridge * np.eye(size), xy)


def redundant(features: DataFrame, columns: list[str], ranks: dict[str, float], level: float = 0.7) -> list[str]:
    """One feature, the best by rank, of each cluster of correlated ones; the matrix has as many rows as there are features."""
    from pyspark.ml.stat import Correlation

    x = VectorAssembler(inputCols=columns, outputCol="x").transform(clean(features, columns)).select("x")
    matrix = Correlation.corr(x, "x").first()[0].toArray()
    group = list(range(len(columns)))
    for i in range(len(columns)):
        for j in range(i):
            if abs(matrix[i, j]) > level:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for c, g in zip(columns, group):
        if g not in best or (ranks.get(c, 0), c) < (ranks.get(best[g], 0), best[g]):
            best[g] = c
    return sorted(best.values())


def mutual_information(features: DataFrame, columns: list[str], label_column: str, bins: int = 10) -> DataFrame:
    """feature and its mutual information with the label, the feature cut into equal bins between its ends."""
    long = features.select(F.col(label_column).cast("int").alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("f")).select("y", "f.feature", "f.v")
    ends = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cut = long.join(F.broadcast(ends), "feature").withColumn("bin", F.expr(f"CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS INT), {bins - 1}) ELSE 0 END"))
    cells = cut.groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("feature")
    p = cells.withColumns({"t": F.sum("n").over(whole), "b": F.sum("n").over(Window.partitionBy("feature", "bin")), "l": F.sum("n").over(Window.partitionBy("feature", "y"))})
    return p.groupBy("feature").agg(F.round(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("b") * F.col("l")))), 9).alias("mi"))


def pipeline_of(columns: list[str]) -> Pipeline:
    """Assembling and a logistic regression as one model that can be saved and loaded."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", standardization=False, regParam=0.1)])
