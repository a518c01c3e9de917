"""Models, neighbours and annotations on small tables."""

import numpy as np
import pytest

from qissaflow.operators import annotations, models, morphology
from qissaflow.sources import books


def test_scaling_has_population_spread_and_no_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert models.scaler(df, ["a", "b"]) == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_regression_learns_and_refuses_one_label(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    rows = [(f"i{k}", float(a), float(b), int(a + 0.3 * b > 0)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame([*rows, ("null", 0.0, float("nan"), None)], "id string, a double, b double, label int").coalesce(1)
    data = models.prepared(df, ["a", "b"], "id", "label").cache()
    assert data.count() == 120
    _, report = models.train_logistic(data, ["a", "b"], grid=(1.0,), folds=5)
    assert report["held_out_auc"] > 0.95 and report["coefficients"]["a"] > report["coefficients"]["b"] > 0
    with pytest.raises(ValueError, match="both labels"):
        models.prepared(df.where("label = 1"), ["a", "b"], "id", "label")


def test_nearest_vectors_are_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)] + [(99, None)], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r)[:2] + (r["rank"],) for r in models.nearest_vectors(df.where("vec_id % 10 = 0"), df, "vec_id", "embedding", 4, rows=16).collect())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for q in range(0, 60, 10):
        s = np.round(u @ u[q], 9)
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:4]
        want += [(q, i, k + 1) for k, i in enumerate(order)]
    assert got == sorted(want)


def test_neighbours_of_texts_vote(spark):
    df = spark.createDataFrame([("a", "x y z".split()), ("b", "x y w".split()), ("c", "p q".split()), ("q", "x y z z".split()), ("e", [])], "id string, w array<string>")
    vectors = models.tfidf(df, "id", "w").cache()
    near = models.nearest_texts(vectors.where("id = 'q'"), vectors.where("id <> 'q'"), 2)
    assert [r.neighbour for r in near.orderBy("rank").collect()] == ["a", "b"]
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "neighbour string, label int")
    assert tuple(models.vote(near, labels).first()) == ("q", 0, 0.5, ["b"])
    assert abs(sum(r.weight**2 for r in vectors.where("id = 'a'").collect()) - 1) < 1e-9


def test_alignment_finds_a_linear_map(spark):
    rng = np.random.default_rng(2)
    m, x = rng.normal(size=(3, 3)), rng.normal(size=(40, 3))
    df = spark.createDataFrame([(a.tolist(), (a @ m).tolist()) for a in x], "s array<double>, t array<double>")
    assert np.allclose(models.align(df, "s", "t", 3), m, atol=1e-4)


def test_morphology_without_and_with_a_lexicon(spark):
    df = spark.createDataFrame([(1, "قال مجنون قال"), (2, ""), (3, None)], "id int, text string")
    assert all(set(r[1:]) == {0.0} for r in morphology.morphology(df, "id", "text").collect())
    lexicon = spark.createDataFrame([("قال", "ق.و.ل", "verb", "p", "a"), ("مجنون", "ج.ن.ن", "noun", None, None)], morphology.SCHEMA)
    got = {r.id: r for r in morphology.morphology(df, "id", "text", lexicon).collect()}
    assert (got[1].f68_verb_density, got[1].f65_root_jnn_density, got[1].f71_perf_density) == (2 / 3, 1 / 3, 0.0) and set(got[3][1:]) == {0.0}


def test_annotations_that_are_no_json_count_as_nothing(spark):
    answers = spark.createDataFrame([(1, '{"forme_textuelle": "khabar", "est_majnun_aqil": true, "confiance": 0.7, "actants": [{"position_relative": "pair"}]}'), (2, "?"), (3, None)], "id int, answer string")
    got = {r.id: r for r in annotations.actant_features(answers, "id").collect()}
    assert (got[1].forme_textuelle_khabar, got[1].est_majnun_aqil, got[1].actants_pair, got[1].confiance) == (1, 1, 1, 0.7) and set(got[2][1:]) == set(got[3][1:]) == {0.0}
    asked = annotations.answered(spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string"), "id", "prompt", lambda ps: [p.upper() for p in ps], answers.where("id = 1"))
    assert [tuple(r) for r in asked.collect()] == [(2, "B")]
    judged = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0), (None, 1)], "a int, b int")
    assert abs(annotations.agreement(judged, "a", "b").first().kappa - 0.5) < 1e-12


def test_books_on_disk(spark, tmp_path):
    folder = tmp_path / "0300Author" / "Work"
    folder.mkdir(parents=True)
    (folder / "0300Author.Work.X-ara1").write_bytes("#META#Header#End#\r\n# قال\rثم".encode() + b"\xff\n~~x")
    (folder / ".hidden-ara1").write_text("no")
    rows = books.book_lines(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.author, r.work, r.pos, r.line) for r in rows] == [("0300Author", "Work", k, t) for k, t in enumerate(["#META#Header#End#", "# قال", "ثم", "~~x"])]
    assert books.book_lines(spark, str(tmp_path), author="other").count() == 0


def test_shapley_values_of_trees_add_up_and_match_all_orders(spark):
    from itertools import permutations

    from qissaflow.operators import explain

    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    df = spark.createDataFrame([(f"i{k}", *map(float, a), int(b)) for k, (a, b) in enumerate(zip(x, y))], "id string, a double, b double, c double, label int").coalesce(1)
    rows = models.prepared(df, ["a", "b", "c"], "id", "label").cache()
    model, _ = models.train_boosted(rows, maxIter=3, maxDepth=3)
    own = explain.leaves(model, spark)
    data = [(r.id, r.x.toArray()) for r in rows.limit(12).collect()]
    points = np.array([v for _, v in data])
    values, base = explain.shapley(own, points)

    def score(point, known):
        return sum(v * np.prod([(path[f][0] < point[f] <= path[f][1]) if f in known else path[f][2] for f in path]) for v, path in own)

    for point, got in zip(points, values):
        want = np.zeros(3)
        for order in permutations(range(3)):
            for k, f in enumerate(order):
                want[f] += (score(point, order[: k + 1]) - score(point, order[:k])) / 6
        assert np.allclose(got, want) and abs(base + got.sum() - score(point, (0, 1, 2))) < 1e-9
    raw = {r.id: r.rawPrediction[1] for r in model.transform(rows).collect()}
    assert all(abs(raw[i] * 2 - (base + v.sum())) < 1e-6 for (i, _), v in zip(data, values))
    out = explain.tree_shapley(model, rows, ["a", "b", "c"], "id", 2)
    assert out.count() == 300
