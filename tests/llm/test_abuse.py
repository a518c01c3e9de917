"""Abusive texts: held-out accuracy on invented ones, and the defined results."""

import random

import numpy as np
from qissaflow.llm import abuse


def made(n, seed):
    rng = random.Random(seed)
    filler = "the merchant sells old cloth near gate of garden while judge reads long letters at night".split() + "قال الشيخ في المجلس ثم كان له بيت على النهر".split()
    bad = ["shut up you worthless scum", "you are a filthy pig", "ferme ta gueule espèce de porc", "لعنك الله يا كلب", "w.h.o.r.e you liar", "anta kalb ya 7mar"]
    good = ["the pig sleeps in the yard", "le mot porc dans le lexique", "كان له كلب يحرس الغنم", "a note on the word whore"]
    rows = []
    for _ in range(n):
        words = [rng.choice(filler) for _ in range(rng.randrange(5, 60))]
        label = int(rng.random() < 0.3)
        words.insert(rng.randrange(len(words)), rng.choice(bad if label else good) if rng.random() < 0.9 or label else "")
        rows.append((" ".join(words), label))
    return rows


def test_held_out_accuracy():
    train, held = made(800, 1), made(300, 2)
    model = abuse.Model([t for t, _ in train], [y for _, y in train])
    got = model.score([t for t, _ in held]) >= 0.5
    want = np.array([y for _, y in held], bool)
    assert (got & want).sum() / want.sum() > 0.95 and (got & want).sum() / got.sum() > 0.95


def test_words_are_found_in_disguise():
    for text, word in (("w.h.o.r.e", "whore"), ("WHO​RE", "whore"), ("coooonnard", "connard"), ("خ‍نازير", "خنازير"), ("كـــلب", "كلب"), ("كَلْب", "كلب"), ("ك ل ا ب", "كلاب")):
        assert list(map(abuse._same, abuse.plain_words(text)[0])) == [abuse._same(word)]


def test_calibration_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    score = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * score))).astype(float)
    xs, ys = abuse.isotonic(score, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all() and abs(np.interp(score, xs, ys).mean() - y.mean()) < 1e-9


def test_null_empty_unlabelled_and_repeated_rows(spark):
    rows = [(k, t, "a", 7.0) for k, (t, _) in enumerate(made(200, 3))]
    labels = [(k, y) for k, (_, y) in enumerate(made(200, 3))] + [(0, 1), (0, 0), (5, None), (999, 1)]
    rows += [(1000, None, None, 0.0), (1001, "", "b", 0.0), (1002, rows[1][1], "b", 0.0), (1003, "​  ", "b", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in abuse.scores(docs, marks, "doc_id", "text", "toxic").collect()}
    assert len(got) == 204 and got[1000] == got[1001] == got[1003] == 0 and got[1002] == got[1] and all(0 <= s <= 1 for s in got.values())
    rates = {r.source: r for r in abuse.rates(docs, marks, "doc_id", "text", "toxic", "source").collect()}
    assert rates["a"].documents == 200 and rates[None].abusive == 0 and rates["b"].documents == 3


def test_without_labels_every_score_is_zero(spark):
    docs = spark.createDataFrame([(1, "you worthless scum")], "doc_id bigint, text string")
    marks = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.score for r in abuse.scores(docs, marks, "doc_id", "text", "toxic").collect()] == [0.0]
    assert abuse.abusive(docs.limit(0), marks, "doc_id", "text", "toxic").collect() == []
