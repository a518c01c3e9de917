"""Rules, segmentation, analyses and scoring on small tables of their own."""

import datetime as dt

import pytest

from qissaflow.functions.dialect import SPARK
from qissaflow.operators import analysis, rules, scoring, segment

T0 = dt.datetime(2025, 1, 1)


def applied(spark, make, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    steps = make(SPARK)
    for step in steps if isinstance(steps, list) else [steps]:
        df = df.selectExpr("*", *(f"{v} AS {k}" for k, v in step.items()))
    return df.collect()


def test_post_filter_scores(spark):
    texts = ["جاء بهلول", "قال مجنون ولكن حكيم عاقل صدقت", "قال لكن", "لكن قال", "شيء", "قال أحمق ثم ضحكوا"]
    got = applied(spark, rules.post_filter_steps, texts)
    assert [(r.category, round(r.filter_score, 3), r.filter_class) for r in got] == [
        ("canonical_fool", 1.0, "canonical"), ("true_majnun", 0.9, "true"), ("true_majnun", 0.3, "weak"), ("false_positive", 0.0, "rejected"), ("false_positive", 0.0, "rejected"), ("true_majnun", 0.3, "weak"),
    ]


def test_strict_classes_leave_some_without_a_class(spark):
    got = applied(spark, rules.strict_steps, ["قال سعدون", "رجل مجنون", "قال هذا إلا ذاك", "قال هذا", "لا شيء", ""])
    assert [r.strict_class for r in got] == ["canonical", "true_majnun", "true_majnun", "dialogue_only", None, None]


def test_seven_rules_and_genres(spark):
    long = "قال مجنون له عقل فضحك " + "كلمة " * 60
    got = applied(spark, rules.seven_rules, [long, "% بيت\n% بيت\n% بيت\nنثر", ""])
    assert got[0].rule_score == 6 and got[0].rule_positive and not got[1].r6_not_verse and not got[2].r7_length
    genres = applied(spark, rules.genre, ["ولد في", "قال وقال", "قال", "الحكمة", "شعر", "حرب", "لا"])
    assert [r.genre_class for r in genres] == ["biographical", "dialogue", "narrative", "wisdom", "poetry", "historical", "mixed"]


def test_probabilities_that_are_missing_fail_every_threshold(spark):
    rows = [(1, 0.9, 0.9), (2, float("nan"), 0.9), (3, None, None), (4, 0.5, 0.49)]
    df = spark.createDataFrame(rows, "pred_id int, lr_prob double, xgb_prob double")
    got = {r.pred_id: r for r in analysis.run("decisions", df).collect()}
    assert [got[k].quadrant for k in (1, 2, 3, 4)] == ["both", "xgb_only", "neither", "lr_only"] and got[1].strict and got[2].lr_positive == 0 and got[3].mean_prob is None


def lines(path, *texts, at=T0):
    return [(path, k, t, at) for k, t in enumerate(texts)]


@pytest.mark.parametrize("size", [10_000, 2])
def test_segments_do_not_depend_on_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(segment, "RANGE", size)
    word = "مجنون " * 20
    rows = lines("a", "x", "#META#Header#End#", "# " + word, "~~" + word, "stray " + word, "~~" + word, "# | قسم", "~~" + word, None, "~~قصير", "#META#Header#End#", "# " + word)
    rows += lines("b", "# " + word) + lines("c", "#META#Header#End#", "~~old", at=T0) + [("c", 1, "~~" + word, T0 + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "path string, pos int, line string, loaded_at timestamp")
    one = word.strip()
    scan = [(r.path, r.idx, r.text) for r in segment.scan_units(df).orderBy("path", "idx").collect()]
    assert scan == [("a", 0, f"{one} {one}"), ("a", 1, one), ("a", 2, one), ("a", 3, one), ("c", 0, one)]
    cascade = [r.text for r in segment.cascade_raw(df).where("path = 'a'").orderBy("unit").collect()]
    assert cascade == [f"{one} {one} stray {one} {one}", f"{one} قصير", one]
    assert segment.cascade_units(df.limit(0)).collect() == [] and segment.v50_units(df).count() == 5


def test_bins_and_sweeps_keep_empty_ones(spark):
    df = spark.createDataFrame([(1, "قال", 0.95, 1.0), (2, None, 0.05, None)], "pred_id bigint, text string, lr_prob double, xgb_prob double")
    bins = {round(r.level, 1): (r.lr_n, r.xgb_n) for r in analysis.run("score_histogram", df).collect()}
    assert len(bins) == 10 and bins[0.9] == (1, 0) and bins[0.0] == (1, 0) and bins[0.5] == (0, 0)
    sweep = {r.level: (r.hits, r.likely_false) for r in analysis.run("threshold_sweep", df).collect()}
    assert len(sweep) == 7 and sweep[0.9] == (1, 1)


def test_auc_by_ranks_with_ties(spark):
    rows = [(1, True, 0.8, 0.1), (2, False, 0.8, 0.9), (3, True, 0.9, 0.2), (4, False, 0.1, 0.3), (5, None, 0.5, 0.5), (6, True, None, 0.1)]
    df = spark.createDataFrame(rows, "ex_id int, is_true_majnun boolean, lr_prob double, xgb_prob double")
    assert analysis.run("auc_ranks", df).first().auc == 0.875


def test_linear_score_and_contributions_agree(spark):
    model = {"a": (1.0, 2.0, 0.5), "b": (0.0, 0.0, -1.0)}
    df = spark.createDataFrame([(1, 3.0, 2.0), (2, None, float("nan"))], "id int, a double, b double")
    p = {r.id: r.lr_prob for r in scoring.linear_score(df, model, 0.25).collect()}
    assert abs(p[1] - 1 / (1 + 2.718281828459045 ** -(0.25 + 0.5 - 2.0))) < 1e-12
    got = [(r.rank, r.feature, r.added) for r in scoring.contributions(df.where("id = 1"), ["id"], model).orderBy("rank").collect()]
    assert got == [(1, "b", -2.0), (2, "a", 0.5)]


def test_patterns_are_found_where_any_term_is():
    import re

    from qissaflow.functions.dialect import pattern
    from qissaflow.functions.lexicons import TRAIN

    terms = [*TRAIN["JUNUN_TERMS"], "a.b", "a*", "ab"]
    found = re.compile(pattern(terms))
    for text in ["", "المجنون", "مجن", "ذهب", "ذه", "axb", "a.b", "xa*", "abc", "a", *TRAIN["JUNUN_TERMS"]]:
        assert bool(found.search(text)) == any(t in text for t in terms)
