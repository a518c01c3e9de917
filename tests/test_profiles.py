"""Feature profiles on the three narratives, against hand-computed figures and plain definitions."""

import pytest

from qissaflow.functions.dialect import SPARK
from qissaflow.functions.lexicons import SMALL, TRAIN
from qissaflow.operators import profiles

POS = "رأيت مجنوناً بالبصرة فسألته عن الحكمة فقال العقل في ترك العقل فضحك الخليفة وأعطاه ألف درهم"
NEG = "قال الشاعر في وصف الربيع والخضرة والأزهار الجميلة والطير المغرد"
WASF = "المجنون هو من ذهب عقله ومن أنواعه المعتوه والمدله والأحمق"


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([("pos", POS, 1), ("neg", NEG, 2), ("wasf", WASF, 3), ("empty", "", 4), ("null", None, 5)], "id string, text string, n int")
    return {r.id: r for r in profiles.features(df, ["id"], "text", "train74").collect()}


def test_figures_of_the_three_narratives(rows):
    p, n, w = rows["pos"], rows["neg"], rows["wasf"]
    assert (p.f01_junun_density, n.f01_junun_density, w.f01_junun_density) == (1 / 16, 0, 3 / 10)
    assert (p.f03_junun_count, n.f03_junun_count, w.f03_junun_count) == (0.4, 0, 0.8)
    assert (p.f05_junun_position, n.f05_junun_position, w.f05_junun_position) == (5 / 90, 0.5, 0.5)
    assert (p.f16_aql_density, p.f17_aql_count, w.f16_aql_density) == (2 / 16, 0.3, 1 / 10)
    assert (p.f24_hikma_density * 16, p.f29_qala_density * 16, p.f40_validation_density * 16) == (2, 3, 3)
    assert (n.f52_has_authority, p.f52_has_authority, n.f56_has_shir, n.f59_has_spatial, p.f59_has_spatial) == (0, 1, 1, 1, 1)


def test_nearness_looks_at_first_places_only(rows):
    def near(text, one, other, window):
        for a in one:
            k = text.find(a)
            if k >= 0 and any(b in text[max(0, k - window) : k + len(a) + window] for b in other):
                return 1.0
        return 0.0

    for name, text in (("pos", POS), ("neg", NEG), ("wasf", WASF)):
        r = rows[name]
        assert r.f19_junun_aql_proximity == near(text, TRAIN["JUNUN_TERMS"], TRAIN["AQL_TERMS"], 80)
        assert r.f13_junun_good_context == near(text, TRAIN["JUNUN_TERMS"], SMALL["CONTEXT"], 20)
        assert r.f26_hikma_qala_prox == near(text, TRAIN["HIKMA_TERMS"], TRAIN["QALA_VARIANTS"], 80)


def test_empty_and_null_are_alike(rows):
    assert rows["empty"][1:] == rows["null"][1:] and rows["empty"].f05_junun_position == 0.5 and rows["empty"].f12_junun_positive == 1


def test_long_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "مجنون " * 20_000, "x"), (1, "مجنون " * 20_000, "y")], "t int, text string, n string")
    got = profiles.features(df.selectExpr("t AS id", "text", "n AS toks"), ["id"], "text", "train74", "junun").collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].f10_junun_repetition == 1.0
    assert profiles.features(df.limit(0).selectExpr("t AS id", "text"), ["id"], "text", "cascade74").collect() == []


def test_profiles_have_their_widths():
    width = {k: sum(map(len, f(SPARK).values())) for k, f in profiles.PROFILES.items()}
    assert width == {"train74": 65, "v50": 62, "v50scan": 62, "cascade74": 74}
