"""Cleaning, normalising, counting and the split of chains against plain definitions."""

import re
import unicodedata

import pytest

from qissaflow.functions import isnad
from qissaflow.functions import text as T
from qissaflow.functions.dialect import SPARK

TEXTS = ["", "قالَ مُجَنُّونٌ ms0123 PageV01P023 ثم", "% نصف % ونصف % آخر |", "^ ( آية ) ^ قال [ سورة ] ^", "ms12345 ms1 xms1234 ms1234", "قال مجنون وقال عاقل ثم قال مجنون", "é ü قلت\n%~% بيت\n", "  a   b\t\n", "المجنون" + " و" * 60 + " العقل مجنون عاقل"]


@pytest.fixture(scope="module")
def made(spark):
    d = SPARK
    exprs = {
        "meta": T.clean_metadata(d, "t"), "lib": T.normalize_lib(d, "t"), "bare": d.bare("lower(t)"), "poetry": T.poetry_ratio(d, "t"),
        "every": T.every_place(d, "t", ["مجنون", "المجنون"], ["عقل", "عاقل"], 20), "block": T.letters_block(d, "t"), "lo": T.letters_lo(d, "t"),
    }
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    return [r for r in df.selectExpr("k", "t", *(f"{v} AS {k}" for k, v in exprs.items())).orderBy("k").collect()]


def test_markup_is_gone(made):
    for r in made:
        assert not re.search(r"PageV|[\^%\[\]|]|\bms\d{4,5}\b", r.meta) and r.meta == " ".join(r.meta.split())
    assert made[1].meta == "قالَ مُجَنُّونٌ ثم" and made[2].meta == "ونصف آخر" and made[4].meta == "ms1 xms1234"


def test_normalisers(made):
    for r in made:
        plain = "".join(c for c in unicodedata.normalize("NFD", r.t.lower()) if unicodedata.category(c) != "Mn")
        assert r.bare == plain
    assert made[1].lib.startswith("قال مجنون ms0123")


def test_counts_and_windows(made):
    for r in made:
        assert r.block == sum("؀" <= c <= "ۿ" for c in r.t)
        assert r.lo == sum("؀" <= c <= "ۿ" and unicodedata.category(c) == "Lo" for c in r.t)
        want = 0
        for a in ("مجنون", "المجنون"):
            for m in re.finditer(a, r.t):
                want += any(b in r.t[max(0, m.start() - 20) : m.end() + 20] for b in ("عقل", "عاقل"))
        assert r.every == want
    assert made[6].poetry == 1 / 3 and made[0].poetry == 0


def test_chain_is_split_at_the_last_marker_of_the_dense_part():
    chain = "حدثنا محمد بن علي عن أبي بكر عن سعيد بن جابر قال"
    story = "رأيت مجنوناً بالبصرة فسألته عن الحكمة فضحك ثم مضى ولم يجب بشيء وكان ذلك في يوم شديد الحر"
    assert isnad.split_isnad(f"{chain} {story}") == (chain, story)
    assert isnad.split_isnad(f"{chain} رأيت مجنوناً بالبصرة")[0] == ""  # what follows is too short
    assert isnad.split_isnad(story) == ("", story) and isnad.split_isnad("") == ("", "")


def test_scores_of_tokens():
    assert [isnad.token_score(t) for t in ("حدثنا", "بن", "أبو", "محمد", "المجنون", "في")] == [1.5, 0.8, 0.7, 0.3, 0.0, 0.0]


def test_split_as_a_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "قال " * 30_000)], "id int, text string")
    got = {r.id: (r.p.isnad, r.p.matn) for r in df.select("id", isnad.isnad_matn("text").alias("p")).collect()}
    assert got[1] == (None, None) and got[2] == ("", "") and got[3][0] == ""
