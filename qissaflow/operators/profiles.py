"""Feature profiles: named columns of features of a narrative, in blocks.

A profile is a function of a dialect that gives, for each block, the features' names and expressions over the columns ``t``
(the text; null counts as empty), ``toks`` and ``n`` (``train74``, ``v50``, ``v50scan``) or ``t``, ``s`` (without marks, in lower case), ``words`` and ``d``
(``cascade74``). ``features`` puts them over a table, in one pass, without Python; ``features_in_batches`` computes ``train74`` in Python.

Kept on purpose: the first place counts as absent in f05 of ``train74``; nearness looks at a term's first place only; terms
that a list repeats count twice; terms match inside words; the profiles give one number different meanings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from qissaflow.functions.dialect import DUCK, SPARK, Dialect, Plain
from qissaflow.functions.lexicons import CASCADE, SMALL, TRAIN, V50
from qissaflow.sources.shared import spread

TOKEN = "[ء-يٱ-ۓ]+"
Block = dict[str, str]


def _long(terms: list[str], n: int) -> list[str]:
    return [x for x in terms if len(x) > n]


def _train(d: Dialect, lists: dict[str, list[str]]) -> dict[str, Block]:
    x = lists
    junun, aql, hikma, qala = x["JUNUN_TERMS"], x["AQL_TERMS"], x["HIKMA_TERMS"], x["QALA_VARIANTS"]
    laugh, gift, cry = x["VALIDATION.laugh"], x["VALIDATION.gift"], x["VALIDATION.cry"]
    three, four = laugh + gift + cry, laugh + gift + cry + x["VALIDATION.silence"]
    opposition, correction, revelation = x["CONTRAST.opposition"], x["CONTRAST.correction"], x["CONTRAST.revelation"]
    contrast = opposition + correction + revelation + x.get("CONTRAST.surprise_formula", [])
    t, size = "t", "greatest(length(t), 1)"
    share = lambda terms: f"({d.members('toks', terms)} / {d.double('n')})"
    density = lambda terms: f"({d.distinct(t, terms)} / {d.double('n')})"
    capped = lambda terms, k: f"(least({d.distinct(t, terms)}, {k}) / {k}.0E0)"
    has = lambda terms: d.flag(d.any(t, terms))
    title = lambda terms, k=50: d.flag(d.any(d.head(t, k), terms))
    final = lambda terms: d.flag(d.any(d.third(t), terms))
    near = lambda one, other, w: d.flag(d.near(t, one, other, w))
    is_junun = d.both(d.any(t, junun), d.none(t, SMALL["VETO"]))
    place = d.first(t, junun)
    said, told = d.first(t, ["قال"]), d.first(t, ["قلت"])
    return {
        "junun": {
            "f00_has_junun": d.flag(is_junun),
            "f01_junun_density": share(junun),
            "f02_famous_fool": has(x["FAMOUS_FOOLS"]),
            "f03_junun_count": capped(junun, 10),
            "f04_junun_specialized": has(_long(junun, 4)),
            "f05_junun_position": d.case(f"coalesce({place}, 0) > 0", f"({place}) / {d.double(size)}", "0.5E0"),
            "f06_junun_in_title": title(junun),
            "f07_junun_plural": has(SMALL["PLURAL"]),
            "f08_junun_in_final_third": final(junun),
            "f09_jinn_root": has(SMALL["JINN_ROOT"]),
            "f10_junun_repetition": f"least({d.occurrences(t, junun)} / {d.double('n')}, 1.0E0)",
            "f11_junun_morpho": has(SMALL["MORPHO"]),
            "f12_junun_positive": d.flag(d.none(t, SMALL["NEG_JUNUN"])),
            "f13_junun_good_context": near(junun, SMALL["CONTEXT"], 20),
            "f14_junun_validation_prox": near(junun, three, 100),
        },
        "aql": {
            "f15_has_aql": has(aql),
            "f16_aql_density": share(aql),
            "f17_aql_count": capped(aql, 10),
            "f18_paradox_junun_aql": d.flag(d.both(is_junun, d.any(t, aql))),
            "f19_junun_aql_proximity": near(junun, aql, 80),
            "f20_junun_aql_ratio": f"least({share(junun)} / ({share(aql)} + 1.0E-3), 10.0E0)",
            "f21_superlatives": has(SMALL["SUPERLATIVES"]),
            "f22_aql_positive": d.flag(d.none(t, SMALL["NEG_AQL"])),
        },
        "hikma": {
            "f23_has_hikma": has(hikma),
            "f24_hikma_density": density(hikma),
            "f25_hikma_junun_prox": near(hikma, junun, 80),
            "f26_hikma_qala_prox": near(hikma, qala, 80),
            "f27_hikma_in_title": title(hikma),
        },
        "dialogue": {
            "f28_has_qala": has(qala),
            "f29_qala_density": density(qala),
            "f30_has_first_person": has(x["FIRST_PERSON"]),
            "f31_first_person_density": density(x["FIRST_PERSON"]),
            "f32_junun_near_qala": near(junun, qala, 80),
            "f33_has_questions": has(x["QUESTIONS"]),
            "f34_question_density": density(x["QUESTIONS"]),
            "f35_question_answer": d.flag(d.both(d.any(t, x["QUESTIONS"]), d.any(t, qala))),
            "f36_dialogue_structure": d.flag(f"{d.occurrences(t, ['قال', 'قلت'])} >= 2"),
            "f37_qala_position": f"coalesce({d.quotient(f'coalesce({said}, {told})', d.double(size))}, 0.5E0)",
            "f38_qala_in_final": final(qala),
        },
        "validation": {
            "f39_has_validation": has(four),
            "f40_validation_density": density(four),
            "f41_validation_laugh": has(laugh),
            "f42_validation_gift": has(gift),
            "f43_validation_cry": has(cry),
            "f44_validation_in_final": final(four),
            "f45_validation_multiple": d.flag(f"{has(laugh)} + {has(gift)} + {has(cry)} > 1"),
            "f46_validation_junun_prox": near(four, junun, 100),
        },
        "contrast": {
            "f47_has_contrast": has(contrast),
            "f48_contrast_density": density(contrast),
            "f49_contrast_opposition": has(opposition),
            "f50_contrast_correction": has(correction),
            "f51_contrast_revelation": has(revelation),
        },
        "authority": {
            "f52_has_authority": has(x["AUTHORITY"]),
            "f53_authority_count": capped(x["AUTHORITY"], 5),
            "f54_authority_junun_prox": near(x["AUTHORITY"], junun, 100),
            "f55_authority_in_title": title(x["AUTHORITY"]),
        },
        "poetry": {
            "f56_has_shir": has(x["SHIR_MARKERS"]),
            "f57_shir_density": density(x["SHIR_MARKERS"]),
            "f58_shir_alone": d.flag(d.both(d.any(t, x["SHIR_MARKERS"]), d.none(t, qala))),
        },
        "spatial": {
            "f59_has_spatial": has(x["SPATIAL"]),
            "f60_spatial_density": density(x["SPATIAL"]),
            "f61_spatial_variety": f"({d.distinct(t, x['SPATIAL'])} / {len(x['SPATIAL'])}.0E0)",
        },
        "wasf": {
            "f62_has_wasf": has(x["WASF_MARKERS"]),
            "f63_wasf_density": density(x["WASF_MARKERS"]),
            "f64_wasf_in_title": title(x["WASF_MARKERS"], 80),
        },
    }


def train74(d: Dialect) -> dict[str, Block]:
    """The 65 lexical features of training; the nine of morphology come from ``morphology``."""
    return _train(d, TRAIN)


def v50(d: Dialect) -> dict[str, Block]:
    """The older profile: the same formulas up to f61 with shorter lists."""
    return {"v50": {k: v for b in _train(d, TRAIN | V50).values() for k, v in b.items() if int(k[1:3]) <= 61}}


def v50scan(d: Dialect) -> dict[str, Block]:
    """The reduced scan profile: 23 of 62 slots are filled, the others are 0; a text without tokens is all 0."""
    x = TRAIN | V50
    t = "t"
    contrast = [c for k in ("opposition", "correction", "revelation", "surprise_formula") for c in x[f"CONTRAST.{k}"] if len(c) > 1]
    four = [v for k in ("laugh", "gift", "cry", "silence") for v in x[f"VALIDATION.{k}"]]
    share = lambda terms: f"{d.members('toks', terms)} / CAST(n AS DOUBLE)"
    density = lambda terms: f"{d.distinct(t, terms)} / CAST(n AS DOUBLE)"
    is_junun = d.both(d.any(t, x["JUNUN_TERMS"]), d.none(t, SMALL["VETO"]))
    slots = {
        0: d.flag(is_junun), 1: share(x["JUNUN_TERMS"]), 2: d.flag(d.any(t, x["FAMOUS_FOOLS"])),
        15: d.flag(d.any(t, x["AQL_TERMS"])), 16: share(x["AQL_TERMS"]), 18: d.flag(d.both(is_junun, d.any(t, x["AQL_TERMS"]))),
        23: d.flag(d.any(t, x["HIKMA_TERMS"])), 24: share(x["HIKMA_TERMS"]),
        28: d.flag(d.any(t, x["QALA_VARIANTS"])), 29: share(x["QALA_VARIANTS"]), 30: d.flag(d.any(t, x["FIRST_PERSON"])), 31: share(x["FIRST_PERSON"]),
        33: d.flag(d.any(t, x["QUESTIONS"])), 34: share(x["QUESTIONS"]), 35: d.flag(d.both(d.any(t, x["QALA_VARIANTS"]), d.any(t, x["QUESTIONS"]))),
        39: d.flag(d.any(t, four)), 40: f"{d.regex_count(t, '|'.join(four))} / CAST(n AS DOUBLE)",
        47: d.flag(d.any(t, contrast)), 48: density(x["CONTRAST.opposition"]),
        52: d.flag(d.any(t, x["AUTHORITY"])), 53: d.flag(d.any(t, x["AUTHORITY"])),
        56: d.flag(d.any(t, x["SHIR_MARKERS"])), 57: density(x["SHIR_MARKERS"]),
    }
    some = f"{d.size('toks')} > 0"
    return {"v50scan": {f"s{k:02}": f"CASE WHEN {some} THEN {slots[k]} ELSE 0.0E0 END" if k in slots else "0.0E0" for k in range(62)}}


def cascade74(d: Dialect) -> dict[str, Block]:
    """The production profile. The morphological features f65 to f72 are 0 in it; terms lose their marks, too."""
    import unicodedata

    def bare(term: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", term.lower()) if unicodedata.category(c) != "Mn")

    x = {k: [bare(t) for t in v] for k, v in CASCADE.items()}
    s = "s"
    has = lambda terms: d.flag(d.any(s, [bare(t) for t in terms]))
    title = lambda terms: d.flag(d.any(d.head(s, 200), terms))
    final = lambda terms: d.flag(d.any(d.last(s, 200), terms))

    def count(terms: list[str]) -> str:
        """Occurrences as whole words, each entry of the list by itself."""
        single, several = [t for t in terms if " " not in t], [t for t in terms if " " in t]
        parts = []
        for times in {single.count(t) for t in single}:
            parts.append(f"{times} * {d.members('words', sorted({t for t in single if single.count(t) == times}))}")
        # Blanks are doubled in ``gaps``, so that neighbours don't share their boundary.
        parts += [d.regex_count("gaps", r"(?:^|[^\p{L}\p{N}_])" + t.replace(" ", "  ") + r"(?:$|[^\p{L}\p{N}_])") for t in several]
        return "(" + " + ".join(parts) + ")"

    per = lambda terms, k: f"({count(terms)} / greatest(length(s) / {k}.0E0, 1.0E0))"
    junun, aql, hikma, qala, valid = (d.any(s, x[k]) for k in ("JUNUN_TERMS", "AQL_TERMS", "HIKMA_TERMS", "QALA_TERMS", "VALIDATION_TERMS"))
    authority, shir = d.any(s, x["AUTHORITY_TERMS"]), d.any(s, x["SHIR_TERMS"])
    flag, both = d.flag, d.both
    return {
        "cascade_a": {
            "c00_has_junun": flag(junun),
            "c01_junun_density": per(x["JUNUN_TERMS"], 100),
            "c02_famous_fool": has(CASCADE["FAMOUS_FOOLS"]),
            "c03_junun_count": per(x["JUNUN_TERMS"], 200),
            "c04_junun_specialized": has(["مجنون", "معتوه", "هائم"]),
            "c05_junun_position": f"CASE WHEN {count(x['JUNUN_TERMS'])} > 0 THEN 0.5E0 ELSE 0.0E0 END",
            "c06_junun_in_title": title(x["JUNUN_TERMS"]),
            "c07_junun_plural": has(["مجانين", "المجانين"]),
            "c08_jinn_root": has(["جنن", "جنون"]),
            "c09_junun_morpho": has(["معتوه", "هائم", "ممسوس"]),
            "c10_junun_positive": flag(junun),
            "c11_junun_good_context": flag(both(junun, qala)),
            "c12_junun_validation_prox": flag(both(junun, valid)),
            "c13_junun_near_qala": flag(both(junun, qala)),
            "c14_junun_variant_forms": has(["مجنونا", "بمجنون", "المجنونة"]),
            "c15_has_aql": flag(aql),
            "c16_aql_density": per(x["AQL_TERMS"], 100),
            "c17_aql_count": per(x["AQL_TERMS"], 200),
            "c18_paradox_junun_aql": flag(both(junun, aql)),
            "c19_junun_aql_proximity": flag(both(junun, aql)),
            "c20_junun_aql_ratio": f"({count(x['JUNUN_TERMS'])} / CAST(greatest({count(x['AQL_TERMS'])}, 1) AS DOUBLE))",
            "c21_superlatives": has(["أعقل", "أحكم", "أصوب"]),
            "c22_aql_variant_forms": has(["عقله", "عقلي", "عقلك"]),
        },
        "cascade_b": {
            "c23_has_hikma": flag(hikma),
            "c24_hikma_density": per(x["HIKMA_TERMS"], 100),
            "c25_hikma_junun_prox": flag(both(junun, hikma)),
            "c26_hikma_qala_prox": flag(both(hikma, qala)),
            "c27_hikma_in_title": title(x["HIKMA_TERMS"]),
            "c28_has_qala": flag(qala),
            "c29_qala_density": per(x["QALA_TERMS"], 100),
            "c30_has_first_person": has(["قلت", "أقول", "قالوا"]),
            "c31_first_person_density": per([bare("قلت"), bare("أقول")], 200),
            "c32_junun_near_qala": flag(both(junun, qala)),
            "c33_has_questions": flag(d.any("t", ["؟"])),
            "c34_question_density": f"({d.occurrences('t', ['؟'])} / greatest(length(s) / 200.0E0, 1.0E0))",
            "c35_question_answer": flag(both(d.any("t", ["؟"]), d.any("t", ["،"]))),
            "c36_dialogue_structure": flag(f"{count(x['QALA_TERMS'])} >= 2"),
            "c37_qala_position": flag(qala),
            "c38_qala_in_final": final(x["QALA_TERMS"]),
        },
        "cascade_c": {
            "c39_has_validation": flag(valid),
            "c40_validation_density": per(x["VALIDATION_TERMS"], 100),
            "c41_validation_laugh": has(["ضحك", "يضحك", "ضاحك"]),
            "c42_validation_gift": has(["أهدى", "هدية", "هدايا"]),
            "c43_validation_cry": has(["بكى", "يبكي", "بكاء"]),
            "c44_validation_in_final": final(x["VALIDATION_TERMS"]),
            "c45_validation_multiple": flag(f"{count(x['VALIDATION_TERMS'])} >= 2"),
            "c46_validation_junun_prox": flag(both(junun, valid)),
            "c47_has_contrast": flag(d.any(s, x["CONTRAST_TERMS"])),
            "c48_contrast_density": per(x["CONTRAST_TERMS"], 100),
            "c49_contrast_opposition": has(["لكن"]),
            "c50_contrast_correction": has(["بل"]),
            "c51_contrast_revelation": has(["فإذا", "وإذا"]),
        },
        "cascade_d": {
            "c52_has_authority": flag(authority),
            "c53_authority_count": per(x["AUTHORITY_TERMS"], 200),
            "c54_authority_junun_prox": flag(both(junun, authority)),
            "c55_authority_in_title": title(x["AUTHORITY_TERMS"]),
            "c56_has_shir": flag(shir),
            "c57_shir_density": per(x["SHIR_TERMS"], 100),
            "c58_shir_alone": flag(both(shir, f"NOT {junun}")),
            "c59_has_wasf": flag(d.any(s, x["WASF_TERMS"])),
            "c60_wasf_density": per(x["WASF_TERMS"], 100),
            "c61_wasf_in_title": title(x["WASF_TERMS"]),
            "c62_text_length_norm": "least(length(s) / 500.0E0, 1.0E0)",
            "c63_positive_indicator": f"({flag(junun)} + {flag(both(junun, aql))}) / 2",
            "c64_narrative_structure": flag(both(qala, valid)),
            **{f"c{k}_{name}": "0.0E0" for k, name in zip(range(65, 73), ("root_jnn", "root_aql", "root_hikma", "verb", "noun", "adj", "perf", "passive"))},
            "c73_consensus_validation": f"({flag(both(junun, aql))} + {flag(valid)}) / 2",
        },
    }


def token_bases(d: Dialect) -> list[tuple[str, str]]:
    return [("toks", d.tokens("t", TOKEN)), ("n", f"greatest({d.size('toks')}, 1)")]


def bases(d: Dialect) -> dict[str, list[tuple[str, str]]]:
    """The columns that each kind of profile is made of, step by step."""
    tokens = token_bases(d)
    bare = [("s", d.bare("lower(t)")), ("words", d.tokens("s", r"[\p{L}\p{N}_]+")), ("gaps", d.replace_all("s", r"([^\p{L}\p{N}_])", "$1$1"))]
    return {"train74": tokens, "v50": tokens, "v50scan": tokens, "cascade74": bare}


PROFILES: dict[str, Callable[[Dialect], dict[str, Block]]] = {"train74": train74, "v50": v50, "v50scan": v50scan, "cascade74": cascade74}


def features(df: DataFrame, id_columns: list[str], text_column: str, profile: str, block: str | None = None) -> DataFrame:
    """The ids and the features of a profile, or of one of its blocks."""
    blocks = PROFILES[profile](SPARK)
    wanted = blocks[block] if block else {k: v for b in blocks.values() for k, v in b.items()}
    base = df.selectExpr(*(f"`{c}`" for c in id_columns), f"coalesce(`{text_column}`, '') AS t")
    base = base if base.isStreaming else spread(base)
    for name, expression in bases(SPARK)[profile]:
        base = base.selectExpr("*", f"{expression} AS {name}")
    return base.selectExpr(*(f"`{c}`" for c in id_columns), *(f"CAST({v} AS DOUBLE) AS {k}" for k, v in wanted.items()))


def features_in_batches(df: DataFrame, id_columns: list[str], text_column: str, profile: str = "train74") -> DataFrame:
    """The same as ``features`` for ``train74``, by the same definitions, in Arrow batches: for whole corpora, where SQL takes
    milliseconds for a text."""
    if profile != "train74":
        raise ValueError(f"no Python for {profile}")
    names = [k for b in PROFILES[profile](SPARK).values() for k in b]
    base = spread(df.selectExpr(*(f"`{c}`" for c in id_columns), f"coalesce(CAST(`{text_column}` AS STRING), '') AS t"))
    kinds = [StructField(k, DoubleType(), False) for k in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Plain()
        cells = [v for b in PROFILES[profile](d).values() for v in b.values()]
        values_of = d.function([f"{name} = {line}" for name, line in token_bases(d)], cells)
        for batch in batches:
            # bytes that are no UTF-8 are read as the JVM does
            texts = (x.decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist())
            own = np.array([values_of(t) for t in texts], np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, own.T.copy())], [*id_columns, *names])

    return base.mapInArrow(run, StructType([*base.schema.fields[:-1], *kinds]))


def features_sql(table: str, id_columns: list[str], text_column: str, profile: str, block: str | None = None) -> str:
    """The same for DuckDB."""
    blocks = PROFILES[profile](DUCK)
    wanted = blocks[block] if block else {k: v for b in blocks.values() for k, v in b.items()}
    ids = ", ".join(id_columns)
    query = f"SELECT {ids}, coalesce({text_column}, '') AS t FROM {table}"
    for name, expression in bases(DUCK)[profile]:
        query = f"SELECT *, {expression} AS {name} FROM ({query})"
    return f"SELECT {ids}, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in wanted.items()) + f" FROM ({query})"


def lexicon_flags(df: DataFrame, id_columns: list[str], text_column: str, lexicons: dict[str, list[str]]) -> DataFrame:
    """For each of any number of lexicons: whether the text has a term of it, how many of its terms, and how often they occur."""
    t = f"coalesce(`{text_column}`, '')"
    cells = [f"CAST({e} AS DOUBLE) AS {name}_{k}" for name, terms in lexicons.items() for k, e in (("any", SPARK.flag(SPARK.any(t, terms))), ("terms", SPARK.distinct(t, terms)), ("times", SPARK.occurrences(t, terms)))]
    return spread(df).selectExpr(*(f"`{c}`" for c in id_columns), *cells)


def feature_check(features: DataFrame, columns: list[str]) -> DataFrame:
    """For each feature: its ends, mean, the share of zeros, and how often it is missing or NaN."""
    from pyspark.sql import functions as F

    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("f")
    v = F.col("f.v")
    return features.select(cells).groupBy(F.col("f.feature").alias("feature")).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 9).alias("mean"), F.round(F.avg((v == 0).cast("int")), 6).alias("zero_share"), F.count_if(v.isNull() | F.isnan(v)).alias("missing"))
