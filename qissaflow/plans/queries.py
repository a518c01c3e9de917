"""The registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qissaflow.functions import lexicons as L
from qissaflow.functions import text as T
from qissaflow.functions.dialect import DUCK, SPARK, Dialect
from qissaflow.operators import analysis, profiles, scoring, segment
from qissaflow.plans import model_queries
from qissaflow.sources.shared import spread

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _analysis(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.run(name, *(table(spark, sf_dir, t) for t in analysis.ANALYSES[name][0]))


for _name in analysis.ANALYSES:
    QUERIES[_name] = partial(_analysis, _name)
    ORACLES[_name] = analysis.duck_sql(_name)


def _features(profile: str, block: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.features(table(spark, sf_dir, "all_predictions"), ["pred_id"], "text", profile, block)


for _profile, _make in profiles.PROFILES.items():
    for _block in _make(SPARK):
        _name = f"{_block}_block" if _profile == "train74" else f"{_block}_features" if _profile != "cascade74" else f"{_block[:7]}_block{_block[7:]}"
        QUERIES[_name] = partial(_features, _profile, _block)
        ORACLES[_name] = profiles.features_sql("all_predictions", ["pred_id"], "text", _profile, _block)


def _text_columns() -> dict[str, Callable[[Dialect], dict[str, str]]]:
    """Functions over one text column: for each query its columns."""
    J, A, Q = L.TRAIN["JUNUN_TERMS"], L.TRAIN["AQL_TERMS"], L.TRAIN["QALA_VARIANTS"]
    return {
        "clean_metadata": lambda d: {"cleaned": T.clean_metadata(d, "t")},
        "clean_v50": lambda d: {"cleaned": T.clean_v50(d, "t")},
        "clean_signs": lambda d: {"cleaned": T.clean_signs(d, "t")},
        "normalize_lib": lambda d: {"normalized": T.normalize_lib(d, "t")},
        "normalize_cascade": lambda d: {"normalized": d.bare("lower(t)")},
        "normalize_isnad": lambda d: {"normalized": T.normalize_isnad(d, "t")},
        "word_counts": lambda d: {"n_words": d.size(T.words(d, "t")), "n_tokens": d.size(d.tokens("t", profiles.TOKEN)), "n_isnad": d.size(d.tokens("t", T.ISNAD_TOKEN))},
        "arabic_counts": lambda d: {"n_lo": T.letters_lo(d, "t"), "n_block": T.letters_block(d, "t"), "poetry": T.poetry_ratio(d, "t")},
        "lex_occurrences": lambda d: {"junun": d.occurrences(T.normalize_lib(d, "t"), J[:8]), "any_junun": d.any(T.normalize_lib(d, "t"), J)},
        "lex_any_flags": lambda d: {"junun": T.filtered_junun(d, "t", J), "aql": d.any("t", A)},
        "lex_distinct_counts": lambda d: {"junun": d.distinct("t", J), "aql": d.distinct("t", A), "qala": d.distinct("t", Q)},
        "lex_token_density": lambda d: {"junun": f"{d.members(d.tokens('t', profiles.TOKEN), J)}", "aql": f"{d.members(d.tokens('t', profiles.TOKEN), A)}"},
        "lex_proximity": lambda d: {"first_places": T.first_place_count(d, "t", J, A, 80), "every_place": T.every_place(d, "t", J[:4], A[:6], 80)},
        "catalogue_proximity": lambda d: {"within_80": T.within(d, "t", L.RULES["JUNUN_TERMS"], L.RULES["AQL_TERMS"], 80), "triple": d.both(d.near("t", J, Q, 150), d.near("t", J, A, 150))},
        "narrative_order": lambda d: T.structure(d, "t"),
        "enriched_flags": lambda d: {"junun": T.enriched_flag(d, "t", L.ENRICHED["JUNUN_ENRICHED"], L.ENRICHED["JUNUN_EXCLUDE"]), "hikma": T.enriched_flag(d, "t", L.ENRICHED["HIKMA_ENRICHED"], L.ENRICHED["HIKMA_EXCLUDE"]), "aql": d.flag(d.any("t", L.ENRICHED["AQL_ENRICHED"])), "qala": d.flag(d.any("t", L.ENRICHED["QALA_ENRICHED"]))},
        "marker_flags": lambda d: T.residual_markers(d, "t"),
    }


def _text(make: Callable[[Dialect], dict[str, str]], spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "all_predictions").where("text IS NOT NULL").selectExpr("pred_id", "text AS t"))
    return rows.selectExpr("pred_id", *(f"{v} AS {k}" for k, v in make(SPARK).items()))


for _name, _make in _text_columns().items():
    QUERIES[_name] = partial(_text, _make)
    ORACLES[_name] = "SELECT pred_id, " + ", ".join(f"{v} AS {k}" for k, v in _make(DUCK).items()) + " FROM (SELECT pred_id, text AS t FROM all_predictions WHERE text IS NOT NULL) AS b"


def _units(make: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return make(table(spark, sf_dir, "book_lines"))


QUERIES |= {"segment_scan": partial(_units, segment.scan_units), "segment_v50": partial(_units, segment.v50_units), "segment_cascade_raw": partial(_units, segment.cascade_raw), "segment_cascade": partial(_units, segment.cascade_units)}


def _segment_sql() -> dict[str, str]:
    d = DUCK
    lines = """lines AS (SELECT path, pos, coalesce(line, '') AS line FROM (SELECT *, row_number() OVER (PARTITION BY path, pos ORDER BY loaded_at DESC, line DESC NULLS LAST) AS k FROM book_lines) WHERE k = 1)"""
    body = """body AS (SELECT lines.*, CASE WHEN starts_with(line, '~~') THEN 'cont' WHEN starts_with(line, '# |') THEN 'section' WHEN starts_with(line, '# ') THEN 'head' ELSE 'other' END AS kind
        FROM lines JOIN (SELECT path, min(pos) AS header FROM lines WHERE contains(line, '#META#Header#End#') GROUP BY path) USING (path) WHERE pos > header AND NOT contains(line, '#META#Header#End#'))"""
    units = lambda begins: f"units AS (SELECT *, CAST(sum(CASE WHEN {begins} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS BIGINT) AS unit, {T.strip(d, 'CASE WHEN kind = ' + chr(39) + 'other' + chr(39) + ' THEN line ELSE substring(line, 3) END')} AS own FROM body)"
    joined = lambda where: f"texts AS (SELECT path, unit, string_agg(own, ' ' ORDER BY pos) AS text FROM units WHERE {where} GROUP BY path, unit)"
    kept = lambda text: f"SELECT path, row_number() OVER (PARTITION BY path ORDER BY unit) - 1 AS idx, text, n_ar FROM (SELECT path, unit, text, {T.letters_lo(d, 'text')} AS n_ar FROM (SELECT path, unit, {text} AS text FROM texts)) WHERE n_ar BETWEEN 80 AND 3000"
    open_members = "members AS (SELECT *, count(CASE WHEN kind IN ('cont', 'head') THEN 1 END) OVER (PARTITION BY path, unit ORDER BY pos) AS opened FROM units)"
    return {
        "segment_scan": f"WITH {lines}, {body}, {units('kind <> ' + chr(39) + 'cont' + chr(39))}, {joined('kind IN (' + chr(39) + 'cont' + chr(39) + ', ' + chr(39) + 'head' + chr(39) + ')')} {kept('text')}",
        "segment_v50": f"""WITH {lines}, {body}, {units("kind <> 'cont'")}, {joined("kind = 'cont' OR (kind = 'head' AND NOT contains(own, 'باب') AND NOT contains(own, 'فصل'))")} {kept(T.clean_v50(d, 'text'))}""",
        "segment_cascade_raw": f"""WITH {lines}, {body}, {units("kind IN ('head', 'section')")}, {open_members},
            texts AS (SELECT path, unit, string_agg(own, ' ' ORDER BY pos) AS text FROM members WHERE kind IN ('cont', 'head') OR (kind = 'other' AND opened > 0 AND own <> '') GROUP BY path, unit)
            SELECT path, unit, {T.clean_metadata(d, 'text')} AS text FROM texts""",
    }


ORACLES |= _segment_sql()


def isnad_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qissaflow.functions.isnad import isnad_matn

    rows = spread(table(spark, sf_dir, "all_predictions").where("text IS NOT NULL").select("pred_id", "text"))
    return rows.select("pred_id", isnad_matn("text").alias("parts")).select("pred_id", "parts.isnad", "parts.matn")


QUERIES["isnad_split"] = isnad_split


def _demo_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.features(table(spark, sf_dir, "all_predictions"), ["pred_id"], "text", "train74")


def linear_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.linear_score(_demo_features(spark, sf_dir), scoring.DEMO, scoring.INTERCEPT, "p")
    return scored.selectExpr("pred_id", "round(p, 9) AS p").orderBy(F.desc("p"), "pred_id").limit(20)


def feature_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.contributions(_demo_features(spark, sf_dir), ["pred_id"], scoring.DEMO, 5)
    return rows.withColumn("added", F.round("added", 9))


def _demo_sql() -> dict[str, str]:
    feats = profiles.features_sql("all_predictions", ["pred_id"], "text", "train74")
    parts = {k: scoring.part(k, *v).replace("AS STRING) IN ('NaN', 'Infinity', '-Infinity')", "AS VARCHAR) IN ('nan', 'inf', '-inf')") for k, v in scoring.DEMO.items()}
    total = " + ".join([f"{scoring.INTERCEPT!r}E0", *parts.values()])
    union = " UNION ALL ".join(f"SELECT pred_id, '{k}' AS feature, {v} AS added FROM f" for k, v in parts.items())
    return {
        "linear_score_topk": f"SELECT pred_id, round(1.0E0 / (1.0E0 + exp(-({total}))), 9) AS p FROM ({feats}) ORDER BY p DESC, pred_id LIMIT 20",
        "feature_contributions": f"WITH f AS ({feats}), u AS ({union}) SELECT pred_id, rank, feature, round(added, 9) AS added FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY abs(added) DESC, feature) AS rank FROM u) WHERE rank <= 5",
    }


CHECKED = [k for k in profiles.train74(SPARK)["junun"]]


def feature_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.feature_check(profiles.features(table(spark, sf_dir, "all_predictions"), ["pred_id"], "text", "train74", "junun"), CHECKED)


def weighted_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.lexicon_flags(table(spark, sf_dir, "all_predictions"), ["pred_id"], "text", L.STRUCTURE)


QUERIES |= {"feature_check": feature_check, "lexicon_flags": weighted_lexicons}
ORACLES["feature_check"] = f"""SELECT feature, min(v) AS low, max(v) AS high, round(avg(v), 9) AS mean, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, count(*) - count(v) AS missing
    FROM (UNPIVOT ({profiles.features_sql('all_predictions', ['pred_id'], 'text', 'train74', 'junun')}) ON {', '.join(CHECKED)} INTO NAME feature VALUE v) GROUP BY feature"""
ORACLES["lexicon_flags"] = "SELECT pred_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}_{k}" for n, x in L.STRUCTURE.items() for k, e in (("any", DUCK.flag(DUCK.any("t", x))), ("terms", DUCK.distinct("t", x)), ("times", DUCK.occurrences("t", x)))) + " FROM (SELECT pred_id, coalesce(text, '') AS t FROM all_predictions) AS b"
QUERIES |= {"linear_score_topk": linear_score_topk, "feature_contributions": feature_contributions}
ORACLES |= _demo_sql()


QUERIES |= model_queries.QUERIES
ORACLES |= model_queries.ORACLES
_score = " + ".join([f"{scoring.INTERCEPT!r}E0", *(scoring.part(k, *v).replace("AS STRING) IN ('NaN', 'Infinity', '-Infinity')", "AS VARCHAR) IN ('nan', 'inf', '-inf')") for k, v in scoring.DEMO.items())])
ORACLES["stream_score"] = f"SELECT pred_id, round(p, 9) AS score, p >= 0.5 AS hit FROM (SELECT pred_id, 1.0E0 / (1.0E0 + exp(-({_score}))) AS p FROM ({profiles.features_sql('all_predictions', ['pred_id'], 'text', 'train74')}))"


def queries() -> dict[str, Run]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
