"""Analyses of predictions, candidates and labels, as SQL that Spark and DuckDB both run.

``ANALYSES`` maps a name to its tables and a function from a dialect to a query over them. ``run`` gives a DataFrame. Probabilities
that are NaN count as null. Every top-k has a tie-break, every bin and threshold is kept where it is empty, averages are
rounded to six digits. Nothing is ordered or numbered over a whole table, but by counts of distinct values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from qissaflow.functions.dialect import DUCK, SPARK, Dialect
from qissaflow.functions.lexicons import TRAIN
from qissaflow.functions.text import strip, words
from qissaflow.operators import rules
from qissaflow.operators.profiles import TOKEN
from qissaflow.sources.shared import spread

Query = Callable[[Dialect], str]
ANALYSES: dict[str, tuple[tuple[str, ...], Query]] = {}
LEVELS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9)
BINS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def analysis(*tables: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        ANALYSES[f.__name__] = (tables, f)
        return f

    return keep


def run(name: str, *tables: DataFrame) -> DataFrame:
    """The analysis over the given tables, in the order in which it names them."""
    names, query = ANALYSES[name]
    spark, text, views = tables[0].sparkSession, query(SPARK), []
    heavy = "AS t FROM" in text  # it reads whole texts
    for table, df in zip(names, tables):
        df = spread(df) if heavy else df
        views.append(f"{table}_{uuid.uuid4().hex}")
        df.createOrReplaceTempView(views[-1])
        text = text.replace(f"{{{table}}}", views[-1])
    out = spark.sql(text)
    for view in views:
        spark.catalog.dropTempView(view)
    return out


def duck_sql(name: str) -> str:
    """The same query for DuckDB over tables of their own names."""
    names, query = ANALYSES[name]
    text = query(DUCK)
    for table in names:
        text = text.replace(f"{{{table}}}", table)
    return text


def _values(xs: tuple[float, ...], name: str = "level") -> str:
    return "(VALUES " + ", ".join(f"({rules.number(x)})" for x in xs) + f") AS v({name})"


def _scored(d: Dialect) -> str:
    return f"(SELECT *, {d.without_nan('lr_prob')} AS lr, {d.without_nan('xgb_prob')} AS xgb FROM {{all_predictions}}) AS p"


def _columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in exprs.items())


def _texts(d: Dialect, make: Callable[[Dialect], dict[str, str]], table: str = "all_predictions", key: str = "pred_id") -> str:
    return f"SELECT {key}, {_columns(make(d))} FROM (SELECT *, coalesce(text, '') AS t FROM {{{table}}}) AS b"


@analysis("all_predictions")
def decisions(d):
    return f"SELECT pred_id, {_columns(rules.decisions(d))} FROM {{all_predictions}}"


def _base(table: str = "all_predictions") -> str:
    return f"SELECT *, coalesce(text, '') AS t FROM {{{table}}}"


def _filtered(d: Dialect) -> str:
    return rules.in_steps(_base(), rules.post_filter_steps(d))


@analysis("all_predictions")
def two_tier_threshold(d):
    return f"SELECT pred_id, {_columns(rules.two_tier(d))} FROM ({_filtered(d)}) AS f"


@analysis("all_predictions")
def post_filter_score(d):
    return f"SELECT pred_id, fool, has_junun, has_paradox, is_ironic, has_wisdom, has_validation, filter_score, category, filter_class FROM ({_filtered(d)}) AS f"


@analysis("all_predictions")
def post_filter_classes(d):
    return f"""SELECT filter_class, count(*) AS n, CAST(sum(CASE WHEN filter_class IN ('canonical', 'true') THEN 1 ELSE 0 END) AS BIGINT) AS reliable FROM ({_filtered(d)}) AS f
        WHERE {rules.decisions(d)['strict']} GROUP BY filter_class"""


@analysis("all_predictions")
def strict_flags(d):
    return f"SELECT pred_id, strict_fool, junun_markers, strict_paradox, akin_concepts, strict_class FROM ({rules.in_steps(_base(), rules.strict_steps(d))}) AS f"


@analysis("all_predictions")
def strict_classes(d):
    return f"""SELECT coalesce(strict_class, 'none') AS strict_class, strict_fool, count(*) AS n, CAST(sum(junun_markers) AS BIGINT) AS markers FROM ({rules.in_steps(_base(), rules.strict_steps(d))}) AS f
        WHERE {rules.decisions(d)['strict']} GROUP BY coalesce(strict_class, 'none'), strict_fool"""


@analysis("all_predictions")
def rules_r1_r7(d):
    return _texts(d, rules.seven_rules)


@analysis("all_predictions")
def genre_chain(d):
    return _texts(d, rules.genre)


@analysis("all_predictions")
def structural_flags(d):
    return _texts(d, rules.structural_flags)


@analysis("all_predictions")
def quote_flags(d):
    return _texts(d, rules.quote_flags)


@analysis("all_predictions")
def routing(d):
    return _texts(d, rules.routes)


@analysis("all_predictions")
def quadrant_counts(d):
    q = rules.decisions(d)["quadrant"]
    return f"""SELECT quadrant, count(*) AS n, round(count(*) / CAST(max(total) AS DOUBLE), 6) AS share FROM (SELECT {q} AS quadrant FROM {{all_predictions}}) AS a
        CROSS JOIN (SELECT count(*) AS total FROM {{all_predictions}}) AS b GROUP BY quadrant"""


@analysis("all_predictions")
def score_stats(d):
    parts = []
    for c in ("lr", "xgb"):
        parts.append(f"SELECT '{c}' AS model, count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 8) AS median, min({c}) AS low, max({c}) AS high, round(stddev_pop({c}), 6) AS spread, CAST(sum(CASE WHEN {c} >= 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM {_scored(d)}")
    return " UNION ALL ".join(parts)


@analysis("all_predictions")
def score_histogram(d):
    """Bins [lo, lo + 0.1): a score of exactly 1 is in none."""
    counts = ", ".join(f"CAST(sum(CASE WHEN {c} >= level AND {c} < level + 0.1E0 THEN 1 ELSE 0 END) AS BIGINT) AS {c}_n" for c in ("lr", "xgb"))
    return f"SELECT level, {counts} FROM (SELECT lr, xgb, count(*) AS k FROM {_scored(d)} GROUP BY lr, xgb, pred_id) AS s CROSS JOIN {_values(BINS)} GROUP BY level"


@analysis("all_predictions")
def threshold_sweep(d):
    """For each threshold: hits of both models, and how many of them look like false positives."""
    fp = rules.quote_flags(d)["likely_false_positive"]
    return f"""SELECT level, CAST(sum(CASE WHEN least(lr, xgb) >= level THEN 1 ELSE 0 END) AS BIGINT) AS hits,
        CAST(sum(CASE WHEN least(lr, xgb) >= level AND fp THEN 1 ELSE 0 END) AS BIGINT) AS likely_false
        FROM (SELECT lr, xgb, {fp} AS fp FROM (SELECT *, coalesce(text, '') AS t FROM {_scored(d)}) AS q WHERE lr IS NOT NULL AND xgb IS NOT NULL) AS s CROSS JOIN {_values(LEVELS)} GROUP BY level"""


@analysis("all_predictions")
def tail_counts(d):
    return f"SELECT level, CAST(sum(CASE WHEN lr >= level THEN 1 ELSE 0 END) AS BIGINT) AS n FROM {_scored(d)} CROSS JOIN {_values((0.95, 0.9, 0.8, 0.7, 0.6))} GROUP BY level"


@analysis("all_predictions")
def keep_last_join(d):
    """Predictions of the two models joined by file, of which the last row counts."""
    last = lambda c: f"(SELECT file, {c} FROM (SELECT file, {c}, row_number() OVER (PARTITION BY file ORDER BY run_ts DESC, pred_id DESC) AS k FROM {_scored(d)} WHERE file IS NOT NULL) AS w WHERE k = 1)"
    return f"SELECT a.file AS file, lr, xgb, abs(lr - xgb) AS conf_diff FROM {last('lr')} AS a JOIN {last('xgb')} AS b ON a.file = b.file"


@analysis("all_predictions")
def model_agreement(d):
    dec = rules.decisions(d)
    return f"""SELECT count(*) AS n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS agree, round(avg(CASE WHEN a = b THEN 1.0E0 ELSE 0.0E0 END), 6) AS agreement,
        round(avg(abs(lr - xgb)), 6) AS mean_diff, round(max(abs(lr - xgb)), 6) AS max_diff, round(median(abs(lr - xgb)), 8) AS median_diff, round(covar_pop(lr, xgb) / nullif(stddev_pop(CASE WHEN xgb IS NOT NULL THEN lr END) * stddev_pop(CASE WHEN lr IS NOT NULL THEN xgb END), 0), 6) AS correlation
        FROM (SELECT lr, xgb, {dec['lr_positive']} AS a, {dec['xgb_positive']} AS b FROM {_scored(d)}) AS q"""


@analysis("all_predictions")
def top_consensus(d):
    return f"SELECT pred_id, lr, xgb, (lr + xgb) / 2 AS mean, substring(text, 1, 300) AS preview FROM {_scored(d)} WHERE lr >= 0.5E0 AND xgb >= 0.5E0 ORDER BY (lr + xgb) / 2 DESC, pred_id LIMIT 50"


@analysis("all_predictions")
def one_model_only(d):
    """The 20 strongest hits that only one of the models has."""
    one = "SELECT 'lr' AS model, pred_id, lr AS prob FROM {t} WHERE lr >= 0.7E0 AND coalesce(xgb, 0) < 0.5E0 ORDER BY lr DESC, pred_id LIMIT 20"
    two = "SELECT 'xgb' AS model, pred_id, xgb AS prob FROM {t} WHERE xgb >= 0.8E0 AND coalesce(lr, 0) < 0.5E0 ORDER BY xgb DESC, pred_id LIMIT 20"
    return f"SELECT * FROM ({one.replace('{t}', _scored(d))}) AS x UNION ALL SELECT * FROM ({two.replace('{t}', _scored(d))}) AS y"


@analysis("all_predictions")
def top_and_bottom(d):
    ends = [f"SELECT '{k}' AS side, pred_id, lr FROM (SELECT pred_id, lr FROM {_scored(d)} WHERE lr IS NOT NULL ORDER BY lr {o}, pred_id LIMIT 10) AS e" for k, o in (("top", "DESC"), ("bottom", "ASC"))]
    return " UNION ALL ".join(ends)


@analysis("all_predictions")
def uncertain_batch(d):
    return f"SELECT pred_id, lr, abs(lr - 0.5E0) AS distance FROM {_scored(d)} WHERE lr IS NOT NULL ORDER BY abs(lr - 0.5E0), pred_id LIMIT 50"


@analysis("all_predictions")
def pseudo_labels(d):
    return f"SELECT pred_id, pseudo_label FROM (SELECT pred_id, {rules.decisions(d)['pseudo_label']} AS pseudo_label FROM {{all_predictions}}) AS q WHERE pseudo_label IS NOT NULL"


@analysis("all_predictions")
def cascade_balanced(d):
    """Model at 0.65 and rule filter at 0.25, the best 500."""
    return f"""SELECT pred_id, lr, filter_score FROM (SELECT *, {d.without_nan('lr_prob')} AS lr FROM ({_filtered(d)}) AS f) AS c
        WHERE lr >= 0.65E0 AND filter_score >= 0.25E0 ORDER BY lr DESC, pred_id LIMIT 500"""


@analysis("all_predictions")
def cascade_max_recall(d):
    return f"SELECT pred_id, lr FROM {_scored(d)} WHERE lr >= 0.35E0 ORDER BY lr DESC, pred_id LIMIT 1000"


@analysis("all_predictions")
def weighted_vote(d):
    """The models' probabilities weighted 0.4 and 0.6; a missing one counts with no weight."""
    up = "(CASE WHEN lr IS NULL THEN 0.0E0 ELSE 0.4E0 * lr END + CASE WHEN xgb IS NULL THEN 0.0E0 ELSE 0.6E0 * xgb END)"
    down = "(CASE WHEN lr IS NULL THEN 0.0E0 ELSE 0.4E0 END + CASE WHEN xgb IS NULL THEN 0.0E0 ELSE 0.6E0 END)"
    return f"SELECT pred_id, round({up} / nullif({down}, 0), 9) AS vote FROM {_scored(d)}"


@analysis("all_predictions")
def length_filter(d):
    from qissaflow.functions.text import letters_lo

    return f"SELECT pred_id, n_ar FROM (SELECT pred_id, {letters_lo(d, 't')} AS n_ar, length(t) AS n FROM (SELECT *, coalesce(text, '') AS t FROM {{all_predictions}}) AS b) AS c WHERE n_ar BETWEEN 80 AND 3000 AND n > 50"


@analysis("all_predictions")
def length_stats(d):
    return "SELECT count(text) AS n, min(length(text)) AS low, max(length(text)) AS high, round(avg(length(text)), 6) AS mean FROM {all_predictions} WHERE text <> ''"


@analysis("all_predictions")
def pattern_rates(d):
    flags = {"junun": d.any("t", TRAIN["JUNUN_TERMS"]), "paradox": rules.post_filter_steps(d)[0]["has_paradox"], "dialogue": rules.quote_flags(d)["two_quotes"], "generic": rules.quote_flags(d)["likely_false_positive"]}
    sums = ", ".join(f"CAST(sum(CASE WHEN {k} THEN 1 ELSE 0 END) AS BIGINT) AS {k}_n, round(avg(CASE WHEN {k} THEN 1.0E0 ELSE 0.0E0 END), 6) AS {k}_rate" for k in flags)
    return f"SELECT count(*) AS n, {sums} FROM (SELECT {_columns(flags)} FROM (SELECT *, coalesce(text, '') AS t FROM {{all_predictions}}) AS b WHERE {rules.decisions(d)['strict']}) AS c"


@analysis("all_predictions")
def residual_markers(d):
    from qissaflow.functions.text import clean_metadata, residual_markers as marks

    flags = marks(d, "c")
    sums = ", ".join(f"CAST(sum(CASE WHEN {v} THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k, v in flags.items())
    return f"SELECT count(*) AS n, {sums} FROM (SELECT {clean_metadata(d, 't')} AS c FROM (SELECT text AS t FROM {{all_predictions}} WHERE text IS NOT NULL) AS b) AS q"


@analysis("scan_candidates")
def author_top10(d):
    return "SELECT author, count(*) AS n FROM {scan_candidates} WHERE author IS NOT NULL GROUP BY author ORDER BY count(*) DESC, author LIMIT 10"


@analysis("scan_candidates")
def candidates_latest(d):
    """Each candidate once, as it came last; those at or over the threshold, with their rank within the file."""
    return f"""SELECT file, idx, lr_score, row_number() OVER (PARTITION BY file ORDER BY lr_score DESC, idx) AS k FROM (
        SELECT file, idx, {d.without_nan('lr_score')} AS lr_score, row_number() OVER (PARTITION BY file, idx ORDER BY loaded_at DESC, run_ts DESC) AS r FROM {{scan_candidates}}) AS q WHERE r = 1 AND lr_score >= 0.4E0"""


@analysis("scan_candidates")
def detection_rate(d):
    s = d.without_nan("lr_score")
    return f"SELECT count(*) AS n, CAST(sum(CASE WHEN {s} >= 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN {s} >= 0.5E0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS rate, count(DISTINCT file) AS files, count(DISTINCT author) AS authors FROM {{scan_candidates}}"


@analysis("all_predictions", "scan_candidates")
def resume_anti_join(d):
    """Files that were not yet scanned, with their rows."""
    return "SELECT file, count(*) AS n FROM {all_predictions} AS p WHERE file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {scan_candidates} AS s WHERE s.file = p.file) GROUP BY file"


@analysis("strict_analysis_300", "genre_sheet")
def author_sheet(d):
    """Examples of each author beside the author's genre sheet."""
    return """SELECT s.author AS author, count(*) AS n, CAST(sum(CASE WHEN is_true_majnun THEN 1 ELSE 0 END) AS BIGINT) AS true_n, max(g.total_extracted) AS extracted, max(g.sample_size) AS sampled
        FROM {strict_analysis_300} AS s LEFT JOIN {genre_sheet} AS g ON s.author = g.author GROUP BY s.author"""


@analysis("genre_sheet")
def genre_totals(d):
    entries = "explode(content_categories) AS (category, n)" if d.name == "spark" else "unnest(map_keys(content_categories)) AS category, unnest(map_values(content_categories)) AS n"
    return f"SELECT category, CAST(sum(n) AS BIGINT) AS n, count(*) AS authors FROM (SELECT {entries} FROM {{genre_sheet}} WHERE content_categories IS NOT NULL) AS q GROUP BY category"


@analysis("genre_sheet")
def structure_totals(d):
    entries = "explode(structural_features) AS (feature, n)" if d.name == "spark" else "unnest(map_keys(structural_features)) AS feature, unnest(map_values(structural_features)) AS n"
    return f"SELECT feature, CAST(sum(n) AS BIGINT) AS n, count(*) AS authors FROM (SELECT {entries} FROM {{genre_sheet}} WHERE structural_features IS NOT NULL) AS q GROUP BY feature"


@analysis("strict_analysis_300")
def fool_breakdown(d):
    return "SELECT found_canonical_fool AS fool, count(*) AS n, round(count(*) / CAST(max(total) AS DOUBLE), 6) AS share FROM {strict_analysis_300} CROSS JOIN (SELECT count(*) AS total FROM {strict_analysis_300}) AS b GROUP BY found_canonical_fool"


@analysis("strict_analysis_300")
def example_viewer(d):
    return f"SELECT ex_id, author, idx, coalesce(found_canonical_fool, 'none') AS fool, substring({strip(d, 'text')}, 1, 300) AS preview FROM {{strict_analysis_300}} WHERE is_true_majnun AND text <> ''"


def _judged(d: Dialect) -> str:
    """Labels of the examples beside the decision on them."""
    return f"(SELECT CAST(is_true_majnun AS INT) AS label, {d.without_nan('lr_prob')} AS score, CASE WHEN {d.without_nan('lr_prob')} >= 0.7E0 THEN 1 ELSE 0 END AS pred, CASE WHEN {d.without_nan('xgb_prob')} >= 0.7E0 THEN 1 ELSE 0 END AS other FROM {{strict_analysis_300}} WHERE is_true_majnun IS NOT NULL) AS j"


@analysis("strict_analysis_300")
def confusion_report(d):
    c = "CAST(sum(CASE WHEN label = {} AND pred = {} THEN 1 ELSE 0 END) AS BIGINT) AS {}"
    cells = ", ".join(c.format(a, b, n) for a, b, n in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")))
    return f"""SELECT tp, fp, fn, tn, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS prec, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall,
        round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6) AS f1, round((tp + tn) / CAST(nullif(tp + fp + fn + tn, 0) AS DOUBLE), 6) AS accuracy FROM (SELECT {cells} FROM {_judged(d)}) AS q"""


@analysis("strict_analysis_300")
def auc_ranks(d):
    """The area under the ROC curve by average ranks, from counts of distinct scores."""
    return f"""SELECT round((sum(pos * (below + (pos + neg + 1) / 2.0E0)) - sum(pos) * (sum(pos) + 1) / 2.0E0) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0), 6) AS auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM (
        SELECT pos, neg, coalesce(sum(pos + neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
        SELECT round(score, 6) AS score, sum(label) AS pos, sum(1 - label) AS neg FROM {_judged(d)} WHERE score IS NOT NULL GROUP BY round(score, 6)) AS g) AS w"""


@analysis("strict_analysis_300")
def roc_curve(d):
    """Points at 101 thresholds."""
    levels = tuple(round(k / 100, 2) for k in range(101))
    return f"""SELECT level, round(CAST(sum(CASE WHEN score >= level THEN label ELSE 0 END) AS DOUBLE) / nullif(sum(label), 0), 6) AS tpr, round(CAST(sum(CASE WHEN score >= level THEN 1 - label ELSE 0 END) AS DOUBLE) / nullif(sum(1 - label), 0), 6) AS fpr
        FROM {_judged(d)} CROSS JOIN {_values(levels)} WHERE score IS NOT NULL GROUP BY level"""


@analysis("strict_analysis_300")
def kappa(d):
    """Agreement of the two models' decisions beyond chance."""
    return f"""SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM (
        SELECT n, CAST(agree AS DOUBLE) / n AS po, (CAST(a AS DOUBLE) * b + CAST(n - a AS DOUBLE) * (n - b)) / (CAST(n AS DOUBLE) * n) AS pe FROM (
        SELECT count(*) AS n, sum(pred) AS a, sum(other) AS b, sum(CASE WHEN pred = other THEN 1 ELSE 0 END) AS agree FROM {_judged(d)}) AS q) AS r"""


@analysis("heldout_items")
def label_coverage(d):
    """Labelled items by label and source of the label: how many, their words, and how often they name folly, sense and speech."""
    flags = {"junun": d.any("t", TRAIN["JUNUN_TERMS"]), "aql": d.any("t", TRAIN["AQL_TERMS"]), "qala": d.any("t", TRAIN["QALA_VARIANTS"])}
    sums = ", ".join(f"CAST(sum(CASE WHEN {v} THEN 1 ELSE 0 END) AS BIGINT) AS {k}_n, round(avg(CASE WHEN {v} THEN 1.0E0 ELSE 0.0E0 END), 6) AS {k}_share" for k, v in flags.items())
    return f"SELECT coalesce(label, 0) AS label, genre, count(*) AS n, CAST(sum({d.size(words(d, 't'))}) AS BIGINT) AS words, {sums} FROM (SELECT label, genre, text_ar AS t FROM {{heldout_items}} WHERE length(text_ar) > 0) AS q GROUP BY coalesce(label, 0), genre"


@analysis("heldout_items")
def llr_lexicon(d):
    """Log-likelihood ratio of each token between labelled and unlabelled narratives (distinct items that hold it, three at least)."""
    take = "explode" if d.name == "spark" else "unnest"
    unique = "array_distinct" if d.name == "spark" else "list_distinct"
    part = "(CASE WHEN {o} > 0 THEN {o} * ln({o} / {e}) ELSE 0.0E0 END)"
    a, b = "CAST(pos AS DOUBLE)", "CAST(neg AS DOUBLE)"
    ea, eb = "(CAST(p AS DOUBLE) * (pos + neg) / (p + n))", "(CAST(n AS DOUBLE) * (pos + neg) / (p + n))"
    llr = f"2 * ({part.format(o=a, e=ea)} + {part.format(o=b, e=eb)})"
    items = "(SELECT coalesce(label, 0) AS label, text_ar AS t FROM {heldout_items} WHERE length(text_ar) > 0)"
    return f"""SELECT token, pos, neg, round({llr}, 6) AS llr, round(ln((pos + 0.5E0) / (p + 1) / ((neg + 0.5E0) / (n + 1))), 6) AS log_ratio FROM (
        SELECT token, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM (SELECT label, {take}({unique}({d.tokens('t', TOKEN)})) AS token FROM {items} AS i) AS x GROUP BY token HAVING count(*) >= 3) AS g
        CROSS JOIN (SELECT sum(label) AS p, sum(1 - label) AS n FROM {items} AS i) AS totals"""


@analysis("heldout_items")
def label_correlation(d):
    """Correlation of simple features with the label."""
    flags = {"junun": d.any("t", TRAIN["JUNUN_TERMS"]), "aql": d.any("t", TRAIN["AQL_TERMS"]), "laugh": d.any("t", TRAIN["VALIDATION.laugh"]), "authority": d.any("t", TRAIN["AUTHORITY"])}
    made = {k: d.flag(v) for k, v in flags.items()} | {"chars": "CAST(length(t) AS DOUBLE)"}
    inner = f"(SELECT CAST(label AS DOUBLE) AS label, {_columns(made)} FROM (SELECT label, text_ar AS t FROM {{heldout_items}} WHERE label IS NOT NULL AND text_ar IS NOT NULL) AS q) AS f"
    safe = lambda k: f"round(covar_pop({k}, label) / nullif(stddev_pop({k}) * stddev_pop(label), 0), 6)"
    return f"SELECT {', '.join(f'{safe(k)} AS {k}' for k in made)}, {', '.join(f'round(avg(CASE WHEN label = 1 THEN {k} END), 6) AS {k}_pos, round(avg(CASE WHEN label = 0 THEN {k} END), 6) AS {k}_neg' for k in made)} FROM {inner}"


@analysis("all_predictions")
def importance_topk_overlap(d):
    """Of the ten files with most hits of each model: those in both lists, and in one only."""
    top = lambda c: f"SELECT file FROM {_scored(d)} WHERE {c} >= 0.7E0 AND file IS NOT NULL GROUP BY file ORDER BY count(*) DESC, file LIMIT 10"
    return f"SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'xgb' WHEN b.file IS NULL THEN 'lr' ELSE 'both' END AS side FROM ({top('lr')}) AS a FULL OUTER JOIN ({top('xgb')}) AS b ON a.file = b.file"


@analysis("all_predictions", "heldout_items")
def pool_union(d):
    """Rows of the pool and labelled items as one table, without the pool's confident rows."""
    return f"""SELECT source, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT 'pool' AS source, text AS t FROM {_scored(d)} WHERE NOT coalesce(lr > 0.95E0 OR lr < 0.05E0, FALSE)
        UNION ALL SELECT 'labelled' AS source, text_ar AS t FROM {{heldout_items}}) AS u GROUP BY source"""


@analysis("all_predictions")
def quick_report(d):
    return f"""SELECT count(*) AS n, min(lr) AS lr_low, max(lr) AS lr_high, min(xgb) AS xgb_low, max(xgb) AS xgb_high, CAST(sum(CASE WHEN lr >= 0.5E0 AND xgb >= 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS consensus_n,
        CAST(sum(CASE WHEN lr >= 0.7E0 AND coalesce(xgb, 0) < 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS lr_only, CAST(sum(CASE WHEN xgb >= 0.8E0 AND coalesce(lr, 0) < 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS xgb_only FROM {_scored(d)}"""


@analysis("all_predictions")
def file_report(d):
    """For each file: rows, statistics of both scores and hits."""
    stats = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 8) AS {c}_median, round(stddev_pop({c}), 6) AS {c}_spread" for c in ("lr", "xgb"))
    return f"SELECT file, count(*) AS n, {stats}, CAST(sum(CASE WHEN lr >= 0.5E0 AND xgb >= 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM {_scored(d)} GROUP BY file"


@analysis("strict_analysis_300")
def confident_false_positives(d):
    return f"SELECT ex_id, author, {d.without_nan('lr_prob')} AS lr FROM {{strict_analysis_300}} WHERE NOT is_true_majnun AND {d.without_nan('lr_prob')} > 0.8E0 ORDER BY {d.without_nan('lr_prob')} DESC, ex_id LIMIT 10"


@analysis("strict_analysis_300")
def explained_errors(d):
    """Of the ten rows at either end of the score: how many the model has right, and its first three errors."""
    ends = " UNION ALL ".join(f"SELECT * FROM (SELECT ex_id, label, pred, score FROM j ORDER BY score {o}, ex_id LIMIT 10) AS e{o}" for o in ("DESC", "ASC"))
    judged = _judged(d).replace("SELECT CAST(is_true_majnun", "SELECT ex_id, CAST(is_true_majnun")
    return f"""WITH j AS (SELECT * FROM {judged} WHERE score IS NOT NULL), ends AS (SELECT DISTINCT * FROM ({ends}) AS u)
        SELECT ex_id, label, pred, score, round(right_share, 6) AS right_share FROM (SELECT ends.*, avg(CASE WHEN label = pred THEN 1.0E0 ELSE 0.0E0 END) OVER () AS right_share FROM ends) AS w WHERE label <> pred ORDER BY score DESC, ex_id LIMIT 3"""


@analysis("heldout_items")
def feature_prevalence(d):
    """For simple flags: how often each label has them, and chi-square of the two-by-two table."""
    flags = {"junun": d.any("t", TRAIN["JUNUN_TERMS"]), "aql": d.any("t", TRAIN["AQL_TERMS"]), "laugh": d.any("t", TRAIN["VALIDATION.laugh"]), "authority": d.any("t", TRAIN["AUTHORITY"]), "question": d.any("t", TRAIN["QUESTIONS"])}
    base = "(SELECT label, text_ar AS t FROM {heldout_items} WHERE label IS NOT NULL AND text_ar IS NOT NULL) AS q"
    count = lambda c, y: f"CAST(sum(CASE WHEN {c} AND label = {y} THEN 1 ELSE 0 END) AS DOUBLE)"
    rows = " UNION ALL ".join(f"SELECT '{k}' AS feature, {count(c, 1)} AS a, {count(f'NOT {c}', 1)} AS b, {count(c, 0)} AS c, {count(f'NOT {c}', 0)} AS e FROM {base}" for k, c in flags.items())
    chi = "(a + b + c + e) * (a * e - b * c) * (a * e - b * c) / nullif((a + b) * (c + e) * (a + c) * (b + e), 0)"
    return f"SELECT feature, round(a / nullif(a + b, 0), 6) AS with_label, round(c / nullif(c + e, 0), 6) AS without_label, round({chi}, 6) AS chi2 FROM ({rows}) AS f"


@analysis("all_predictions")
def importance_consensus(d):
    """Mean rank of files over four rankings: rows, mean scores of either model, hits; the ten best."""
    stats = f"SELECT file, count(*) AS n, round(avg(lr), 9) AS a, round(avg(xgb), 9) AS b, sum(CASE WHEN lr >= 0.5E0 AND xgb >= 0.5E0 THEN 1 ELSE 0 END) AS hits FROM {_scored(d)} WHERE file IS NOT NULL GROUP BY file"
    ranks = ", ".join(f"row_number() OVER (ORDER BY {c} DESC NULLS LAST, file) AS r_{c}" for c in ("n", "a", "b", "hits"))
    return f"SELECT file, (r_n + r_a + r_b + r_hits) / 4.0E0 AS mean_rank FROM (SELECT file, {ranks} FROM ({stats}) AS s) AS r ORDER BY (r_n + r_a + r_b + r_hits), file LIMIT 10"


@analysis("all_predictions")
def crosswise_agreement(d):
    """Rows on which two lists of predictions are sure alike (0.7 and over, or under 0.3), by side."""
    side = "CASE WHEN lr >= 0.7E0 AND xgb >= 0.7E0 THEN 'positive' WHEN lr < 0.3E0 AND xgb < 0.3E0 THEN 'negative' ELSE 'open' END"
    return f"SELECT {side} AS side, count(*) AS n, round(avg(abs(lr - xgb)), 6) AS mean_diff FROM {_scored(d)} WHERE lr IS NOT NULL AND xgb IS NOT NULL GROUP BY {side}"


@analysis("scan_candidates")
def author_sheets(d):
    """The genre sheet of each author, made from its candidates: texts, structural flags and genres."""
    flags, classes = rules.structural_flags(d), ("biographical", "dialogue", "narrative", "wisdom", "poetry", "historical", "mixed")
    sums = ", ".join([f"CAST(sum(CASE WHEN {k} THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in flags] + [f"CAST(sum(CASE WHEN genre_class = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{c}" for c in classes])
    return f"SELECT author, count(*) AS n, {sums} FROM (SELECT author, {_columns(flags | rules.genre(d))} FROM (SELECT author, coalesce(text, '') AS t FROM {{scan_candidates}}) AS b) AS c GROUP BY author"


@analysis("all_predictions")
def text_statistics(d):
    """Lengths, richness and punctuation of each text."""
    toks = d.tokens("t", TOKEN)
    unique = "array_distinct" if d.name == "spark" else "list_distinct"
    return f"""SELECT pred_id, ln(n + 1) AS log_tokens, ln(length(t) + 1) AS log_chars, length(t) / CAST(n + 1 AS DOUBLE) AS chars_a_token, {d.size('u')} / CAST(n + 1 AS DOUBLE) AS richness,
        {d.occurrences('t', ['.', '؛', '،'])} AS points, {d.distinct('t', ['و', 'ثم', 'أو'])} AS links FROM (SELECT pred_id, t, {d.size('toks')} AS n, {unique}(toks) AS u FROM (
        SELECT pred_id, t, {toks} AS toks FROM (SELECT pred_id, coalesce(text, '') AS t FROM {{all_predictions}}) AS b) AS c) AS e"""
