"""Predicates, classes and routes of narratives and predictions, as expressions for either dialect.

Each function gives the names and expressions of the columns that it adds to a text ``t`` or to a prediction with the columns
``lr_prob``, ``xgb_prob``, ``lr_pred``, ``xgb_pred`` and ``consensus``. NaN and null probabilities fail every threshold.
"""

from __future__ import annotations

from qissaflow.functions.dialect import Dialect
from qissaflow.functions.lexicons import FILTER, GENRE, RULES, SMALL, STRICT, TRAIN
from qissaflow.functions.text import BLANK, letters_block, poetry_ratio

# Thresholds.
PRESETS = {"conservative": 0.85, "balanced": 0.70, "max_recall": 0.40}
STRICT_LEVEL, SCAN_LEVEL, V50_LEVEL = 0.7, 0.5, 0.75
UNCERTAIN = (0.35, 0.65)


def number(x: float) -> str:
    return f"{x!r}E0"


def is_true(condition: str) -> str:
    return f"coalesce({condition}, FALSE)"


def fools(d: Dialect, t: str, lists: dict) -> str:
    """The first name with a matching variant, in the order of the list; null if there is none."""
    names = [k for k in lists if k.startswith("CANONICAL_FOOLS.")]
    return "CASE " + " ".join(f"WHEN {d.any(t, lists[k])} THEN {d.text(k.split('.')[1])}" for k in names) + " END"


def _no_dot(patterns: list[str]) -> list[str]:
    return [p.replace(".*", r"[^\n]*") for p in patterns]


def post_filter_steps(d: Dialect, t: str = "t") -> list[dict[str, str]]:
    """The flags of the rule filter, its score and category; each step uses the columns of those before."""
    said = f"instr({t}, 'قال')"
    gaps = " OR ".join(f"(instr({t}, {d.text(m)}) > {said} AND instr({t}, {d.text(m)}) - {said} < 200)" for m in dict.fromkeys(FILTER["PARADOX_MARKERS"]))
    ironic = [d.matches(t, p) for p in _no_dot(FILTER["IRONY_PATTERNS"])] + [f"(contains({t}, '{a}') AND contains({t}, '{b}'))" for a, b in SMALL["OPPOSITES"]]
    flags = {
        "fool": fools(d, t, FILTER),
        "has_junun": d.any(t, FILTER["JUNUN_MARKERS"]),
        "has_paradox": f"({said} > 0 AND ({gaps}))",
        "is_ironic": "(" + " OR ".join(ironic) + ")",
        "wise": d.distinct(t, FILTER["WISDOM_WORDS"]),
        "has_validation": d.any(t, FILTER["VALIDATION_MARKERS"]),
    }
    points = " + ".join(f"CASE WHEN {c} THEN {w}E0 ELSE 0.0E0 END" for c, w in (("has_junun", 0.4), ("has_paradox", 0.3), ("is_ironic", 0.2), ("has_wisdom", 0.1), ("has_validation", 0.1)))
    return [
        flags,
        {"has_wisdom": "((has_junun AND wise >= 2) OR (has_paradox AND wise >= 1))"},
        {"filter_score": f"CASE WHEN fool IS NOT NULL THEN 1.0E0 ELSE least({points}, 1.0E0) END"},
        {
            "category": "CASE WHEN fool IS NOT NULL THEN 'canonical_fool' WHEN filter_score > 0 THEN 'true_majnun' ELSE 'false_positive' END",
            "filter_class": "CASE WHEN fool IS NOT NULL THEN 'canonical' WHEN filter_score >= 0.5E0 THEN 'true' WHEN filter_score > 0 THEN 'weak' ELSE 'rejected' END",
        },
    ]


def in_steps(query: str, steps: list[dict[str, str]]) -> str:
    """``query`` with the columns of each step added."""
    for k, step in enumerate(steps):
        query = f"SELECT *, {', '.join(f'{v} AS {c}' for c, v in step.items())} FROM ({query}) AS step{k}"
    return query


def strict_steps(d: Dialect, t: str = "t") -> list[dict[str, str]]:
    """Canonical fool, markers of folly, paradox in a dialogue, dialogue only, or no class (null)."""
    flags = {
        "strict_fool": fools(d, t, STRICT),
        "junun_markers": f"CAST({d.occurrences(t, STRICT['JUNUN_WORDS'])} AS INT)",
        "strict_paradox": "(" + " OR ".join(d.matches(t, p) for p in _no_dot(STRICT["PARADOX_PATTERNS"])) + ")",
        "akin_concepts": d.distinct(t, STRICT["AKIN_CONCEPTS"]),
        "said": d.any(t, ["قال"]),
    }
    chain = "WHEN strict_fool IS NOT NULL THEN 'canonical' WHEN junun_markers > 0 THEN 'true_majnun' WHEN strict_paradox AND said THEN 'true_majnun' WHEN said THEN 'dialogue_only'"
    return [flags, {"strict_class": f"CASE {chain} END"}]


def seven_rules(d: Dialect, t: str = "t") -> dict[str, str]:
    """R1 to R7, their sum, and whether four hold."""
    names = {"r1_junun": "JUNUN_TERMS", "r2_aql": "AQL_TERMS", "r3_dialogue": "DIALOGUE_MARKERS", "r4_validation": "VALIDATION_MARKERS", "r5_fool": "FAMOUS_FOOLS"}
    out = {k: d.any(t, RULES[v]) for k, v in names.items()}
    lines, words = d.split(t, "\n"), d.tokens(t, "[^" + BLANK[1:] + "+")
    out["r6_not_verse"] = f"({d.count_where(lines, d.matches('w', f'^{BLANK}*%'))} / CAST(greatest({d.size(lines)}, 1) AS DOUBLE) < 0.7E0)"
    out["r7_length"] = f"({d.size(words)} > 50 AND {d.size(words)} < 600)"
    total = " + ".join(f"CAST({c} AS INT)" for c in out.values())
    return out | {"rule_score": f"({total})", "rule_positive": f"({total} >= 4)"}


def genre(d: Dialect, t: str = "t") -> dict[str, str]:
    """The genre, first match wins ('anecdotal' can't be reached: what it needs is 'narrative' before)."""
    has = lambda k: d.any(t, GENRE[k])
    said, twice = d.any(t, ["قال", "قالت"]), f"{d.occurrences(t, ['قال'])} >= 2"
    chain = [("biographical", has("biographical")), ("dialogue", f"{said} AND {twice}"), ("narrative", has("narrative")), ("wisdom", has("wisdom")), ("poetry", has("poetry")), ("historical", has("historical")), ("anecdotal", f"{d.any(t, ['قال'])} AND {d.any(t, ['ضحك', 'لطيف'])}")]
    return {"genre_class": "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in chain) + " ELSE 'mixed' END"}


def structural_flags(d: Dialect, t: str = "t") -> dict[str, str]:
    n = letters_block(d, t)
    quotes = d.any(t, ["قال", "قالت"])
    parts = d.count_where(d.split(t, "|"), d.matches("w", "[^" + BLANK[1:]))
    words = d.tokens(t, "[^" + BLANK[1:] + "+")
    return {
        "has_names": f"({d.count_where(words, d.matches('w', '^.*بن|^' + chr(92) + 'p{Lu}'))} > 0)",
        "has_dates": d.any(t, GENRE["dates"]),
        "has_quotes": quotes,
        "has_commands": d.any(t, GENRE["commands"]),
        "has_questions": d.any(t, ["؟"]),
        "is_coherent": f"({parts} >= 1 AND {n} >= 100)",
        "is_complete": f"({n} >= 150 AND ({quotes} OR {parts} >= 2))",
        "is_fragmented": f"({n} < 80 OR ({quotes} AND {n} < 100))",
    }


def quote_flags(d: Dialect, t: str = "t") -> dict[str, str]:
    """Speech, speech twice, a question, an order, and what the false-positive analysis counts."""
    junun = d.any(t, TRAIN["JUNUN_TERMS"])
    marker = d.any(t, ["ولكن", "إلا", "لكن", "غير"])
    said = d.any(t, ["قال"])
    return {
        "quote": said,
        "two_quotes": f"({d.occurrences(t, ['قال'])} >= 2)",
        "question": d.any(t, ["؟", "?"]),
        "command": d.any(t, GENRE["commands"]),
        "likely_false_positive": f"(NOT {junun} AND NOT {marker} AND {said})",
    }


def routes(d: Dialect, t: str = "t") -> dict[str, str]:
    """Which specialist or expert a text goes to."""
    words = f"{d.size(d.tokens(t, '[^' + BLANK[1:] + '+'))}"
    verse = poetry_ratio(d, t)
    return {
        "specialist": f"CASE WHEN {verse} > 0.2E0 THEN 'poetry' WHEN {words} < 150 THEN 'short' ELSE 'long' END",
        "expert": f"CASE WHEN {verse} > 0.2E0 THEN 1 WHEN {words} < 150 THEN 1 WHEN {d.any(t, RULES['JUNUN_TERMS'])} THEN 2 ELSE 3 END",
    }


def decisions(d: Dialect) -> dict[str, str]:
    """Everything decided by the two probabilities of a prediction."""
    lr, xgb = d.without_nan("lr_prob"), d.without_nan("xgb_prob")
    over = lambda x, level: is_true(f"{x} >= {number(level)}")
    out = {f"lr_{k}": over(lr, v) for k, v in PRESETS.items()}
    a, b = over(lr, SCAN_LEVEL), over(xgb, SCAN_LEVEL)
    return out | {
        "lr_positive": f"CAST({a} AS INT)",
        "xgb_positive": f"CAST({b} AS INT)",
        "both_positive": f"CAST({a} AND {b} AS INT)",
        "v50_positive": f"CAST({over(lr, V50_LEVEL)} AS INT)",
        "disagree": f"({a} <> {b})",
        "strict": f"({a} AND {b} AND {over(lr, STRICT_LEVEL)} AND {over(xgb, STRICT_LEVEL)})",
        "quadrant": f"CASE WHEN {a} AND {b} THEN 'both' WHEN {a} THEN 'lr_only' WHEN {b} THEN 'xgb_only' ELSE 'neither' END",
        "slice": f"CASE WHEN {over(lr, 0.9)} THEN 'lr_90' WHEN {over(lr, 0.7)} THEN 'lr_70_90' ELSE 'lower' END",
        "xgb_slice": f"CASE WHEN {over(xgb, 0.95)} THEN 'xgb_95' WHEN {over(xgb, 0.8)} THEN 'xgb_80' ELSE 'lower' END",
        "stage_one": over(lr, 0.30),
        "stage_two": f"({over(lr, 0.30)} AND {over(xgb, 0.75)})",
        "uncertain": is_true(f"{lr} > {number(UNCERTAIN[0])} AND {lr} < {number(UNCERTAIN[1])}"),
        "pseudo_label": f"CASE WHEN {is_true(f'{lr} > 0.95E0')} THEN 1 WHEN {is_true(f'{lr} < 0.05E0')} THEN 0 END",
        "mean_prob": f"(({lr}) + ({xgb})) / 2",
    }


def two_tier(d: Dialect) -> dict[str, str]:
    """A lower threshold where the text has markers of folly or a paradox; after the steps of the rule filter."""
    level = "CASE WHEN has_junun THEN 0.65E0 WHEN has_paradox THEN 0.7E0 ELSE 0.85E0 END"
    return {"level": level, "kept": is_true(f"{d.without_nan('lr_prob')} >= {level}")}
