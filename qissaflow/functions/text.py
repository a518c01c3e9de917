"""Cleaning, normalising, tokenising and counting: expressions over a text column, for either dialect.

``BLANK`` are the blanks of Unicode, ``EDGE`` what is no part of a word. A null text gives null.
"""

from __future__ import annotations

from qissaflow.functions.dialect import Dialect
from qissaflow.functions.lexicons import SMALL, STRUCTURE

BLANK = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
EDGE = r"[^\p{L}\p{N}_]"
ISNAD_TOKEN = "[؀-ۿ]+"
#: Marks that the library's normaliser takes away.
LIB_MARKS = "[ؐ-ًؚ-ٰٟۖ-ۜ۟-ۤۧ-۪ۨ-ۭ]"
VERSE = "%~%|~~|#[$]#|[∥‖]"


def strip(d: Dialect, t: str) -> str:
    return d.replace_all(t, rf"^{BLANK}+|{BLANK}+\z", "")


def collapse(d: Dialect, t: str) -> str:
    return strip(d, d.replace_all(t, rf"{BLANK}+", " "))


def whole_word_removed(d: Dialect, t: str, word: str) -> str:
    """Without the matches of ``word`` that stand between edges of words."""
    if d.name == "spark":
        return d.replace_all(t, rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])", "")
    for _ in range(2):  # neighbours share an edge
        t = d.replace_all(t, rf"(^|{EDGE}){word}($|{EDGE})", "$1$2")
    return t


def clean_metadata(d: Dialect, t: str) -> str:
    """Editorial markup of a book taken away, in this order: manuscript and page marks, quotations between carets, brackets,
    verse halves between percent signs with what they hold, single signs, bars; then blanks once."""
    t = whole_word_removed(d, t, r"ms\p{Nd}{4,5}")
    t = d.replace_all(t, r"PageV\p{Nd}{2}P\p{Nd}{3,4}", "")
    t = d.replace_all(t, rf"\^{BLANK}*\([^)]*\){BLANK}*\^", "")
    t = d.replace_all(t, rf"{BLANK}\^{BLANK}", " ")
    t = d.replace_all(d.replace_all(t, r"^\^", ""), r"\^(\n?)\z", "$1")
    t = d.replace_all(t, rf"\[{BLANK}*[^\]]*\]", "")
    t = d.replace_all(t, "%[^%]*%", "")
    t = d.replace_all(t, rf"{BLANK}%{BLANK}", " ")
    t = d.replace_all(d.replace_all(t, rf"^{BLANK}*%{BLANK}*", ""), rf"{BLANK}*%{BLANK}*\z", "")
    t = d.replace_all(t, "%", "")
    return collapse(d, d.replace_all(t, rf"{BLANK}*\|{BLANK}*", " "))


def clean_v50(d: Dialect, t: str) -> str:
    t = whole_word_removed(d, d.replace_all(t, r"PageV\p{Nd}+P\p{Nd}+", ""), r"ms\p{Nd}+")
    return strip(d, d.replace_all(t, r"[ \t]+", " "))


def clean_signs(d: Dialect, t: str) -> str:
    """Every sign outside words and the Arabic block becomes a blank."""
    return collapse(d, d.replace_all(t, r"[^\p{L}\p{N}_\t-\r\x{1c}-\x{20}\x{85}\p{Z}\x{600}-\x{6ff}]", " "))


def normalize_lib(d: Dialect, t: str) -> str:
    """Decomposed, without the listed marks, blanks once. The marks of a decomposed hamza or madda are listed, too."""
    letters, base = "أإآؤئۀۂۓ", "ااا" + "ويەہے"
    return collapse(d, d.replace_all(f"translate({t}, '{letters}', '{base}')", LIB_MARKS, ""))


def normalize_isnad(d: Dialect, t: str) -> str:
    marks = d.replace_all(t, "[ً-ٰٟ]", "")
    return f"translate({marks}, 'أإآةى', 'اااهي')"


def words(d: Dialect, t: str) -> str:
    """Words between blanks of the normalised text."""
    return d.tokens(normalize_lib(d, t), r"[^ ]+")


def letters_lo(d: Dialect, t: str) -> str:
    """Characters of the Arabic block that are letters without case."""
    inside = "[ؠ-ؿف-يٮٯٱ-ۓەۮۯۺ-ۼۿ]"
    return d.regex_count(t, inside)


def letters_block(d: Dialect, t: str) -> str:
    return d.regex_count(t, "[؀-ۿ]")


def poetry_ratio(d: Dialect, t: str) -> str:
    lines = d.split(t, "\n")
    return f"({d.count_where(lines, d.matches('w', VERSE))} / CAST(greatest({d.size(lines)}, 1) AS DOUBLE))"


def every_place(d: Dialect, t: str, one: list[str], other: list[str], window: int) -> str:
    """Occurrences of terms of ``one`` (of each by itself, without overlap) with a term of ``other`` within ``window`` characters,
    counted by cutting the text at each term: the end of the piece before it and the beginning of what follows."""
    parts = []
    for a in one:
        pieces = d.split(t, a)
        k = len(a)
        if d.name == "spark":
            # pieces before the k-th occurrence give its place
            place = f"aggregate(slice({pieces}, 1, i), 0, (x, p) -> x + length(p)) + (i - 1) * {k}"
            near = d.any(f"substring({t}, greatest(1, {place} - {window} + 1), {place} + {k + window} - greatest(0, {place} - {window}))", other)
            parts.append(f"CASE WHEN contains({t}, {d.text(a)}) THEN size(filter(sequence(1, size({pieces}) - 1), i -> {near})) ELSE 0 END")
        else:
            place = f"coalesce(CAST(list_sum(list_transform(({pieces})[1:i], lambda p: length(p))) AS BIGINT), 0) + (i - 1) * {k}"
            near = f"len(list_filter({d.array(other)}, lambda b: contains(substring({t}, greatest(1, {place} - {window} + 1), {place} + {k + window} - greatest(0, {place} - {window})), b))) > 0"
            parts.append(f"len(list_filter(range(1, len({pieces})), lambda i: {near}))")
    return "(" + " + ".join(parts) + ")"


def first_place_count(d: Dialect, t: str, one: list[str], other: list[str], window: int) -> str:
    """How many terms of ``one`` have at their first place a term of ``other`` within ``window`` characters."""
    return "(" + " + ".join(f"CAST({d.near(t, [a], other, window)} AS INT)" for a in one) + ")"


def within(d: Dialect, t: str, one: list[str], other: list[str], window: int) -> str:
    """Whether any place of ``one`` and any of ``other`` are at most ``window`` characters apart, in either order."""
    a, b = "(?:" + "|".join(one) + ")", "(?:" + "|".join(other) + ")"
    gap = rf"(?:[^\n]|\n){{0,{window}}}"
    return f"({d.matches(t, a + gap + b)} OR {d.matches(t, b + gap + a)})"


def residual_markers(d: Dialect, t: str) -> dict[str, str]:
    return {"has_ms": d.matches(t, r"ms\p{Nd}"), "has_page": d.any(t, ["PageV"]), "has_caret": d.any(t, ["^"]), "has_percent": d.any(t, ["%"]), "has_bracket": d.any(t, ["[", "]"])}


def structure(d: Dialect, t: str) -> dict[str, str]:
    """Order of the elements of a narrative, from the first place of each (null where it lacks one)."""
    at = {k: d.first(t, v) for k, v in STRUCTURE.items()}
    j, q, v, a = at["junun"], at["dialogue"], at["validation"], at["authority"]
    flag = lambda c: d.flag(f"coalesce({c}, FALSE)")
    return {
        "order_canonical": flag(f"{j} < {q} AND {q} < {v}"),
        "junun_before_dialogue": flag(f"{j} < {q}"),
        "validation_final": d.flag(d.any(d.third(t), STRUCTURE["validation"])),
        "authority_junun_prox": flag(f"abs(({a}) - ({j})) < 100"),
        "revelation_pattern": flag(f"{q} < {j}"),
        "distance_jd": f"coalesce(abs(({j}) - ({q})) / CAST(greatest(length({t}), 1) AS DOUBLE), 1.0E0)",
        "inversion_pattern": flag(f"{v} < {j}"),
    }


def enriched_flag(d: Dialect, t: str, terms: list[str], excluded: list[str]) -> str:
    """Where an excluded form occurs, the enriched ones must occur more often; else one of them will do."""
    return d.flag(f"CASE WHEN {d.any(t, excluded)} THEN {d.occurrences(t, terms)} > {d.occurrences(t, excluded)} ELSE {d.any(t, terms)} END")


def filtered_junun(d: Dialect, t: str, terms: list[str]) -> str:
    return d.both(d.any(t, terms), d.none(t, SMALL["VETO"]))
