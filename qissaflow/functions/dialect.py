"""Text primitives as SQL expressions, for Spark and, so that results can be checked, for DuckDB; those of ``train74`` as Python, too.

An expression is a string; ``t`` names the column that holds the text (never null where the profiles use it). All positions
and lengths count code points. ``SPARK`` uses built-in functions only, so that everything stays inside the JVM.
"""

from __future__ import annotations

import re
import unicodedata


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def escaped(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}" else c for c in text)


def pattern(terms: list[str]) -> str:
    """A pattern that is found in a text if any of the terms is. Terms that hold another one are left out, and the others are put
    into a tree of their letters, so that a place in a text is given up at its first wrong letter."""
    own = [x for x in dict.fromkeys(terms) if not any(y != x and y in x for y in terms)]

    def branch(rest: list[str]) -> str:
        if "" in rest:
            return ""
        heads: dict[str, list[str]] = {}
        for x in rest:
            heads.setdefault(x[0], []).append(x[1:])
        parts = [escaped(c) + branch(tails) for c, tails in heads.items()]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return branch(own)


def without_marks() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, and these base letters, for ``translate``."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x622, 0x627), 0x6C0, 0x6C2, 0x6D3, *range(0x1E00, 0x1F00)):
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and all(unicodedata.category(c) == "Mn" for c in whole[1:]):
            pairs.append((chr(code), whole[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


class Dialect:
    """What both engines write alike."""

    def both(self, *conditions: str) -> str:
        return "(" + " AND ".join(conditions) + ")"

    def flag(self, condition: str) -> str:
        return f"CASE WHEN {condition} THEN 1.0E0 ELSE 0.0E0 END"

    def case(self, condition: str, yes: str, no: str) -> str:
        return f"CASE WHEN {condition} THEN {yes} ELSE {no} END"

    def double(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def quotient(self, a: str, b: str) -> str:
        """Null where ``a`` is."""
        return f"{a} / {b}"

    def head(self, t: str, n: int) -> str:
        return f"substring({t}, 1, {n})"

    def without_nan(self, x: str) -> str:
        return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"

    def any(self, t: str, terms: list[str]) -> str:
        raise NotImplementedError

    def none(self, t: str, terms: list[str]) -> str:
        return f"NOT {self.any(t, terms)}"

    def bare(self, t: str) -> str:
        """Letters without their marks."""
        old, new = without_marks()
        return self.replace_all(f"translate({t}, '{old}', '{new}')", r"\p{Mn}", "")


class Spark(Dialect):
    name = "spark"

    def text(self, s: str) -> str:
        return "r" + quoted(s) if "'" not in s else quoted(s.replace("\\", "\\\\"))

    def array(self, terms: list[str]) -> str:
        return "array(" + ", ".join(map(self.text, terms)) + ")"

    def any(self, t: str, terms: list[str]) -> str:
        return f"({t} RLIKE {self.text(pattern(terms))})"

    def matches(self, t: str, regex: str) -> str:
        return f"({t} RLIKE {self.text(regex)})"

    def distinct(self, t: str, terms: list[str]) -> str:
        return "(" + " + ".join(f"CAST(contains({t}, {self.text(x)}) AS INT)" for x in terms) + ")"

    def occurrences(self, t: str, terms: list[str]) -> str:
        return "(" + " + ".join(f"(length({t}) - length(replace({t}, {self.text(x)}, ''))) div {len(x)}" for x in terms) + ")"

    def regex_count(self, t: str, regex: str) -> str:
        return f"regexp_count({t}, {self.text(regex)})"

    def tokens(self, t: str, regex: str) -> str:
        return f"regexp_extract_all({t}, {self.text(regex)}, 0)"

    def members(self, tokens: str, terms: list[str]) -> str:
        return f"size(filter({tokens}, w -> w IN ({', '.join(map(self.text, terms))})))"

    def size(self, a: str) -> str:
        return f"size({a})"

    def near(self, t: str, one: list[str], other: list[str], window: int) -> str:
        """Some term of ``one`` has at its first place a term of ``other`` within ``window`` characters."""
        start = f"greatest(1, instr({t}, a) - {window})"
        return f"exists({self.array(one)}, a -> instr({t}, a) > 0 AND substring({t}, {start}, instr({t}, a) + length(a) + {window} - {start}) RLIKE {self.text(pattern(other))})"

    def first(self, t: str, terms: list[str]) -> str:
        """The first place of any term, counted from 0; null if there is none."""
        return "least(" + ", ".join(f"nullif(instr({t}, {self.text(x)}), 0)" for x in terms) + ") - 1" if len(terms) > 1 else f"nullif(instr({t}, {self.text(terms[0])}), 0) - 1"

    def tail(self, t: str, start: str) -> str:
        return f"substring({t}, ({start}) + 1)"

    def third(self, t: str) -> str:
        return f"substring({t}, 2 * (length({t}) div 3) + 1)"

    def last(self, t: str, n: int) -> str:
        return f"substring({t}, greatest(1, length({t}) - {n} + 1))"

    def replace_all(self, t: str, regex: str, new: str) -> str:
        return f"regexp_replace({t}, {self.text(regex)}, {self.text(new)})"

    def split(self, t: str, sep: str) -> str:
        return f"split({t}, {self.text(pattern([sep]))})"

    def count_where(self, array: str, condition: str) -> str:
        return f"size(filter({array}, w -> {condition}))"


class Duck(Dialect):
    name = "duckdb"

    def without_nan(self, x: str) -> str:
        """By its text: Parquet's statistics leave NaN out, and isnan() is decided by them where it can be."""
        return f"CASE WHEN CAST({x} AS VARCHAR) = 'nan' THEN NULL ELSE {x} END"

    def text(self, s: str) -> str:
        return quoted(s)

    def array(self, terms: list[str]) -> str:
        return "[" + ", ".join(map(quoted, terms)) + "]"

    def any(self, t: str, terms: list[str]) -> str:
        return f"(len(list_filter({self.array(terms)}, lambda x: contains({t}, x))) > 0)"

    def matches(self, t: str, regex: str) -> str:
        return f"regexp_matches({t}, {quoted(regex)})"

    def distinct(self, t: str, terms: list[str]) -> str:
        return f"len(list_filter({self.array(terms)}, lambda x: contains({t}, x)))"

    def occurrences(self, t: str, terms: list[str]) -> str:
        return f"coalesce(CAST(list_sum(list_transform({self.array(terms)}, lambda x: (length({t}) - length(replace({t}, x, ''))) // length(x))) AS BIGINT), 0)"

    def regex_count(self, t: str, regex: str) -> str:
        return f"len(regexp_extract_all({t}, {quoted(regex)}))"

    def tokens(self, t: str, regex: str) -> str:
        return f"regexp_extract_all({t}, {quoted(regex)})"

    def members(self, tokens: str, terms: list[str]) -> str:
        return f"len(list_filter({tokens}, lambda w: list_contains({self.array(terms)}, w)))"

    def size(self, a: str) -> str:
        return f"len({a})"

    def near(self, t: str, one: list[str], other: list[str], window: int) -> str:
        start = f"greatest(1, instr({t}, a) - {window})"
        hits = f"len(list_filter({self.array(other)}, lambda b: contains(substring({t}, {start}, instr({t}, a) + length(a) + {window} - {start}), b))) > 0"
        return f"(len(list_filter({self.array(one)}, lambda a: instr({t}, a) > 0 AND {hits})) > 0)"

    def first(self, t: str, terms: list[str]) -> str:
        return f"(list_min(list_filter(list_transform({self.array(terms)}, lambda x: instr({t}, x)), lambda i: i > 0)) - 1)"

    def tail(self, t: str, start: str) -> str:
        return f"substring({t}, CAST(({start}) + 1 AS BIGINT))"

    def third(self, t: str) -> str:
        return f"substring({t}, 2 * (length({t}) // 3) + 1)"

    def last(self, t: str, n: int) -> str:
        return f"right({t}, {n})"

    def replace_all(self, t: str, regex: str, new: str) -> str:
        return f"regexp_replace({t}, {quoted(regex)}, {quoted(new.replace('$', chr(92)))}, 'g')"

    def split(self, t: str, sep: str) -> str:
        return f"string_split({t}, {quoted(sep)})"

    def count_where(self, array: str, condition: str) -> str:
        return f"len(list_filter({array}, lambda w: {condition}))"


class Plain(Dialect):
    """Lines of Python for one text. A primitive is a line of its own, written once however often it is asked for, and stands in
    expressions by its name. Which terms the whole text has (``own``) is found out once for all of them: a search costs Python
    a fraction of what it costs in SQL, where each of a few hundred terms is looked for in every feature that names it."""

    name = "python"

    def __init__(self) -> None:
        self.terms: dict[str, None] = {}
        self.values: list[object] = []
        self.lines: dict[str, str] = {}

    def _line(self, expression: str) -> str:
        return self.lines.setdefault(expression, f"v{len(self.lines)}")

    def _value(self, value: object) -> str:
        if value not in self.values:
            self.values.append(value)
        return f"c{self.values.index(value)}"

    def _own(self, terms: list[str]) -> str:
        """Those of the terms that the whole text has."""
        self.terms |= dict.fromkeys(terms)
        return self._line(f"own & {self._value(frozenset(terms))}")

    def function(self, names: list[str], expressions: list[str]):
        """A function of a text that gives the values of ``expressions``; ``names`` are further lines, in order."""
        body = ["own = {x for x in terms if x in t}", *names, *(f"{name} = {line}" for line, name in self.lines.items()), f"return ({', '.join(f'float({x})' for x in expressions)},)"]
        space = {f"c{k}": v for k, v in enumerate(self.values)} | {"terms": tuple(self.terms), "least": min, "greatest": max, "length": len, "re": re, **HELPERS}
        exec("def values_of(t):\n    " + "\n    ".join(body), space)  # noqa: S102 - the lines are made here, from the fixed lists
        return space["values_of"]

    def both(self, *conditions: str) -> str:
        return "(" + " and ".join(conditions) + ")"

    def flag(self, condition: str) -> str:
        return self._line(f"1.0 if {condition} else 0.0")

    def case(self, condition: str, yes: str, no: str) -> str:
        return f"({yes} if {condition} else {no})"

    def double(self, x: str) -> str:
        return x

    def quotient(self, a: str, b: str) -> str:
        return f"quotient({a}, {b})"

    def head(self, t: str, n: int) -> str:
        return f"{t}[:{n}]"

    def third(self, t: str) -> str:
        return f"{t}[2 * (len({t}) // 3):]"

    def any(self, t: str, terms: list[str]) -> str:
        own = self._own(terms)
        return self._line(f"bool({own})" if t == "t" else f"within({t}, {own})")

    def none(self, t: str, terms: list[str]) -> str:
        return f"(not {self.any(t, terms)})"

    def distinct(self, t: str, terms: list[str]) -> str:
        own = self._own(terms)
        again = [x for k, x in enumerate(terms) if x in terms[:k]]
        return f"(len({own}) + {' + '.join(f'({x!r} in own)' for x in again)})" if again else f"len({own})"

    def occurrences(self, t: str, terms: list[str]) -> str:
        own = self._own(terms)
        return self._line(f"sum([t.count(x) for x in {self._value(tuple(terms))} if x in own]) if {own} else 0")

    def tokens(self, t: str, regex: str) -> str:
        return f"re.findall({regex!r}, {t})"

    def members(self, tokens: str, terms: list[str]) -> str:
        return self._line(f"sum(map({self._value(frozenset(terms))}.__contains__, {tokens}))")

    def size(self, a: str) -> str:
        return f"len({a})"

    def near(self, t: str, one: list[str], other: list[str], window: int) -> str:
        return self._line(f"near({t}, {self._own(one)}, {self._own(other)}, {window})")

    def first(self, t: str, terms: list[str]) -> str:
        return self._line(f"min(map(t.find, {self._own(terms)}), default=None)")


def _within(t: str, terms: set[str]) -> bool:
    return any(x in t for x in terms)


def _near(t: str, one: set[str], other: set[str], window: int) -> bool:
    for a in one if other else ():
        k = t.find(a)
        if _within(t[max(0, k - window) : k + len(a) + window], other):
            return True
    return False


HELPERS = {"within": _within, "near": _near, "quotient": lambda a, b: None if a is None else a / b, "coalesce": lambda a, b: b if a is None else a}
SPARK, DUCK = Spark(), Duck()
