"""One consistent form for texts that look alike (problem 4).

``skeleton`` follows the confusables procedure: decompose, replace every character by the prototype of its
look-alikes, decompose again. The result is composed at the end, so that it can be stored and compared as text.
Blanks of every kind count as one blank, what is never drawn disappears, and whatever a reader can see (a vowel
sign, hamza, dots, stretching, another punctuation mark) stays.

Groups of equal forms are found by two 64-bit hashes of the form, 128 bits in all, so that among 10^10 texts the chance of any false pair is
below 10^-18; the texts themselves never go to a shuffle.

Defined results: null gives null, an empty or blank text gives ``""``; the form of a form is itself; texts of any
length are processed whole. Ligatures of Arabic letters other than lam-alef stay, as they look unlike the letters in a row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qissaflow.llm.scratch import spread, written

# Characters that are drawn alike, by the one that stands for them. The Farsi yeh counts as yeh everywhere, though its
# final form has no dots; alef wasla stays apart from alef, as its mark can be seen.
LOOKALIKES = {
    "ي": "ی", "ك": "ک", "ه": "ہھە", "٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹", "،": "٬", "%": "٪",
    "a": "аɑα", "b": "Ьь", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еҽ", "f": "ϝ", "g": "ɡց", "h": "һհ", "i": "іıιⅰ", "j": "јϳ", "k": "κ", "l": "ⅼӏ", "m": "ⅿ", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛզ", "r": "г", "s": "ѕ", "u": "սυ", "v": "νѵⅴ", "w": "ԝѡ", "x": "хχⅹ", "y": "уγү", "z": "ᴢ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚⅭ", "D": "ᎠꓓⅮ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀⅠ", "J": "ЈᎫꓙ", "K": "КΚᏦꓗ", "L": "ᏞꓡⅬ", "M": "МΜᎷꓟⅯ",
    "N": "ΝꓠՆ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦⅤ", "W": "ԜᎳꓪ", "X": "ХΧꓫⅩ", "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ",
    "-": "‐‑", "|": "ǀ∣", ":": "∶", "/": "∕⁄",
}
# Format characters that are drawn, and so stay.
DRAWN_FORMAT = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2}
# Characters without any ink that Unicode doesn't call format characters or blanks.
INKLESS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2800, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
# The blocks that hold characters to replace; the rest are ideographs, syllables, private use and unassigned.
BLOCKS = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
SAME_GLYPHS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}


@lru_cache(1)
def prototypes() -> dict[int, str]:
    """Code point to prototype, built from the character database and ``LOOKALIKES``.

    Positional and full-width forms go to the plain letters; Arabic ligatures other than lam-alef, which
    look unlike the letters in a row, and spacing marks stay.
    """
    table: dict[int, str] = {}
    for code in (c for first, after in BLOCKS for c in range(first, after)):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf" and code not in DRAWN_FORMAT:
            table[code] = ""
        elif kind[0] == "Z":
            table[code] = " "
        else:
            tag, *parts = unicodedata.decomposition(char).split() or [""]
            whole = "".join(chr(int(x, 16)) for x in parts) if tag in SAME_GLYPHS else ""
            if whole and " " not in whole and (len(whole) == 1 or 0xFEF5 <= code <= 0xFEFC):
                table[code] = whole
    for code in (*range(0x00, 0x20), *range(0x7F, 0xA0)):
        table[code] = " " if chr(code).isspace() else ""
    table |= dict.fromkeys(INKLESS, "")
    table |= {0x2026: "...", 0x2025: "..", 0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl"}
    table |= {ord(c): prototype for prototype, own in LOOKALIKES.items() for c in own}
    while changed := {x: y for x, old in table.items() if (y := unicodedata.normalize("NFD", old).translate(table)) != unicodedata.normalize("NFD", old)}:
        table |= changed
    return table


#: Texts of these characters only, in this order, are their own form.
#: Possessive throughout: a text is given up at the first other character, without trying its runs in smaller parts.
_PLAIN = re.compile(r"(?:[!-~à-ïñ-öù-ü،؛؟آ-غف-ي]++[ً-ْ]?+|ء| (?! ))*+")
_BLANKS = re.compile(" {2,}")


def char_class(codes: Iterable[int]) -> str:
    """A pattern for one of these code points, with neighbours as ranges."""
    own = sorted(codes)
    breaks = [0, *(k for k in range(1, len(own)) if own[k] != own[k - 1] + 1), len(own)]
    return "[" + "".join(f"\\U{own[a]:08x}-\\U{own[b - 1]:08x}" for a, b in zip(breaks, breaks[1:])) + "]"


@lru_cache(1)
def _replaced() -> re.Pattern[str]:
    return re.compile(char_class(prototypes()))


def skeleton(text: str | None) -> str | None:
    if text is None:
        return None
    if _PLAIN.fullmatch(text) and text[:1] != " " and text[-1:] != " ":
        return text
    table = prototypes()
    text = _replaced().sub(lambda m: table[ord(m[0])], unicodedata.normalize("NFD", text))
    text = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", _BLANKS.sub(" ", text).strip(" "))


def consistent_form(df: DataFrame, id_column: str, text_column: str, out_column: str = "form") -> DataFrame:
    """``id_column`` and the consistent form of ``text_column``; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([skeleton(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), forms], ["id", "form"])

    plain = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, form string").select(F.col("id").alias(id_column), F.col("form").alias(out_column))


def form_keys(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id``, two 64-bit names of the consistent form (together one key) and two of the text as stored; rows whose
    text is null or empty as stored are left out, texts of blanks only are not. Only these 40 bytes a row go on to any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([skeleton(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), forms, batch.column(1)], ["id", "form", "text"])

    plain = spread(df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where("text <> ''"))
    kind = plain.schema["id"].dataType.simpleString()
    forms = plain.mapInArrow(run, f"id {kind}, form string, text string")
    return forms.select(
        "id",
        F.xxhash64("form").alias("k1"),
        F.xxhash64(F.lit(1), "form").alias("k2"),
        F.xxhash64("text").alias("r1"),
        F.xxhash64(F.lit(1), "text").alias("r2"),
    )


def look_alike_groups(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row for each record with a non-empty text: its id, the smallest id of its group of equal forms, the group's
    size and how many different stored texts it has. Groups are never gathered: a hot group is pre-aggregated."""
    keys = written(form_keys(df, id_column, text_column), "forms")
    stored = keys.groupBy("k1", "k2", "r1", "r2").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    groups = stored.groupBy("k1", "k2").agg(F.min("first_id").alias("group_id"), F.sum("n").alias("group_rows"), F.count("*").alias("stored_forms"))
    return keys.join(groups, ["k1", "k2"]).select(F.col("id"), "group_id", "group_rows", "stored_forms")


def look_alike_pairs(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Pairs (id_a < id_b) with equal forms and different stored texts. Rows of forms that are stored in one way only
    leave before the join of rows with rows."""
    keys = written(form_keys(df, id_column, text_column), "forms")
    several = keys.groupBy("k1", "k2").agg(F.min("r1").alias("a1"), F.max("r1").alias("b1"), F.min("r2").alias("a2"), F.max("r2").alias("b2"))
    several = several.where("a1 <> b1 or a2 <> b2").select("k1", "k2")
    kept = keys.join(several, ["k1", "k2"], "left_semi")
    a, b = kept.alias("a"), kept.alias("b")
    same = (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & (F.col("a.id") < F.col("b.id"))
    differ = (F.col("a.r1") != F.col("b.r1")) | (F.col("a.r2") != F.col("b.r2"))
    return a.join(b, same & differ).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
