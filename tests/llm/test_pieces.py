"""Pieces keep every character, stay within the limit and cut words only where they must."""

import random
import re

from qissaflow.llm.pieces import pieces


def check(text, limit=2000, overlap=100):
    out = pieces(text, limit, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for a, b, forced in out:
        assert 0 < b - a <= limit
        if forced:
            assert text[b - 1].isalnum() and text[b].isalnum()
    for (a, b, _), (c, d, _) in zip(out, out[1:]):
        assert a < c <= b < d
    unbroken = re.search(rf"[^\W_]{{{limit + 1}}}", text) is not None
    assert any(f for _, _, f in out) == unbroken
    return out


def test_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        text = ""
        while len(text) < rng.choice((300, 900)):
            text += rng.choice("ابتabc") * rng.choice((1, 3, 8, 30, 60, 99, 100, 101, 150, 260)) + rng.choice((" ", "  ", ". ", "،", "\n", "-", "ا"))
        check(text, 100, 10)


def test_words_at_the_limit():
    for n in (1999, 2000, 2001, 4100):
        check("ا" * n + " " + "ب" * 1500)
        check("قال " * 30 + "ا" * n + " قال" * 700)
        check(("قال " * 30 + "ا" * n) * 3)


def test_plain_text_repeats_a_hundred_characters_and_is_balanced():
    text = "قال المجنون للخليفة. " * 400
    out = check(text)
    assert all(80 <= b - c <= 160 for (_, b, _), (c, _, _) in zip(out, out[1:]))
    assert len(out) == -(-(len(text) - 100) // 1900) and min(b - a for a, b, _ in out) > 1200
    assert all(text[b - 2 : b] == ". " or b == len(text) for _, b, _ in out)


def test_no_cut_between_a_letter_and_its_mark():
    out = pieces("بَ" * 3000)
    assert all(("بَ" * 3000)[a] == "ب" for a, _, _ in out)
