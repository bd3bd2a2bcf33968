"""Scalar text functions, all of them column expressions. Positions count Unicode code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets as C

V = f"[{C.VOWELS}]"
# Most characters of most texts; looked at before longer classes, as Java tries the parts of a class one by one.
_COMMON = "(?![ a-zA-Z0-9,.а-яА-ЯёЁ])"


def normalize(text: Column) -> Column:
    """Deletes every character that is not kept; ``+`` and combining marks go too."""
    return F.regexp_replace(text, f"{_COMMON}[^{C.KEPT}]", "")


def normalize_keep_plus(text: Column) -> Column:
    """As :func:`normalize`, but a ``+`` between two word characters of the input stays."""
    lone = F.regexp_replace(text, rf"(?<![{C.WORD}])\+|\+(?![{C.WORD}])", "")
    return F.regexp_replace(lone, f"{_COMMON}[^+{C.KEPT}]", "")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^[{C.SPACE}]+|[{C.SPACE}]+$", "")


def find(text: Column, part: Column, start: int = 0) -> Column:
    """The 0-based place of ``part`` at or after ``start``, or -1."""
    return F.call_function("locate", part, text, F.lit(start + 1)) - 1


def hyphen_to_tilde(text: Column) -> Column:
    return F.replace(text, F.lit(" - "), F.lit(" ~ "))


def lookup_key(word: Column) -> Column:
    return F.lower(word)


def count_vowels(word: Column) -> Column:
    return F.length(F.regexp_replace(word, f"[^{C.VOWELS}]", ""))


def has_vowels(word: Column, n: int) -> Column:
    """Whether there are ``n`` vowels at least; a search, where counting builds a text."""
    return word.rlike(f"(?:{V}[^{C.VOWELS}]*+){{{n}}}")


def has_punctuation(word: Column) -> Column:
    return word.rlike(r"[!-/:-@\[-`{-~]")


def is_space(char: Column) -> Column:
    return char.rlike(f"^[{C.SPACE}]+$")


def is_digit(char: Column) -> Column:
    return char.rlike(r"^\p{Nd}+$")


def is_word(char: Column) -> Column:
    return char.rlike(f"^[{C.WORD}]+$")


def is_upper(char: Column) -> Column:
    return char.rlike(r"^\p{Lu}+$")


def _letters(word: Column) -> Column:
    return F.split(word, "")


def fix_capital(source: Column, target: Column) -> Column:
    """``target`` with the case of ``source``, letter by letter; unchanged if their lengths differ.

    Lower-case words, and those with a capital at the beginning, are done without taking them apart.
    """
    plain = target.rlike("^[а-яё]+$")
    moved = F.zip_with(_letters(source), _letters(target), lambda a, b: F.when((a == F.upper(a)) & (a != F.lower(a)), F.upper(b)).otherwise(F.lower(b)))
    led = F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 1 << 30))
    whole = F.when(plain & source.rlike("^[а-яё]+$"), target).when(plain & source.rlike("^[А-ЯЁ][а-яё]*$"), led)
    return F.when(F.length(source) != F.length(target), target).otherwise(F.coalesce(whole, F.array_join(moved, "")))


def close_up(text: Column) -> Column:
    """One space goes before each punctuation character, and two before and one after ``-``, of as many as there are.

    Then ``~`` becomes ``-`` again. Runs of spaces are not collapsed: a pass for each character takes one space from a run
    at most, so what all passes take is known from the characters at both ends of it, and one search takes it.
    """
    others = "".join(f"\\{c}" for c in C.CLOSE_UP if c != "-")
    return F.replace(F.regexp_replace(text, f" {{1,2}}(?=-)| (?=[{others}])|(?<=-) ", ""), F.lit("~"), F.lit("-"))


def close_up_plain(text: Column) -> Column:
    """White space goes before ``, . ? ! : ; …``."""
    return F.regexp_replace(text, rf"[{C.SPACE}]+([{C.CLOSE_UP_PLAIN}])", "$1")


def insert_plus(word: Column, position: Column) -> Column:
    """``+`` before the character at a 0-based position; unchanged if that is null."""
    return F.when(position.isNull(), word).otherwise(F.overlay(word, F.lit("+"), position + 1, F.lit(0)))


def put_yo(word: Column, positions: Column) -> Column:
    """``е`` becomes ``ё`` at the given 0-based positions."""
    return F.array_join(F.transform(_letters(word), lambda c, i: F.when(F.array_contains(positions, i), F.translate(c, "еЕ", "ёЁ")).otherwise(c)), "")


def remap_plus(word: Column, stressed: Column) -> Column:
    """``word``, in its own case, with the ``+`` of ``stressed``.

    Right for one ``+``. Of more, each rebuilds the word's tail from the unmarked word at the place it has
    in ``stressed``, so later ones come late.
    """
    places = F.filter(F.transform(_letters(stressed), lambda c, i: F.when(c == "+", i)), lambda i: i.isNotNull())
    many = F.aggregate(
        F.transform(places, lambda p, j: F.struct(p.alias("p"), j.alias("j"))), word, lambda out, x: F.concat(F.substring(out, F.lit(1), x["p"] + x["j"]), F.lit("+"), F.substring(word, x["p"] + 1, F.length(word)))
    )
    at = F.instr(stressed, "+")
    count = F.length(stressed) - F.length(F.replace(stressed, F.lit("+"), F.lit("")))
    return F.when(count == 0, word).when(count == 1, F.overlay(word, F.lit("+"), at, F.lit(0))).otherwise(many)


def canonical_marks(text: Column) -> Column:
    """An acute after a vowel becomes ``+`` before it; other acutes go."""
    once = F.regexp_replace(text, f"({V}){C.ACUTE}", r"+$1")
    return F.replace(F.regexp_replace(once, f"({V}){C.ACUTE}", r"+$1"), F.lit(C.ACUTE), F.lit(""))


def has_marks(text: Column) -> Column:
    """Whether a user has marked stress: an acute after a vowel or ``+`` before one."""
    return text.rlike(rf"{V}{C.ACUTE}|\+{V}")


def plus_to_acute(text: Column) -> Column:
    """``+`` before a character becomes an acute after it; a last ``+`` goes."""
    return F.replace(F.regexp_replace(text, r"(?s)\+(.)", "$1" + C.ACUTE), F.lit("+"), F.lit(""))


NOTATIONS = ("combining_acute", "plus")


def render(text: Column, notation: str = "combining_acute") -> Column:
    if notation not in NOTATIONS:
        raise ValueError(f"notation must be one of {NOTATIONS}, not {notation!r}")
    return plus_to_acute(text) if notation == "combining_acute" else text


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """The 0-based place of the largest value, the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1


def accent_from_scores(word: Column, scores: Column, cut: float = C.ACCENT_CUT) -> Column:
    """``word`` with ``+`` before each character that the accent scorer calls primary with a score of ``cut``.

    ``scores``: probabilities by token; token i stands for character i - 1, the first and last for none.
    """

    def mark(c: Column, i: Column) -> Column:
        p = F.get(scores, i + 1)
        return F.concat(F.when((argmax(p) == 1) & (F.array_max(p) >= cut), F.lit("+")).otherwise(F.lit("")), c)

    return F.array_join(F.transform(_letters(word), mark), "")
