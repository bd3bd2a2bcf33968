"""The text functions of whole documents once more, as plain Python on normalised text.

Normalised text holds few characters: those of ``charsets.KEPT`` and ``+``. Over these the classes below are what the Unicode
classes of ``text``, ``words`` and ``sentences`` come to, and each function gives what its namesake there gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from . import charsets as C

_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "a-zA-Zа-яА-ЯёЁ"
_W = f"[{_LETTERS}0-9]+"
_TOKEN = rf"{_W}(?:\+{_W})*|(?:\+{_W})+|[^{_LETTERS}0-9{_SPACES}]+"
_ONE = rf"[{_LETTERS}]+|[0-9]+|[^{_LETTERS}0-9{_SPACES}]"

_DROPPED = re.compile(rf"[^{_LETTERS}0-9{_SPACES}—.,!?:;'(){{}}\[\]«»„“”\-]+")
_TOKENS, _PARTS = re.compile(_TOKEN), re.compile(f"({_TOKEN})")
_BERT_GONE = re.compile("[\x0b\x0c\x85]+")
BERT_SIGNS = frozenset("—.,!?:;'(){}[]«»„“”-+")
_BERT_BREAK = "\\t\\n\\r \\xa0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
_BERT_TOKEN = re.compile("[^{0}{1}]+|[{1}]".format(_BERT_BREAK, "".join("\\" + c for c in sorted(BERT_SIGNS))))
_CLOSE_UP = re.compile(" {{1,2}}(?=-)| (?=[{}])|(?<=-) ".format("".join("\\" + c for c in C.CLOSE_UP if c != "-")))
_BEFORE = frozenset(C.CLOSE_UP) - {"-"}
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
_VOWEL = re.compile(f"[{C.VOWELS}]")
_TWO_VOWELS = re.compile(f"[{C.VOWELS}][^{C.VOWELS}]*+[{C.VOWELS}]")


def normalize(text: str) -> str:
    return _DROPPED.sub("", text)


def tokens(text: str) -> list[str]:
    """The words of a whole text. Sentences end before white space only, so that these are the words of its sentences."""
    return _TOKENS.findall(text.replace(" - ", " ~ "))


def words_and_gaps(sentence: str) -> tuple[list[str], list[str]]:
    """The words, and what lies before each of them and after the last; one empty gap if there is no word."""
    parts = _PARTS.split(sentence.replace(" - ", " ~ "))
    return (parts[1::2], parts[::2]) if len(parts) > 1 else ([], [""])


def bert_words(sentence: str) -> list[str]:
    if "\x0b" in sentence or "\x0c" in sentence or "\x85" in sentence:
        sentence = _BERT_GONE.sub("", sentence)
    return _BERT_TOKEN.findall(sentence)


def has_vowel(word: str) -> bool:
    return _VOWEL.search(word) is not None


def close_up(text: str) -> str:
    return _CLOSE_UP.sub("", text).replace("~", "-")


def plus_to_acute(text: str) -> str:
    return re.sub(r"(?s)\+(.)", r"\1" + C.ACUTE, text).replace("+", "")


# Sentences --------------------------------------------------------------------------------------------------

_SPACE_SET = frozenset(_SPACES)
_SMILEY = "[:;]-?[)(]{1,3}"
_DELIMITER = re.compile(rf"{_SMILEY}|[.?!;„'»”)\]}}]")
_LEFT = re.compile(rf"({_ONE})[{_SPACES}]*\Z")
_RIGHT = re.compile(rf"[{_SPACES}]*({_ONE})")
_NEXT_SMILEY = re.compile(rf"[{_SPACES}]*{_SMILEY}")
_NEXT_WORD = re.compile(f"[{_LETTERS}]+|[0-9]+")
_PAIR = re.compile(rf"[{_LETTERS}0-9][{_SPACES}]*\.[{_SPACES}]*[{_LETTERS}0-9][{_SPACES}]*\Z")
_LOWER = re.compile("[a-zа-яё]+")
_ALPHA = re.compile(f"[{_LETTERS}]+")
_UPPER = re.compile("[A-ZА-ЯЁ]")
_BULLETS = re.compile(rf"(?:[{_SPACES}]|[0-9]|[.)]|(?<![{_LETTERS}])(?:[{C.BULLETS}{C.BULLETS.upper()}]|[IVXML]++)(?![{_LETTERS}]))*")
_HEADS, _ABBREVIATIONS = frozenset(C.HEAD_ABBREVIATIONS), frozenset(C.ABBREVIATIONS)
_HEAD_PAIRS, _PAIRS = frozenset(C.HEAD_PAIRS), frozenset(C.PAIRS)
_CLOSING, _QUOTES, _ENDINGS = frozenset(C.CLOSE_QUOTES + C.CLOSE_BRACKETS), frozenset(C.GENERIC_QUOTES), frozenset(C.ENDINGS)
_DELIMITERS, _DASHES, _INITIALS = frozenset(C.DELIMITERS), frozenset(C.DASHES), frozenset(C.INITIALS)


def _open_right(token: str) -> bool:
    return token.isdigit() or not _ALPHA.fullmatch(token) or _LOWER.fullmatch(token) is not None


def _joined(text: str, begin: int, p: int, q: int, delim: str) -> bool:
    """Whether the sentence from ``begin`` on does not end with the delimiter at ``p:q``."""
    if q == len(text) or text[q] not in _SPACE_SET:
        return True
    right = text[q : q + C.SIDE]
    found = _RIGHT.match(right)
    if not found:
        return True
    rt = found[1]
    if _LOWER.fullmatch(rt) or (rt not in _QUOTES and (rt in _DELIMITERS or _NEXT_SMILEY.match(right))):
        return True
    left = text[max(p - C.SIDE, 0) : p]
    found = _LEFT.search(left)
    if not found:
        return True
    lt = found[1]
    if delim == ".":
        low, pair = lt.lower(), ""
        if "." in left and (both := _PAIR.search(left)):
            pair = "".join(c for c in both[0] if c not in _SPACE_SET).lower()
        if pair in _HEAD_PAIRS:
            abbreviated = True
        elif pair in _PAIRS:
            abbreviated = _open_right(rt)
        else:
            abbreviated = low in _HEADS or (low in _ABBREVIATIONS and _open_right(rt))
        if abbreviated or f"{lt}.{rt}".lower() in _PAIRS or _UPPER.fullmatch(lt) or low in _INITIALS:
            return True
    if delim in C.BULLET_BOUNDS and p - begin <= C.BULLET_SIZE and _BULLETS.fullmatch(text, begin, p):
        return True
    if delim in _CLOSING and lt not in _ENDINGS:
        return True
    if delim in _QUOTES and (left[-1] in _SPACE_SET or lt not in _ENDINGS):
        return True
    if rt in _DASHES:
        word = _NEXT_WORD.search(right)
        return bool(word and _LOWER.fullmatch(word[0]))
    return False


def sentences(text: str) -> list[str]:
    out, begin = [], 0
    for cut in _DELIMITER.finditer(text):
        p, q = cut.span()
        if not _joined(text, begin, p, q, cut[0]):
            out.append(text[begin:q])
            begin = q
    out.append(text[begin:])
    return out


# Words ------------------------------------------------------------------------------------------------------


def fix_capital(source: str, target: str) -> str:
    if len(source) != len(target):
        return target
    return "".join(b.upper() if a == a.upper() and a != a.lower() else b.lower() for a, b in zip(source, target, strict=True))


def restore_yo(word: str, form: str | None, homograph: str | None, label: str | None) -> str:
    found = homograph if label == "YO" else form
    return word if found is None else fix_capital(word, found)


def remap_plus(word: str, stressed: str) -> str:
    places = [i for i, c in enumerate(stressed) if c == "+"]
    if len(places) == 1:
        return word[: places[0]] + "+" + word[places[0] :]
    out = word
    for j, p in enumerate(places):
        out = out[: p + j] + "+" + word[p:]
    return out


def needs_scorer(word: str, stressed: str | None) -> bool:
    low = word.lower()
    return (stressed is None or stressed == low) and not _PUNCTUATION.search(word) and _TWO_VOWELS.search(word) is not None


def accent(word: str, stressed: str | None, label: str | None, scorer: Callable[[str], str | None] | None = None) -> str:
    if "+" in word or label != "STRESS":
        return word
    if scorer is not None and needs_scorer(word, stressed):
        scored = scorer(word)
        return word if scored is None else scored
    return word if stressed is None else remap_plus(word, stressed)


def insert_last(word: str) -> str:
    """``+`` before the last vowel."""
    for i in range(len(word) - 1, -1, -1):
        if word[i] in C.VOWELS:
            return word[:i] + "+" + word[i:]
    return word


def mark_word(words: list[str], position: int) -> str:
    return close_up(" ".join([*words[:position], f" <w>{words[position]}</w> ", *words[position + 1 :]]))


def marker(words: list[str], short: int = 40) -> Callable[[int], str]:
    """:func:`mark_word` for many places of the same words: what lies before and after is closed up once, if that is long.

    What is taken from a run of spaces rests on the characters at both ends of it, so only the runs beside the place are new.
    """
    if len(words) < short or not all(words) or any(" " in w for w in words):
        return lambda i: mark_word(words, i)
    closed, begins, ends, at = [], [], [], 0
    for i, w in enumerate(words):
        if i and words[i - 1][-1] != "-" and w[0] != "-" and w[0] not in _BEFORE:
            closed.append(" ")
            at += 1
        begins.append(at)
        closed.append(w)
        at += len(w)
        ends.append(at)
    whole = "".join(closed).replace("~", "-")

    def at_place(i: int) -> str:
        before = "" if i == 0 else whole[: ends[i - 1]] + ("" if words[i - 1][-1] == "-" else " ")
        if i + 1 == len(words):
            return f"{before}<w>{whole[begins[i] : ends[i]]}</w> "
        lead = words[i + 1][0]
        return f"{before}<w>{whole[begins[i] : ends[i]]}</w>{'' if lead == '-' else ' ' if lead in _BEFORE else '  '}{whole[begins[i + 1] :]}"

    return at_place
