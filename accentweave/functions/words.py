"""Words, the gaps between them, and putting them together again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets as C
from .text import close_up, hyphen_to_tilde

W = f"[{C.WORD}]+"
TOKEN = rf"{W}(?:\+{W})*|(?:\+{W})+|[^{C.WORD}{C.SPACE}]+"


def words(sentence: Column) -> Column:
    """Runs of word characters, with ``+`` inside and before them, and runs of other visible characters."""
    return F.regexp_extract_all(hyphen_to_tilde(sentence), F.lit(TOKEN), F.lit(0))


def gaps(sentence: Column) -> Column:
    """What lies before each word and after the last; two empty strings if there is no word."""
    cut = F.split(hyphen_to_tilde(sentence), TOKEN, -1)
    return F.when(F.size(cut) > 1, cut).otherwise(F.array(F.lit(""), F.lit("")))


def reassemble(words: Column, gaps: Column, last_gap: bool = True) -> Column:
    """Gap, word, gap, word … and the last gap; then punctuation is closed up."""
    joined = F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.concat(g, w)), "")
    if last_gap:
        joined = F.concat(joined, F.get(gaps, F.size(words)))
    return close_up(joined)


def mark_word(words: Column, position: Column) -> Column:
    """The sentence's words joined by spaces, the one at ``position`` between ``<w>`` and ``</w>``."""
    shown = F.transform(words, lambda w, i: F.when(i == position, F.concat(F.lit(" <w>"), w, F.lit("</w> "))).otherwise(w))
    return close_up(F.array_join(shown, " "))


def bert_clean(sentence: Column) -> Column:
    """Without control characters, white space as spaces, ideographs on their own."""
    clean = F.regexp_replace(sentence, C.BERT_CONTROL, "")
    return F.regexp_replace(F.regexp_replace(clean, r"[\t\n\r\p{Zs}]", " "), f"([{C.CJK}])", " $1 ")


def bert_words(sentence: Column) -> Column:
    """BERT's pre-tokens: every punctuation character alone, all else up to white space together."""
    return F.regexp_extract_all(bert_clean(sentence), F.lit(rf"[^ {C.BERT_PUNCTUATION}]+|[{C.BERT_PUNCTUATION}]"), F.lit(0))


def char_ids(word: Column, vocabulary: list[str] | None = None) -> Column:
    """Identifiers of a word's lower-case characters between start (2) and end (3); unknown ones are 1."""
    known = vocabulary or C.CHAR_VOCABULARY
    singles = [c for c in known if len(c) == 1]
    table = F.create_map(*[x for c in singles for x in (F.lit(c), F.lit(known.index(c)))])
    return F.concat(F.array(F.lit(2)), F.transform(F.filter(F.split(F.lower(word), ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(1))), F.array(F.lit(3)))
