"""Character classes, word lists and tables that results depend on.

Regex classes are written so that both Java and RE2 accept them.
"""

from __future__ import annotations

# Unicode White_Space, the inside of a character class.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Word characters, the inside of a character class. Combining marks are not among them.
WORD = r"\p{L}\p{N}_"

VOWELS = "аеёиоуыэюяАЕЁИОУЫЭЮЯ"
ACUTE = "́"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Order matters: each is one replacement pass.
CLOSE_UP = "!\"#$%&'()*,./:;<=>?@[\\]^_`{|}-"
CLOSE_UP_PLAIN = ",.?!:;…"

# What normalisation keeps, the inside of a character class.
KEPT = r"a-zA-Z0-9а-яА-ЯёЁ" + SPACE + r"—.,!?:;'(){}\[\]«»„“”\-"

# Sentence ends.
ENDINGS = ".?!…"
DASHES = "‑–—−-"
CLOSE_QUOTES = "»”’"
GENERIC_QUOTES = "\"„'"
CLOSE_BRACKETS = ")]}"
DELIMITERS = ".?!…;\"„'»”’)]}"
SMILEY = r"[=:;]-?[)(]{1,3}"
BULLETS = "§абвгдеabcdef"
BULLET_BOUNDS = ".)"
BULLET_SIZE = 20
SIDE = 10

TAIL_ABBREVIATIONS = "дес тыс млн млрд дол долл коп руб р проц га барр куб кв км см час мин сек в вв г гг с стр co corp inc изд ed др al".split()
HEAD_ABBREVIATIONS = (
    "букв ст трад лат венг исп кат укр нем англ фр итал греч евр араб яп слав кит рус русск латв словацк хорв "
    "mr mrs ms dr vs св арх зав зам проф акад кн корр ред гр ср чл корр им тов нач пол chap "
    "п пп ст ч чч гл стр абз пт no просп пр ул ш г гор д стр к корп пер корп обл эт пом ауд оф ком комн каб "
    "домовлад лит т рп пос с х пл bd о оз р а обр ум ок откр пс ps upd см напр доп юр физ тел сб внутр дифф гос отм"
).split()
OTHER_ABBREVIATIONS = "сокр рис искл прим яз устар шутл".split()
ABBREVIATIONS = sorted({*TAIL_ABBREVIATIONS, *HEAD_ABBREVIATIONS, *OTHER_ABBREVIATIONS})
TAIL_PAIRS = "т.п т.д у.е н.э p.m a.m с.г р.х с.ш з.д л.с ч.т".split()
HEAD_PAIRS = "т.е т.к т.н и.о к.н к.п п.н к.т л.д".split()
OTHER_PAIRS = "ед.ч мн.ч повел.накл".split()
PAIRS = sorted({*TAIL_PAIRS, *HEAD_PAIRS, *OTHER_PAIRS})
INITIALS = ["дж", "ed", "вс"]

# BERT's own classes.
BERT_PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
BERT_CONTROL = r"[\x{0}\x{FFFD}]|[\p{C}&&[^\t\n\r]]"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"

# Labels of the four scorers, by class number.
ACCENT_LABELS = ["NO", "STRESS_PRIMARY", "STRESS_SECONDARY"]
USAGE_LABELS = ["NO_STRESS", "PUNCT", "STRESS"]
YO_LABELS = ["NO_YO", "PUNCT", "YO"]
ACCENT_CUT = 0.55

# Dictionary entries that are always there.
LETTER_ACCENTS = [("о", "+о")]
HOMOGRAPH_OVERRIDES = [("коса", ["к+оса", "кос+а"])]

# The character vocabulary of the accent scorer: its position is its identifier.
CHAR_VOCABULARY = ["[pad]", "[unk]", "[bos]", "[eos]", "'", "-", ".", "?", "`", "c", "e", ACUTE, *"абвгдежзийклмнопрстуфхцчшщъыьэюяё"]
