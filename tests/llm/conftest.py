import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgklmnprst" for b in "aeiou" for c in ("n", "ra", "lo", "st", "")][:words]
    return [rng.choice(vocabulary) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """A small corpus with copies, near copies, nulls, empty, short and long texts, ties and repeated rows."""
    rng = random.Random(3)
    rows = []
    base = [prose(k, 90 + 7 * k) for k in range(12)]
    number = 0
    for k, words in enumerate(base):
        rows.append((number, " ".join(words), "en", f"s{k % 3}"))
        number += 1
        for copy in range(k % 4):
            edited = list(words)
            for _ in range(copy):
                edited[rng.randrange(len(edited))] = f"edit{rng.randrange(10**6)}"
            rows.append((number, "\n".join([" ".join(edited[:40]), " ".join(edited[40:])]), "en" if copy else None, None if copy == 2 else f"s{k % 3}"))
            number += 1
    passage = " ".join(prose(99, 60))
    for k in range(6):
        rows.append((number, " ".join(prose(200 + k, 30)) + " " + passage + " " + " ".join(prose(300 + k, 30 + k)), "fr", "s1"))
        number += 1
    for text in (None, "", "   ", "!!! ??? 123", "one", "one two", "one two", "É È ñ", " ".join(prose(5, 4000)), "x" * 5000, "tab\tand\x0bvertical\x0cfeed\r\nline"):
        rows.append((number, text, "en", "s2"))
        number += 1
    rows += [(None, "no number here", "en", "s2"), (None, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.collect()]
