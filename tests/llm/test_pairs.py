"""The join, the substring dedup and the neighbours against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from accentweave.llm import components, jaccard, neighbours, substring, textscan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(i)
    return sorted((i, len(s), min(groups[find(k)])) for k, (i, s) in enumerate(sets))


def test_components_match_brute_force(corpus, rows):
    got = jaccard.near_duplicates(corpus.withColumn("token", F.lit(1)).withColumn("node", F.lit("x")))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_near_copies_that_link_only_in_part(spark):
    """Copies of one text with one to seven edits: some link, some do not, none is lost."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(150), k % 8):
            words[at] = f"e{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_chain_of_links_is_one_component(spark):
    words = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(12):
        rows.append((100 - k, " ".join(words)))
        for j in range(2):
            words[(k * 9 + j) % 100] = f"n{k}_{j}"
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_rows_without_a_number_are_returned_if_asked_for(spark):
    rows = [(1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (2, "A b c d e f g"), (None, "x y")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), null_ids=True).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, 3, 1), (2, 3, 1), (None, 3, None), (None, 0, None), (None, 1, None)]))


def test_crowded_shingles(spark, monkeypatch):
    """With every shingle counted in parts, the result is the same."""
    monkeypatch.setattr(jaccard, "_classes", lambda counts, real=jaccard._classes: (real(counts)[0], 0))
    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = [f"w{j}" for j in range(60)]
        for at in rng.sample(range(60), k % 5):
            words[at] = f"e{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_pairs_whose_sketches_differ_too_much_are_not_looked_at(spark, monkeypatch):
    """Texts made of the same passages meet often and hardly link; sketches lose no link and few such pairs stay."""
    rng = random.Random(12)
    rows = [(k, " ".join(f"p{p}w{j}" for p in rng.sample(range(14), 7) for j in range(12))) for k in range(80)]
    rows += [(k + 80, t.replace("w3", f"e{k}", 1)) for k, t in rows[:10]]
    table, made = spark.createDataFrame(rows, "doc_id long, text string"), []

    def counted(pairs, *rest, real=jaccard.verified, **how):
        made.append(pairs.count())
        return real(pairs, *rest, **how)

    monkeypatch.setattr(jaccard, "verified", counted)
    assert sorted(map(tuple, jaccard.near_duplicates(table).collect())) == brute_components(rows)
    monkeypatch.setattr(jaccard, "sketch", lambda shingles: np.zeros(len(jaccard.SKETCH), np.int64))
    assert sorted(map(tuple, jaccard.near_duplicates(table).collect())) == brute_components(rows)
    assert made[0] == made[2] and made[1] < made[3] / 4


def test_sketches_differ_in_no_more_bits_than_sets_in_members():
    rng = np.random.default_rng(5)
    for n in (0, 1, 20, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        b = np.union1d(a[n // 5 :], rng.integers(0, 1 << 56, n // 7, dtype=np.uint64))
        differ = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_one_of_each_group_stays(corpus, rows):
    kept = jaccard.keep_one(corpus)
    assert kept.columns == corpus.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({c for _, _, c in brute_components(rows)})
    assert kept.where("doc_id is null").count() == 2


def test_empty_tables(empty):
    assert jaccard.near_duplicates(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0
    assert substring.dedup_substrings(empty).count() == 0


def test_prefix_tree_finds_what_plain_comparison_finds():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        sets += [base, np.unique(np.concatenate([base[:-2], rng.integers(0, 90, 3).astype(np.uint64)]))]
    tree = jaccard.PrefixTree(sets)
    for probe in sets[::7]:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 80 * len(np.union1d(s, probe))}
        assert set(tree.similar(probe, 80)) == want


@pytest.mark.parametrize(("seed", "links_a_task"), [(0, 1 << 20), (1, 20), (2, 7)])
def test_connected_components(spark, seed, links_a_task):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(a, find(a)) for pair in links if pair[0] != pair[1] for a in pair}
    got = components.components(spark.createDataFrame(links, "a long, b long"), links_a_task)
    assert {(r["node"], r["root"]) for r in got.collect()} == want


def test_contraction_of_links():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    got = dict(zip(*(v.tolist() for v in components.contract(a, b)), strict=True))
    root = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        same = {x, y} | {n for n, r in root.items() if r in (root.get(x, x), root.get(y, y))}
        root |= dict.fromkeys(same, min(min(same), *(root.get(n, n) for n in same)))
    assert got == {n: r for n, r in root.items() if n != r}


def brute_cut(rows, window=50):
    first, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                at = tuple(w[k : k + window])
                first[at] = min(i, first.get(at, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("fan", [512, 1])
def test_substrings_match_brute_force(corpus, rows, fan):
    """With a fan of 1 every anchor with several texts takes the way of crowded anchors."""
    got = substring.dedup_substrings(corpus.withColumn("anchor", F.lit(0)).withColumn("form", F.lit("f")), fan=fan)
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect())
    assert found == brute_cut(rows)


def test_crowded_windows_meet_as_blocks(spark, monkeypatch):
    """Near copies under crowded anchors: the result is that of all windows, few of which are rows of their own."""
    made = {}

    def counted(df, name, real=substring.stash, **how):
        out = real(df, name, **how)
        made[name] = made.get(name, 0) + out[0].count()
        return out

    monkeypatch.setattr(substring, "stash", counted)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(80):
        words = list(base[rng.randrange(30) : 200 - rng.randrange(30)])
        for at in rng.sample(range(len(words)), k % 3):
            words[at] = f"e{rng.randrange(10**9)}"
        rows.append((rng.randrange(60), " ".join(words)))
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), fan=1)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()) == brute_cut(rows)
    runs = [substring.runs_of(w, 50, 8) for _, w, at in textscan.word_hashes(pa.array([" ".join(base)]), lower=False)]
    windows = made["run-texts"] * sum(r[3].sum() for r in runs) / sum(len(r[3]) for r in runs)
    assert 0 < made["crowded-windows"] < windows / 2


def test_suffix_automaton_matching_statistics():
    rng = random.Random(2)
    texts = [[rng.randrange(3) for _ in range(40)] for _ in range(4)]
    automaton = substring.SuffixAutomaton()
    for t in texts[:3]:
        automaton.add(t)
    factors = {tuple(t[a:z]) for t in texts[:3] for a in range(40) for z in range(a + 1, 41)}
    want = [max([n for n in range(1, k + 2) if tuple(texts[3][k + 1 - n : k + 1]) in factors], default=0) for k in range(40)]
    assert automaton.matching_statistics(texts[3]) == want


def test_words_are_cut_where_the_pattern_says(rows):
    import pyarrow as pa

    column = pa.array([t for _, t in rows])
    for i, hashes, at in textscan.word_hashes(column, lower=False):
        for r in range(len(at) - 1):
            assert at[r + 1] - at[r] == len(WORD.findall(rows[i + r][1] or ""))


def test_neighbours_reach_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[50] = x[40]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(7, x[7].tolist()), (2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [float("inf")] * 16), (2005, [1.0] * 3), (None, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        true = x @ x[q]
        true[q] = -np.inf
        want = sorted(range(1500), key=lambda k: (-round(true[k], 9), k))[:20]
        hits += len(set(want) & {v for v, _ in found})
        assert len(found) == 20 and q not in {v for v, _ in found}
        assert np.allclose([s for _, s in found], [x[v] @ x[q] for v, _ in found])
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize(("least", "recall"), [(40, 0.4), (400, 0.9)])
def test_neighbours_of_clusters_need_few_candidates(spark, least, recall):
    """Far more vectors than ``least``: queries descend beyond the counted bits and still find their clusters."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(250, 24))
    x = np.repeat(centres, 20, axis=0) + rng.normal(size=(5000, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(table, table.where("vec_id % 50 = 0"), k=10, share=0.0, least=least).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 5000, 50):
        true = x @ x[q]
        true[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-true)[:10].tolist()))
    assert hits >= recall * 10 * 100


def test_longer_prefixes_are_counted():
    rng = np.random.default_rng(8)
    code = np.sort(rng.integers(0, 1 << 20, 300, dtype=np.uint64) << np.uint64(40))
    own = np.concatenate([code[:5], rng.integers(0, 1 << 60, 5, dtype=np.uint64)])
    got = neighbours.longer_prefixes(code, own)
    for r, c in enumerate(own.tolist()):
        for k, bits in enumerate(range(neighbours.DEPTH + 1, neighbours.BITS + 1)):
            assert got[r, k] == sum(v >> (64 - bits) == c >> (64 - bits) for v in code.tolist())


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 4.0), (2, 2, 4.0)]
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0
