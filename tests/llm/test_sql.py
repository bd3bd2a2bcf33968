"""Queries against their SQL on the smallest tables, and the pipeline's stages against plain versions."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from accentweave.llm import decontaminate, queries

from .conftest import prose
from .test_pairs import brute_components
from .test_rows import plain_templates

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    flat = [frame[columns].astype(str).sort_values(columns).reset_index(drop=True) for frame in (got, want)]
    assert flat[0].equals(flat[1])


def test_pipeline_stages_match_plain_versions(spark, corpus, tmp_path):
    """Each stage on its own input, which holds nulls, empty texts, copies and repeated rows."""
    import corpus_pipeline

    leak = " ".join(prose(2, 30))
    boiler = [(500 + k, "\n".join([" ".join(prose(900 + k, 40)), f"Page {k} of {k + 3} pages of this book"]), "en", "s1", 1) for k in range(14)]
    boiler += [(600, " ".join(prose(3, 60)) + " " + leak, "en", "s2", 7)]
    docs = corpus.unionByName(spark.createDataFrame(boiler, corpus.schema))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(name)
        if name == "source_mix":
            got = docs.collect()
            assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in before)
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t in before)
            break
        after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name == "language_id":
            assert not Counter(after) - Counter(before) and all(t and re.search("[^\\W\\d_]", t) for _, t in after)
        elif name == "line_dedup":
            gone, first = plain_templates(before, 10, 3, 0.6), {}
            for i, t in before:
                for n, line in enumerate((t or "").split("\n")):
                    if (i, n) in gone:
                        key = re.sub(r"\S*[0-9]\S*", "#", line)
                        first[key] = min((i, first.get(key, i)), key=lambda v: (v is None, v))
            kept = [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone or first[re.sub(r"\S*[0-9]\S*", "#", x)] == i)) for i, t in before]
            assert Counter(after) == Counter(kept) and len(gone) == 14
        elif name == "ngram_jaccard":
            stay = {c for _, _, c in brute_components(before)}
            assert Counter(after) == Counter({r for r in before if r[0] in stay}) + Counter(r for r in before if r[0] is None)
        else:
            leaked = {r["doc_id"] for r in decontaminate.contaminated(spark.createDataFrame(before, "doc_id long, text string"), spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect()}
            assert 600 in leaked and Counter(after) == Counter(r for r in before if r[0] not in leaked)
    assert len(seen) == 5


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item of some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
