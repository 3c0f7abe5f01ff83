import duckdb
import public_tokenizers
import pytest
from tests.llm.common import documents
from tests.llm.test_operators import jaccard
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = sorted(c.sql(queries.SQL[name]).project(", ".join(columns)).fetchall(), key=repr)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert len(got) == len(want) and all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))


def test_pipeline(spark):
    """Each stage against what it says, on its own input; the last against the library."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, sf = docs, "/root/testdata/sf0.01"
        docs = corpus_pipeline.materialize(stage(spark, before, sf), name)
        if name != "tokens":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        old, new = ({r.doc_id for r in d.select("doc_id").collect()} for d in (before, docs))
        assert new <= old
        if name == "quality":
            assert {i for i, q in labels.items() if q == 1} <= new and len(new) > 0.8 * len(old)
        if name == "near_duplicates":
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts)
        if name == "decontamination":
            assert decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        if name == "tokens":
            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
            assert sum(r.n_tokens for r in docs.collect()) == want


def test_pipeline_near_duplicates_against_brute_force(spark):
    """One document stays of each group that all pairs give."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = jaccard([(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i, (_, group) in groups.items() if i == group} and len(kept) < len(groups)


def test_pipeline_stages_take_nothing(spark):
    empty = documents(spark, []).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
