"""Awkward and empty tables through every operator and every stage of the pipeline."""

import pytest

import corpus_pipeline
from haulmetrics.llm import ann, decontaminate, html_extract, jaccard_join, line_dedup, mixing, pii, quality, suffix_dedup, toxicity

from .cases import CLASHING, awkward_docs

BENCHMARK = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (None, "word"), (4, "...")]


@pytest.fixture(params=[False, True], ids=["awkward", "empty"])
def docs(spark, request):
    return awkward_docs(spark, request.param).cache()


def benchmark_of(spark, docs):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


def labels_of(spark):
    return spark.createDataFrame([(1, 1), (1, None), (None, 1), (7, 0), (3, 0)], "doc_id long, toxic int")


def test_every_operator_gives_a_row_per_document(spark, docs):
    n = docs.count()
    machine = toxicity.train(docs, labels_of(spark))
    results = {
        "jaccard": jaccard_join.link(docs), "toxicity": toxicity.score(docs, machine), "quality": quality.classify(docs),
        "mixing": mixing.copies(docs), "decontaminate": decontaminate.report(docs, benchmark_of(spark, docs)),
        "lines": line_dedup.cut(docs), "bytes": suffix_dedup.dedup(docs), "pii": pii.report(docs),
    }
    for name, result in results.items():
        assert len(result.collect()) == n, name


def test_defined_results(spark):
    docs = awkward_docs(spark)
    linked = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.link(docs).collect()}
    assert linked[(2, 0)] == 2 and linked[(3, 0)] == 3 and linked[(None, 8)] == 1
    assert linked[(5, 10)] == linked[(6, 11)] == 5
    hits = {r.doc_id: r for r in decontaminate.report(docs, benchmark_of(spark, docs)).collect()}
    assert hits[1].n_hit == 10 and hits[None].doc_id is None and not hits[2].contaminated
    sizes = {r.doc_id: r["size"] for r in mixing.copies(docs).collect() if r.doc_id}
    assert sizes[2] == sizes[3] == sizes[4] == 0 and sizes[5] == 60000
    scores = toxicity.score(docs, toxicity.train(docs, labels_of(spark))).collect()
    assert all(0 <= r.score <= 1 for r in scores)
    kept = suffix_dedup.dedup(docs).collect()
    assert {r.n_bytes - r.n_removed for r in kept if r.doc_id in (5, 6)} == {0, 1}


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns(spark, docs, name, function, tmp_path):
    benchmark_of(spark, docs).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels_of(spark).write.parquet(str(tmp_path / "labels.parquet"))
    out = function(spark, docs, str(tmp_path))
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert bool(rows) == bool(docs.count())
    by_id = {(r.doc_id, r.text): r for r in docs.collect()}
    if name != "delete_repeated_lines":
        assert all(r.lang == by_id[r.doc_id, r.text].lang for r in rows if r.doc_id and r.doc_id != 7)
        assert all(r[c] is None or r[c].startswith(c) for r in rows for c in CLASHING)


def test_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<p>unclosed <b>bold &amp; <br> more"), (3, "w", "<" * 5000 + "a \"" * 2000),
            (4, "x", "<html><body><nav><a href=x>m</a></nav><article><h1>T</h1><p>" + "word " * 50000 + "</p></article></body></html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    chain = html_extract.train(pages)
    got = {r.page_id: r for r in html_extract.extract(pages, chain).collect()}
    assert got[1].text == "" and got[1].n_chars == 0 and got[2].text == ""
    assert got[4].text == "T\n" + " ".join(["word"] * 50000)
    assert html_extract.extract(pages.limit(0), html_extract.train(pages.limit(0))).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]),
            (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (20, [2.0, 0.0]), (40, [0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.search(vectors).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {0: [20, 1, 2], 20: [0, 1, 2]}
    assert ann.search(vectors.limit(0)).count() == 0
