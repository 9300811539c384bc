"""The stages against brute force, one after the other."""

from __future__ import annotations

import inspect

import corpus_pipeline
from recordloom.llm import queries, toxicity
from recordloom.session import materialise
from tests.llm.test_duplicates import brute_components
from tests.llm.test_tokens import wanted


def test_stages_one_by_one(spark, sf_dir, documents):
    names = documents.columns
    docs = {n: f for n, f in corpus_pipeline.STAGES}
    assert list(docs) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]

    model = toxicity.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    clean = materialise(docs["toxicity"](spark, documents, sf_dir), "t")
    assert clean.columns == names
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}

    single = materialise(docs["exact_dedup"](spark, clean, sf_dir), "t")
    last = {}
    for row in sorted(clean.collect(), key=lambda r: r.doc_id):
        last[row.text or ""] = row
    assert single.columns == names
    assert sorted(single.collect()) == sorted(last.values())

    apart = materialise(docs["near_dedup"](spark, single, sf_dir), "t")
    rows = {r.doc_id: r for r in single.collect()}
    component = brute_components({i: r.text or "" for i, r in rows.items()})
    assert apart.columns == names
    assert sorted(apart.collect()) == sorted(rows[i] for i, c in component.items() if i == c)

    mixed = materialise(docs["mixing"](spark, apart, sf_dir), "t")
    assert mixed.columns == names
    times = {}
    for row in mixed.collect():
        times[row] = times.get(row, 0) + 1
    assert set(times) <= set(apart.collect()) and max(times.values()) <= queries.MIXTURE_EPOCHS
    size = {r: 1 + len((r.text or "").encode()) // 4 for r in apart.collect()}
    total = sum(size.values())
    assert 0.5 * total < sum(size[r] * n for r, n in times.items()) <= total

    ids = docs["byte_bpe"](spark, mixed, sf_dir).collect()
    text = {r.doc_id: r.text or "" for r in apart.collect()}
    assert len(ids) == mixed.count()
    for row in ids:
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == wanted(text[row.doc_id])
        assert len(row.ids) == row.n_tokens


def test_stages_of_nothing(spark, sf_dir, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = materialise(stage(spark, docs, sf_dir), "t")
    assert docs.count() == 0


def test_stages_take_edge_rows(spark, sf_dir, edge_docs, edge_rows):
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "t")
        assert docs.columns == edge_docs.columns, name
        assert {tuple(r) for r in docs.collect()} <= set(edge_rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
