"""Toxicity and quality: held-out accuracy, the models' own arithmetic, edge rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import queries, rule_quality, toxicity

CORPUS = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{CORPUS}/labels.parquet")


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{CORPUS}/documents.parquet")


@pytest.fixture(scope="module")
def toxic_model(corpus, labels):
    return toxicity.fit(corpus, labels)


def accuracy(found, labels, label: str) -> float:
    joined = found.filter("held_out").join(labels, "doc_id").collect()
    assert len(joined) > 50
    return sum(r["predicted"] == r[label] for r in joined) / len(joined)


def test_toxicity_on_the_held_out_fold(spark, labels):
    found = queries.op4_toxicity(spark, CORPUS)
    assert accuracy(found, labels, "toxic") >= 0.9
    low, high = found.selectExpr("min(score)", "max(score)").first()
    assert 0 <= low <= high <= 1 and found.count() == 1_000


def test_quality_on_the_held_out_fold(spark, labels):
    found = queries.op10_rule_quality(spark, CORPUS)
    assert accuracy(found, labels, "quality") >= 0.95
    assert found.count() == 1_000


def test_held_out_labels_change_nothing(corpus, labels, toxic_model):
    turned = labels.selectExpr(
        "doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic",
    )
    other = toxicity.fit(corpus, turned)
    assert np.array_equal(other.gains, toxic_model.gains)
    assert np.allclose(other.beta, toxic_model.beta)


def plain_probability(known: dict, shared, history: str, character: str) -> float:
    """Kneser-Ney of the highest order, straight from its formula."""
    counts = {k[-1]: n for k, n in known.items() if k[:-1] == history}
    total = sum(counts.values())
    if not total:
        return shared(history, character)
    own = max(counts.get(character, 0) - toxicity.DISCOUNT, 0) / total
    return own + toxicity.DISCOUNT * len(counts) / total * shared(history, character)


def test_gains_follow_the_formula(spark):
    """A small corpus, every sequence counted with dictionaries."""
    rows = [(i, t) for i, t in enumerate(["loser lost low", "low owl", "lost loser", "owl slow"] * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic")
    model = toxicity.fit(docs, labels)
    import zlib

    order = toxicity.ORDER
    counts, every = {0: {}, 1: {}}, set()
    for doc_id, text in rows:
        fold = zlib.crc32(str(doc_id).encode()) % 5
        for word in text.split():
            padded = "^" * (order - 1) + word + "$"
            for at in range(order - 1, len(padded)):
                gram = padded[at - order + 1 : at + 1]
                every.add(gram)
                if fold not in (toxicity.HELD_OUT, toxicity.CALIBRATION):
                    known = counts[int(doc_id % 2 == 0)]
                    known[gram] = known.get(gram, 0) + 1

    levels = {order: every}
    for length in range(order - 1, 0, -1):
        levels[length] = {g[1:] for g in levels[length + 1]}

    def shared(history: str, character: str, length: int = order - 1) -> float:
        if length == 0:
            return 1 / 256
        lower = shared(history, character, length - 1)
        end = history[len(history) - length + 1 :] if length > 1 else ""
        follow: dict[str, int] = {}
        for gram in levels[length + 1]:
            if gram[1:-1] == end:
                follow[gram[-1]] = follow.get(gram[-1], 0) + 1
        if character not in follow:
            return lower
        kinds, total = len(follow), sum(follow.values())
        own = max(follow[character] - toxicity.DISCOUNT, 0)
        return (own + toxicity.DISCOUNT * kinds * lower) / total

    for word in ("loser", "owl", "slow"):
        padded = "^" * (order - 1) + word + "$"
        want = sum(
            math.log(plain_probability(counts[1], shared, padded[at - order + 1 : at], padded[at]))
            - math.log(plain_probability(counts[0], shared, padded[at - order + 1 : at], padded[at]))
            for at in range(order - 1, len(padded))
        )
        assert model.of_words([word])[0] == pytest.approx(want)


def test_scores_of_edge_rows(edge_docs, edge_rows, no_docs, toxic_model):
    found = toxicity.score(edge_docs, toxic_model)
    assert found.columns == [c for c in edge_docs.columns if c != "score"] + ["score"]
    scores = {r.n: r.score for r in found.collect()}
    assert len(scores) == len(edge_rows) and all(0 <= s <= 1 for s in scores.values())
    assert scores[4] == scores[5] == scores[6] == scores[10]  # no words
    assert toxicity.score(no_docs, toxic_model).count() == 0
    kept = toxicity.below(edge_docs, toxic_model, 2.0)
    assert kept.columns == edge_docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(
        repr(r) for r in edge_rows
    )


def test_models_without_labels(spark, corpus, labels, no_docs, edge_docs):
    nothing = labels.filter("false")
    model = toxicity.fit(no_docs, nothing)
    assert {r.score for r in toxicity.score(edge_docs, model).collect()} == {0.5}
    ensemble = rule_quality.fit(no_docs, nothing)
    assert {r.score for r in rule_quality.score(edge_docs, ensemble).collect()} == {0.5}
    one_class = labels.selectExpr("doc_id", "1 as quality")
    only = rule_quality.fit(corpus, one_class)
    assert only.rules == {}


def test_rules_compile_to_what_numpy_computes(spark, corpus, labels, edge_docs, edge_rows):
    ensemble = rule_quality.fit(corpus, labels)
    assert 0 < len(ensemble.rules) < 200
    scored = rule_quality.score(edge_docs, ensemble)
    stats = rule_quality.with_statistics(edge_docs).select("n", "_stats.*")
    rows = scored.select("n", "score").join(stats, "n").collect()
    assert len(rows) == len(edge_rows)
    x = np.array([[r[name] for name in rule_quality.NAMES] for r in rows])
    want = 1 / (1 + np.exp(-ensemble.margin(x)))
    assert np.allclose([r.score for r in rows], want)


def test_scoring_quality_needs_no_python(corpus, labels):
    ensemble = rule_quality.fit(corpus, labels)
    plan = rule_quality.score(corpus, ensemble)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labels_that_contradict_count_as_the_larger(corpus, labels):
    doubled = labels.unionByName(labels.withColumns({"quality": F.lit(0), "toxic": F.lit(0)}))
    one, other = rule_quality.fit(corpus, labels), rule_quality.fit(corpus, doubled)
    assert one.rules == other.rules
