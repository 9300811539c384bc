"""Exact and near duplicates, fingerprints and mixing."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import exact_dedup, hyperminhash, merkle, mixing, near_dedup, queries
from recordloom.llm.queries import ORACLE, QUERIES
from tests.compare import connect


def rows_of(df) -> list:
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def agrees_with_sql(spark, sf_dir, name):
    con = connect(sf_dir)
    df = QUERIES[name](spark, sf_dir)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = con.execute(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall()
    assert rows_of(df) == sorted(map(repr, want))


def test_exact_query(spark, sf_dir):
    agrees_with_sql(spark, sf_dir, "op3_exact_dedup")


def test_exact_groups_of_edge_rows(edge_docs, edge_rows, no_docs):
    groups = defaultdict(list)
    for row in edge_rows:
        groups[row[1] or ""].append(row[0])
    want = []
    for row in edge_rows:
        ids = groups[row[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256((row[1] or "").encode()).hexdigest()
        want.append(repr((row[0], len(ids), keep, row[0] == keep, sha)))
    found = exact_dedup.exact_groups(edge_docs)
    found = found.select("doc_id", "group_size", "keep_id", "kept", "text_sha256").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(want)
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_repeats(no_docs).columns == no_docs.columns


def test_dropping_repeats_keeps_rows_whole(edge_docs, edge_rows):
    best = {}
    for row in edge_rows:
        key = row[1] or ""
        best[key] = max(best.get(key, -1), -1 if row[0] is None else row[0])
    want = [r for r in edge_rows if (-1 if r[0] is None else r[0]) == best[r[1] or ""]]
    found = exact_dedup.drop_repeats(edge_docs)
    assert found.columns == edge_docs.columns
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_a_saturated_filter_changes_nothing(spark):
    docs = spark.range(3_000).selectExpr("id as doc_id", "cast(id % 1000 as string) as text")
    marked = exact_dedup.mark_possible(docs, max_buckets=1)
    assert marked.filter("_possible").count() == 3_000
    alone = spark.range(3_000).selectExpr("id as doc_id", "cast(id as string) as text")
    assert exact_dedup.mark_possible(alone).filter("_possible").count() < 150
    assert exact_dedup.drop_repeats(docs).count() == 1_000


def shingle_set(text: str) -> frozenset:
    found = hyperminhash.words(text)
    width = min(5, len(found))
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1) if width)


def brute_components(texts: dict[int, str]) -> dict[int, int]:
    sets = {i: shingle_set(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for at, a in enumerate(ids):
        for b in ids[:at]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: root(i) for i in sets}


def test_near_query_against_all_pairs(spark, sf_dir, texts):
    want = brute_components(texts)
    for row in queries.op8_near_dedup(spark, sf_dir).collect():
        assert row.n_shingles == len(shingle_set(texts[row.doc_id]))
        assert row.component_id == want[row.doc_id]
        assert row.kept == (row.doc_id == row.component_id)


def test_near_groups_with_a_hot_family(spark):
    """Many near copies at all distances, over block bounds, beside unrelated texts."""
    random.seed(3)
    base = [f"w{random.randrange(900)}" for _ in range(60)]
    texts = {}
    for i in range(420):
        words = list(base)
        for _ in range(random.randrange(5)):
            words[random.randrange(len(words))] = f"v{random.randrange(10_000)}"
        texts[i] = " ".join(words)
    for i in range(420, 470):
        texts[i] = " ".join(f"u{random.randrange(10_000)}" for _ in range(random.randrange(1, 40)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    block, near_dedup.BLOCK = near_dedup.BLOCK, 64
    try:
        found = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    finally:
        near_dedup.BLOCK = block
    assert found == brute_components(texts)


def short_pairs(count: int, seed: int, longest: int = 45):
    """Pairs of short texts whose shingle sets have a similarity of 0.75 at least,
    most of them close to it, without a word in common with another pair."""
    draw = random.Random(seed)
    while count:
        words = [f"w{draw.getrandbits(48)}" for _ in range(draw.randrange(8, longest + 1))]
        cut = draw.randrange(1, 12)
        other = words[:-cut] if draw.random() < 0.5 else words[cut:]
        other = [*other, *(f"v{draw.getrandbits(48)}" for _ in range(draw.randrange(3)))]
        one, two = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        if one != two and 4 * len(one & two) >= 3 * len(one | two):
            count -= 1
            yield " ".join(words), " ".join(other)


def test_short_near_pairs_always_share_a_prefix_key_and_pass_the_estimate():
    hasher = hyperminhash.Hasher()
    nothing = np.empty(0, np.uint64), np.empty(0, np.int64)
    for one, other in short_pairs(8_000, 5):
        a, b = hasher.shingles(one), hasher.shingles(other)
        common = np.unique(np.concatenate([a[::2], b[:3]]))
        for order in (nothing, (common, np.arange(len(common)) % 5)):
            keys = [hyperminhash.prefix_keys(s, *order, 0.75) for s in (a, b)]
            assert len(np.intersect1d(*keys))
        sizes = np.array([len(a)]), np.array([len(b)])
        sketches = hyperminhash.sketch(a)[None], hyperminhash.sketch(b)[None]
        assert hyperminhash.may_reach(*sketches, *sizes, 0.75)[0]


def test_no_link_of_short_texts_is_lost(spark):
    texts = dict(enumerate(t for pair in short_pairs(4_000, 6, 9) for t in pair))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    assert found == {i: i - i % 2 for i in texts}


def test_short_texts_around_common_phrases(spark):
    """Prefixes of common shingles, families at all distances, sizes around the bound."""
    draw = random.Random(8)
    phrase = "all rights reserved by the owner of this page see the terms of use".split()
    texts = {}
    for i in range(900):
        family = random.Random(i % 90)
        words = [f"w{family.randrange(500)}" for _ in range(family.randrange(1, 50))] + phrase
        for _ in range(draw.randrange(3)):
            words[draw.randrange(len(words))] = f"v{draw.randrange(9_999)}"
        texts[i] = " ".join(words[draw.randrange(3) :])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8)
    block, near_dedup.BLOCK = near_dedup.BLOCK, 64
    try:
        found = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    finally:
        near_dedup.BLOCK = block
    assert found == brute_components(texts)


def test_near_groups_of_edge_rows(edge_docs, edge_rows, no_docs):
    found = near_dedup.near_groups(edge_docs).collect()
    assert len(found) == len(edge_rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[3].component_id == by_id[2].component_id == by_id[1].component_id == 1
    assert by_id[7].component_id == 6
    assert [by_id[i].component_id for i in (4, 5, 8, 9, 10)] == [4, 5, 8, 9, 10]
    assert by_id[4].n_shingles == by_id[5].n_shingles == by_id[8].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    kept = near_dedup.drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 8, 9, 10, 11, None}
    assert near_dedup.near_groups(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in found} == {
        **dict.fromkeys(range(41), 0),
        **dict.fromkeys(range(100, 130), 100),
    }


def test_estimates_are_close():
    random_ = np.random.default_rng(1)
    for similarity in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(40):
            shared = int(2_000 * similarity)
            hashes = random_.integers(0, 2**63, 2_000 + (2_000 - shared), np.uint64) * np.uint64(2)
            a, b = hashes[:2_000 - (2_000 - shared) // 2], hashes[(2_000 - shared) // 2 :]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            left, right = hyperminhash.sketch(a)[None], hyperminhash.sketch(b)[None]
            found, _ = hyperminhash.estimates(left, right, np.array([len(a)]), np.array([len(b)]))
            errors.append(found[0] - true)
            assert hyperminhash.may_reach(
                left, right, np.array([len(a)]), np.array([len(b)]), true
            )[0]
        assert abs(np.mean(errors)) < 0.03


TEXT = st.text(alphabet="ab c.\né", max_size=80)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_roots_are_equal_only_for_equal_texts(one, other):
    a, b = merkle.fingerprint(one), merkle.fingerprint(other)
    assert (a == b) == (one == other)
    assert merkle.likeness(a, a) == 1 and merkle.likeness(a, b) == merkle.likeness(b, a)
    assert 0 <= merkle.likeness(a, b) <= 1


def test_an_edit_is_located():
    words = [f"word{i}" for i in range(400)]
    lines = [" ".join(words[i : i + 40]) for i in range(0, 400, 40)]
    one = "\n".join(lines)
    other = one.replace("word217 ", "changed ")
    a, b = merkle.fingerprint(one), merkle.fingerprint(other)
    spans = merkle.changed_spans(a, b)
    place = one.index("word217 ")
    assert len(spans) == 1 and spans[0][0] <= place < spans[0][1]
    assert spans[0][1] - spans[0][0] < 200
    assert merkle.changed_spans(a, a) == []
    assert merkle.likeness(a, b) > 0.9


def test_text_without_spaces_has_passages():
    draw = random.Random(4)
    for alphabet in ("".join(map(chr, range(0x4E00, 0x5200))), "abcdefghijklmnopqrstuvwxyz0123456789+/"):
        for before in ("", "some words in front of it "):
            text = before + "".join(draw.choices(alphabet, k=3_000))
            new = "".join(draw.choices(alphabet, k=1_000))
            other = merkle.edited(text, new)
            one, two = merkle.fingerprint(text), merkle.fingerprint(other)
            assert 0.62 < merkle.likeness(one, two) < 0.68
            assert "".join(merkle.passages(text)) == text
            (span,) = merkle.changed_spans(one, two)
            assert len(text) * 2 / 3 - 130 < span[0] <= len(text) * 2 / 3 and span[1] == len(text)
            # An insertion near the start moves no cut beyond its surroundings.
            moved = merkle.fingerprint(text[:100] + "x" + text[100:])
            assert merkle.likeness(one, moved) > 0.9
    same = "x" * 1_000
    assert "".join(merkle.passages(same)) == same
    assert max(map(len, merkle.passages(same))) <= merkle.MOST_CHARS


def test_fingerprint_query_against_brute_force(spark, sf_dir, texts):
    order = sorted(texts, reverse=True)
    found = {r.doc_id: r for r in queries.op7_merkle_fingerprints(spark, sf_dir).collect()}
    assert len(found) == len(texts)
    for at, doc_id in enumerate(order):
        text, following = texts[doc_id], texts[order[(at + 1) % len(order)]]
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        row = found[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert row.fingerprint == merkle.fingerprint(text)
        assert row.edited_fingerprint == merkle.fingerprint(new)
        assert row.near_edited == merkle.likeness(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == merkle.likeness(row.fingerprint, merkle.fingerprint(following))


def test_fingerprints_of_edge_rows(spark, edge_docs, edge_rows, no_docs):
    found = merkle.compare_with_next(edge_docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(row[0] for row in edge_rows)
    assert merkle.compare_with_next(no_docs).count() == 0
    alone = spark.createDataFrame([(5, "a b c")], "doc_id bigint, text string")
    (row,) = merkle.compare_with_next(alone).collect()
    assert row.near_next == 1.0 and row.n_chars == 5
    marked = merkle.fingerprints(edge_docs, name="mark").select("n", "mark").collect()
    assert {r.n: r.mark for r in marked} == {
        r[11]: merkle.fingerprint(r[1] or "") for r in edge_rows
    }


def test_mixing_query(spark, sf_dir):
    agrees_with_sql(spark, sf_dir, "op5_mixing")


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "1", 10), ("a", "x", "2", 1_000), ("a", "y", "3", 50), ("b", "x", "4", 5_000)],
        "_domain string, _lang string, _source string, _total bigint",
    )
    even = mixing.leaf_budgets(leaves, {}, 1_000, 1).collect()
    assert {r._source: r._budget for r in even} == {"1": 10, "2": 440, "3": 50, "4": 500}
    # Where a whole domain is exhausted, the other one takes over.
    more = mixing.leaf_budgets(leaves, {}, 4_000, 1).collect()
    assert {r._source: r._budget for r in more} == {"1": 10, "2": 1_000, "3": 50, "4": 2_940}
    none = mixing.leaf_budgets(leaves, {"domain": {"a": 0}}, 1_000, 1).collect()
    assert {r._source: r._budget for r in none} == {"4": 1_000}


def test_what_a_weight_of_zero_leaves_out_counts_nowhere(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "1", 900), ("a", "y", "2", 100), ("b", "y", "3", 1_000)],
        "_domain string, _lang string, _source string, _total bigint",
    )
    for weights in ({"lang": {"x": 0}}, {"source": {"1": 0}}):
        found = mixing.leaf_budgets(leaves, weights, 1_000, 1).collect()
        assert {r._source: r._budget for r in found} == {"2": 100, "3": 900}


def test_mixture_of_edge_rows(edge_docs, edge_rows, no_docs):
    taken = mixing.epochs(edge_docs, queries.domain(), queries.MIXTURE, None, 2, 1)
    rows = taken.collect()
    assert len(rows) == len(edge_rows)
    for leaf in {(r._domain, r._lang, r._source) for r in rows}:
        own = [r for r in rows if (r._domain, r._lang, r._source) == leaf]
        assert sum(r._epochs * r._tokens for r in own) <= own[0]._budget
        assert max(r._epochs for r in own) - min(r._epochs for r in own) <= 1
    mixed = mixing.mixture(taken)
    assert mixed.columns == edge_docs.columns
    assert mixed.count() == sum(r._epochs for r in rows)
    nothing = mixing.epochs(no_docs, queries.domain(), queries.MIXTURE)
    assert nothing.count() == 0 and mixing.mixture(nothing).count() == 0


def test_dropping_near_copies_moves_no_text(spark, documents):
    """Not by the size of the stored ids: a larger table of them moved all texts."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        left = near_dedup.drop_near_copies(documents)
        plan = left._jdf.queryExecution().executedPlan().toString()
        found = sorted(r.doc_id for r in left.collect())
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    kept = near_dedup.near_groups(documents).filter("kept")
    assert found == sorted(r.doc_id for r in kept.collect())


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    rows = [(i, band) for band, size in ((7, 50), (8, 2), (9, 1)) for i in range(size)]
    bands = spark.createDataFrame(rows, "_id bigint, band bigint")
    want = sorted((i, band, {7: 50, 8: 2}[band]) for i, band in rows if band != 9)
    for hot in (1, 10, 1_000):
        monkeypatch.setattr(near_dedup, "HOT", hot)
        members = near_dedup._bucket_members(bands)
        assert sorted(map(tuple, members.collect())) == want
        buckets = members.groupBy("band", "size").count().withColumnRenamed("count", "rows")
        joined = near_dedup._bucket_join(members, buckets).select("_id", "band", "rows")
        assert sorted(map(tuple, joined.collect())) == want
