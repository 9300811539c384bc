"""Centroid clustering, WARC archives and phrase collocations."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import clustering, phrases, warc
from recordloom.llm.queries import ORACLE, QUERIES
from recordloom.session import new_folder
from tests.compare import check, connect

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster int, whole string, turned int, _vector int"


@pytest.mark.parametrize(
    "name", ["op11_centroid_clustering", "op12_warc_histories", "op13_phrase_collocations"]
)
def test_queries_agree_with_sql(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name])


def vector_rows(rows):
    return [(number, value, 0, 1, "w", 2, 3) for number, value in rows]


def brute_clusters(rows, k=16, rounds=3):
    """vec_id, whole, cluster, distance by every distance to every centroid."""
    kept = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), w) for i, w in kept)
    centroids = [w for _, w in start[:k]]

    def near(w):
        return min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        found = [near(w)[1] for _, w in kept]
        moved = []
        for n, c in enumerate(centroids):
            own = [w for (_, w), m in zip(kept, found, strict=True) if m == n]
            moved.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else c)
        centroids = moved
    return [(i, near(w)[1], near(w)[0]) for i, w in kept], centroids


def test_clusters_of_edge_rows(spark):
    rng = random.Random(3)
    hot = [float(np.float32(rng.uniform(-1, 1))) for _ in range(64)]
    rows = [(i, hot) for i in range(30)]  # a third of all vectors is one
    rows += [(100 + i, [float(np.float32(rng.gauss(0, 1))) for _ in range(64)]) for i in range(60)]
    rows += [(100, rows[35][1]), (100, rows[35][1]), (None, rows[40][1])]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63)]
    rows += [(205, [math.nan] + [1.0] * 63), (206, [math.inf] + [1.0] * 63), (207, [0.0] * 64)]
    df = spark.createDataFrame(vector_rows(rows), VECTORS).repartition(3)
    found = clustering.report(clustering.fit(df)).collect()
    want, centroids = brute_clusters(rows)
    assert sorted(map(repr, ((r.vec_id, r.cluster, r.distance) for r in found))) == sorted(map(repr, want))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = Counter()
    for _, cluster, distance in want:
        sums[cluster] += distance
    for row in found:
        assert row.centroid_sha256 == digests[row.cluster]
        assert (row.cluster_inertia, row.inertia) == (sums[row.cluster], sum(sums.values()))


def test_few_no_and_huge_vectors(spark):
    few = vector_rows([(1, [0.5] * 64), (2, [3e38] * 64)])
    found = clustering.report(clustering.fit(spark.createDataFrame(few, VECTORS))).collect()
    assert sorted((r.vec_id, r.distance) for r in found) == [(1, 0), (2, 0)]
    none = clustering.report(clustering.fit(spark.createDataFrame([], VECTORS)))
    assert none.count() == 0 and "centroid_sha256" in none.columns


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.booleans())
def test_survivors_hold_the_nearest_centroid(seed, k, coarse):
    rng = np.random.default_rng(seed)
    whole = rng.integers(-3, 3, (50, 8)) * (1 if coarse else 100_000)
    centroids = whole[rng.integers(0, 50, k)]
    axes, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    rotation = clustering.Rotation(whole.mean(axis=0), axes, 3)
    cluster, distance, compared = clustering.nearest(whole, rotation.apply(whole.astype(float)).astype(np.float32).astype(float), centroids, rotation)
    every = ((whole[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all()
    assert (distance == every.min(axis=1)).all()
    assert len(whole) <= compared <= len(whole) * k


def test_the_filter_spares_distances(spark, sf_dir):
    clusters = clustering.fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    compared = clustering.assign(clusters).agg({"compared": "sum"}).first()[0]
    assert compared < 0.5 * clusters.vectors.count() * len(clusters.centroids)


PAGES = "page_id bigint, url string, html string, payload string, captured bigint, archive int, _sha int, low int"


def page_rows():
    long = "<p>" + "wörd " * 60_000
    rows = [
        (5, "http://b.example.com/x?q=1#f", "<p>one</p>"),
        (3, "http://a.example.com/x", "<p>one</p>"),
        (3, "http://a.example.com/x", "<p>one</p>"),
        (4, "HTTP://A.Example.com/y", None),
        (6, None, ""),
        (None, "http://a.example.com/z", ""),
        (None, "not a url \r\nX: y", "alone"),
        (7, "", long),
        (8, "http://c.example.org", long),
        (9, "http://a.example.com/x", "été \U0001f600"),
    ]
    return [(*r, "p", 1, 2, 3, 4) for r in rows]


def brute_captures(rows):
    groups = {}
    for page, _, html, *_ in rows:
        groups.setdefault(html or "", []).append(page)
    found = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        first = min((x for x in groups[html or ""] if x is not None), default=None)
        again = page != first
        kind = "revisit" if again and first is not None else "response"
        found.append((page, len(data), warc.digest_of(data), kind, first if kind == "revisit" else None))
    return sorted(map(repr, found))


def test_archives_of_edge_rows(spark):
    df = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    found = warc.archived(df)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    rows = found.select(*columns, "index_place").collect()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == brute_captures(page_rows())
    assert sorted(r.index_place for r in rows) == list(range(1, len(rows) + 1))
    assert warc.archived(df.limit(0)).count() == 0


def test_a_hot_url_is_cut_by_time_and_runs_merge_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(1000):
        url = "http://hot.example.com/" if i % 3 else f"http://h{rng.randrange(9)}.example.com/{rng.randrange(50)}"
        rows.append((i, url, f"<p>{rng.randrange(400)}</p>", "p", rng.randrange(100), 2, 3, 4))
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    folder = new_folder(spark, "warc")
    runs = warc.write_archives(df, folder, df.captured, run=100)
    assert runs.select("run").distinct().count() >= 8
    index = warc.histories(runs, fan_in=4, part=2).orderBy("index_place").collect()
    assert [r.index_place for r in index] == list(range(1, 1001))
    order = [(r.url_key, r.captured, r.page_id) for r in index]
    assert order == sorted(order)
    urls = {r[0]: r[1] for r in rows}
    assert sorted(r.page_id for r in index) == list(range(1000))
    assert all(r.url_key.startswith("com,example,") and (r.url_key == "com,example,hot)/") == ("hot" in urls[r.page_id]) for r in index)
    # A round merges by parts of bounded size.
    merged = warc.merge_runs(runs, fan_in=4, part=2)
    parts = merged.selectExpr("block >> 32 as part", "size(entries) as n").groupBy("part").sum("n").collect()
    assert len(parts) > 3 and max(r[1] for r in parts) <= 2 * 2 * warc.BLOCK * 2


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), max_size=9))
def test_loser_tree(streams):
    rows = [
        sorted(({"url_key": str(x), "captured": 0, "page_id": i, "archive": "", "place": j} for j, x in enumerate(s)), key=warc._order)
        for i, s in enumerate(streams)
    ]
    if rows:
        found = list(warc.LoserTree([iter(r) for r in rows]))
        assert list(map(warc._order, found)) == sorted(warc._order(x) for r in rows for x in r)


def test_records_are_gzip_members_with_checked_payloads():
    data = warc.capture_record(7, "http://a/ b", 1_577_836_800, "<p>é</p>".encode(), None)
    text = zlib.decompress(data, 31).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("</p>\r\n\r\n")
    assert "WARC-Date: 2020-01-01T00:00:00Z\r\n" in text and "WARC-Target-URI: http://a/%20b\r\n" in text
    assert warc.read_record(data)["html"] == "<p>é</p>".encode()
    again = warc.read_record(warc.capture_record(9, None, -10**15, b"abc", 7))
    assert (again["record_type"], again["refers_to"], again["payload_bytes"]) == ("revisit", 7, 3)
    with pytest.raises(Exception):
        warc.read_record(data[:-9])
    broken = zlib.compressobj(6, zlib.DEFLATED, 31)
    body = zlib.decompress(data, 31).replace(b"<p>", b"<q>")
    with pytest.raises(ValueError):
        warc.read_record(broken.compress(body) + broken.flush())


def brute_phrases(rows, support, inside=50, top=2000):
    counts, totals = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for at in range(len(words) - k + 1):
                    counts[lang, tuple(words[at : at + k])] += 1
    scored = {}
    for (lang, phrase), a in counts.items():
        if len(phrase) > 1 and a >= support:
            cuts = []
            for k in range(1, len(phrase)):
                left, right = counts[lang, phrase[:k]], counts[lang, phrase[k:]]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            scored[lang, phrase] = (a, *min(cuts))
    found = []
    for lang in totals:
        kept = []
        for (other, phrase), (a, score, _, left, right) in scored.items():
            if other != lang:
                continue
            longer = [
                v[0] for (o, p), v in scored.items()
                if o == lang and len(p) > len(phrase) and phrase in (p[:2], p[1:])
            ]
            if not any(100 * x >= inside * a for x in longer):
                kept.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def found_phrases(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_phrases_of_edge_rows(spark, edge_docs, edge_rows, no_docs):
    rows = [(r[2], r[1]) for r in edge_rows]
    assert found_phrases(phrases.collocations(edge_docs, support=2)) == brute_phrases(rows, 2)
    assert phrases.collocations(no_docs).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_phrases_over_shards_ranges_and_borders(spark, monkeypatch, small):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "gamma.", "d\tE", "ünï", "x,y", "z\n", "\x00", "\x1c", "a b", "10", "%"]
    rows = [
        (rng.choice(["en", "en", "de", None, ""]), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))))
        for _ in range(400)
    ]
    rows += [("en", "hot pair here")] * 200
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, shard int, need int").repartition(7)
    if small:  # a few words at once, in one process as the workers would
        monkeypatch.setattr(phrases, "AT_ONCE", 7)
        monkeypatch.setattr(phrases, "SLICE_BYTES", 11)
        text = " ".join(x or "" for _, x in rows).encode()
        counted = Counter()
        record = pa.RecordBatch.from_pydict(
            {"lang": ["en"], "shard": pa.array([0], pa.int32()), "need": [1], "text": pa.array([text], pa.binary())}
        )
        for _, found in phrases._counted([record]):
            for numbers, times in found.phrases:
                for row, n in zip(numbers, times, strict=True):
                    counted[tuple(found.vocabulary[i] for i in row)] += int(n)
        want = Counter()
        words = [w for x in phrases.words_and_breaks(text) for w in x]
        for k in (1, 2, 3):
            for at in range(len(words) - k + 1):
                if phrases.BREAK not in words[at : at + k]:
                    want[tuple(words[at : at + k])] += 1
        assert counted == want
        return
    assert found_phrases(phrases.collocations(df)) == brute_phrases(rows, 10)
    one = phrases.frequent_phrases(df).collect()
    many = phrases.frequent_phrases(df, most_bits=256).collect()  # several ranges of hashes
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_every_frequent_phrase_is_frequent_in_a_shard(spark, documents):
    rows, needs = phrases._prepared(documents.repartition(9), "lang", "text", 10)
    shares = needs.groupBy("lang").agg({"need": "sum", "_shard": "count"}).collect()
    assert all(r["sum(need)"] <= 10 + r["count(_shard)"] for r in shares)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**14 + 7, 10**14 + 9, 2 * 10**14 + 1)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    a, left, right = rows[0]
    assert df.select(phrases.cut_score("a", "l", "r")).first()[0] == 10**6 * a * a // (left * right)
