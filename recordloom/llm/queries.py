"""The registered queries of this subpackage and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, clustering, exact_dedup, licenses, merkle, mixing, near_dedup, page_diff
from recordloom.llm import phrases, records, rule_quality, toxicity, warc
from recordloom.llm.shared import fold, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


ORACLE["op3_exact_dedup"] = """
WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
groups AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size
  FROM hashed GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM hashed JOIN groups USING (text_sha256)
"""


def rank_file() -> bytes:
    """The ranks of the byte-level vocabulary, read where the job is started."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)


END_ID = 1


@query
def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    return records.record_digests(read(spark, sf_dir, "documents"), vocabulary, END_ID)


@query
def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(read(spark, sf_dir, "documents"))


#: The production mixture: a third of the crawl, languages and sources by weight.
MIXTURE = {
    "domain": {"crawl": 3, "curated": 7},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
}
MIXTURE_SEED = 17
MIXTURE_EPOCHS = 2


def domain() -> Column:
    return F.when(F.col("source") == "src0", "crawl").otherwise("curated")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.epochs(
        read(spark, sf_dir, "documents"), domain(), MIXTURE, None, MIXTURE_EPOCHS, MIXTURE_SEED
    )
    return taken.select(
        "_row.doc_id",
        F.col("_domain").alias("domain"),
        F.col("_lang").alias("lang"),
        F.col("_source").alias("source"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_budget").alias("leaf_budget"),
        F.col("_epochs").alias("epochs"),
    )


def _share_out_sql(path: list[str], above: str) -> str:
    """One level of the tree as SQL; ``above`` has the budgets of the parents."""
    names, parent = ", ".join(path), ", ".join(path[:-1])
    part = f"PARTITION BY {parent} " if parent else ""
    weight = {
        "domain": "CASE domain WHEN 'crawl' THEN 3 WHEN 'curated' THEN 7 ELSE 1 END",
        "lang": "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END",
        "source": "1",
    }[path[-1]]
    joined = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
    level = path[-1]
    return f"""
{level}_nodes AS (
  SELECT {names}, sum(total * 2)::HUGEINT AS cap, {weight} AS weight, any_value(given) AS given
  FROM leaves {joined} GROUP BY {names}
), {level}_levels AS (
  SELECT *, coalesce(sum(cap) OVER ({part}ORDER BY cap::DOUBLE / weight, {level}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS used,
    (sum(weight) OVER ({part}ORDER BY cap::DOUBLE / weight, {level}
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS open
  FROM {level}_nodes
), {level}_marked AS (
  SELECT *, cap * open <= (given - used) * weight AS gives_all FROM {level}_levels
), {level}_rest AS (
  SELECT *, max(open) FILTER (NOT gives_all) OVER ({part}) AS rest_open,
    max(given - used) FILTER (NOT gives_all) OVER ({part}) AS rest
  FROM {level}_marked
), {level}_budgets AS (
  SELECT {names}, CASE WHEN gives_all THEN cap ELSE rest * weight // rest_open END AS given
  FROM {level}_rest
)"""


ORACLE["op5_mixing"] = f"""
WITH rows AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    1 + strlen(coalesce(text, '')) // 4 AS n_tokens, md5(coalesce(text, '')) AS digest
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS total FROM rows GROUP BY ALL
), root AS (SELECT sum(total)::HUGEINT AS given FROM leaves),
{_share_out_sql(["domain"], "root")},
{_share_out_sql(["domain", "lang"], "domain_budgets")},
{_share_out_sql(["domain", "lang", "source"], "lang_budgets")},
budgets AS (
  SELECT domain, lang, source, given::BIGINT AS leaf_budget, (given // total)::BIGINT AS whole,
    given % total AS rest
  FROM source_budgets JOIN leaves USING (domain, lang, source)
), ordered AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5(concat_ws(':', '17', whole::VARCHAR, doc_id::VARCHAR)), n_tokens, digest
    ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows JOIN budgets USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget,
  (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM ordered
"""


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op10_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = rule_quality.fit(docs, read(spark, sf_dir, "labels"))
    return rule_quality.score(docs, ensemble).select(
        "doc_id",
        (fold("doc_id", rule_quality.FOLDS) == rule_quality.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.main_text(read(spark, sf_dir, "pages"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """Containment of every template in every window, without any hashing."""

    def words(text: str) -> str:
        spaced = rf"regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
        return f"list_filter(string_split(trim({spaced}), ' '), lambda w: w <> '')"

    def shingles(of: str, width: str) -> str:
        return (
            f"list_distinct(list_transform(range(1, len({of}) - {width} + 2),"
            f" lambda i: array_to_string(list_slice({of}, i, i + {width} - 1), ' ')))"
        )

    values = ", ".join(f"('{name}', '{body}')" for name, body in licenses.TEMPLATES)
    return f"""
WITH templates AS (
  SELECT *, least(len(words), 5) AS width, CASE WHEN len(words) <= 8 THEN 8
    WHEN len(words) <= 32 THEN 32 ELSE 128 END AS length
  FROM (SELECT license, {words('body')} AS words FROM (VALUES {values}) AS t(license, body))
), parts AS (SELECT *, {shingles('words', 'width')} AS parts FROM templates),
texts AS (SELECT doc_id, {words("coalesce(text, '')")} AS words FROM documents),
starts AS (
  SELECT doc_id, length, width, words, unnest(range(0, greatest(len(words), 1), length)) AS start
  FROM texts CROSS JOIN (SELECT DISTINCT length, width FROM templates)
), windows AS (
  SELECT doc_id, length, width, start,
    list_slice(words, start + 1, start + 2 * length) AS words
  FROM starts WHERE start = 0 OR start + length < len(words)
), shared AS (
  SELECT doc_id, license, w.length, start,
    len(list_intersect({shingles('w.words', 'w.width')}, parts)) / len(parts) AS share
  FROM windows w JOIN parts p ON p.length = w.length AND p.width = w.width
)
SELECT doc_id, license, max(share) AS containment,
  count(DISTINCT (start, length)) AS windows, min(start)::BIGINT AS first_word
FROM shared WHERE share >= 0.75 GROUP BY doc_id, license
"""


ORACLE["op6_license_scan"] = _license_sql()


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(clustering.fit(read(spark, sf_dir, "embeddings")))


def _clustering_sql() -> str:
    """Every distance to every centroid, round after round."""
    steps = []
    for number in range(clustering.ROUNDS + 1):
        steps.append(f"""
assigned{number} AS MATERIALIZED (
  SELECT no, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (
    SELECT no, cluster, list_sum(list_transform(list_zip(whole, centroid),
      lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
    FROM kept CROSS JOIN centroids{number}
  ) GROUP BY no
)""")
        if number < clustering.ROUNDS:
            steps.append(f"""
centroids{number + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(moved, centroid) AS centroid
  FROM centroids{number} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS moved
    FROM (
      SELECT cluster, place, sum(whole[place])::BIGINT AS s, count(*) AS n
      FROM kept JOIN assigned{number} USING (no)
        CROSS JOIN (SELECT unnest(range(1, {clustering.DIMENSIONS + 1})) AS place)
      GROUP BY cluster, place
    ) GROUP BY cluster
  ) USING (cluster)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id,
    list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS whole
  FROM embeddings
  WHERE len(embedding) = {clustering.DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clustering.DIMENSIONS}
), centroids0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY hash, whole) - 1)::INTEGER AS cluster, whole AS centroid
  FROM (
    SELECT sha256('1:' || vec_id::VARCHAR) AS hash, whole FROM kept
    ORDER BY hash, whole LIMIT {clustering.CENTROIDS}
  )
),{",".join(steps)}
SELECT vec_id, cluster, distance,
  (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(centroid, ',')) AS centroid_sha256
FROM kept JOIN assigned{clustering.ROUNDS} USING (no) JOIN centroids{clustering.ROUNDS} USING (cluster)
"""


ORACLE["op11_centroid_clustering"] = _clustering_sql()

#: The table has no capture times: pages count as captured one second apart, in the
#: order of their ids.
FIRST_CAPTURE = 1_577_836_800  # 2020-01-01T00:00:00Z


@query
def op12_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = F.col("page_id") + F.lit(FIRST_CAPTURE)
    return warc.archived(read(spark, sf_dir, "pages"), captured).drop("html")


ORACLE["op12_warc_histories"] = f"""
WITH captures AS (
  SELECT page_id, coalesce(html, '') AS html,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest,
    url, {FIRST_CAPTURE} + page_id AS captured
  FROM pages
), keyed AS (
  SELECT *, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id,
    coalesce(CASE WHEN host = '' THEN url
      ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest END, '') AS url_key
  FROM captures
)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, i // 4 * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, captured, page_id) AS index_place
FROM keyed
"""


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


ORACLE["op13_phrase_collocations"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
), words AS MATERIALIZED (
  SELECT lang, unnest(w) AS w1, unnest(list_concat(w[2:], [NULL])) AS w2,
    unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS w3
  FROM split WHERE len(w) > 0
), counted AS MATERIALIZED (
  SELECT lang, 1 AS words, w1 AS phrase, count(*) AS f FROM words GROUP BY ALL
  UNION ALL
  SELECT lang, 2, w1 || ' ' || w2, count(*) FROM words WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM words WHERE w3 IS NOT NULL GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
candidates AS MATERIALIZED (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w
  FROM counted WHERE words > 1 AND f >= {phrases.SUPPORT}
), cuts AS (
  SELECT lang, words, phrase, a, unnest(range(1, words)) AS k, w FROM candidates
), scored AS (
  SELECT c.lang, c.words, c.phrase, a, k, l.f AS l, r.f AS r,
    (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c
    JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ') AND l.words = k
    JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ') AND r.words = c.words - k
), best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, words, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase, a
  FROM candidates WHERE words = 3
), inside AS (SELECT lang, phrase, max(a) AS a FROM longer GROUP BY ALL), open AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON b.words = 2 AND i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.a IS NULL OR 100 * i.a < {phrases.INSIDE} * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM open
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
WHERE rank <= {phrases.TOP}
"""
