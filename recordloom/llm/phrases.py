"""Phrase collocations by SON partitioning.

1. Documents are dealt into SHARDS shards by task. Each shard is mined completely:
   tasks count all phrases of one to three words, blocks of phrase hashes meet by
   bucket, and a phrase is locally frequent where its count in the shard reaches the
   support lowered by the shard's share of the language. A phrase that is frequent
   overall is so in at least one shard, whatever the shares are.
2. The union of locally frequent phrases goes out as a bitmap of hashes. A second scan
   counts every phrase the bitmap holds globally, by its text, so a hash that
   collides costs a row and changes no count. Beyond MOST_BITS the hash space is
   scanned in several ranges, each with a bitmap of its own.
3. Cuts, scores and the phrases inside longer ones are joins of the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.joins import lookup_join
from recordloom.llm.hyperminhash import MULTIPLIER, mixed
from recordloom.llm.shared import column, small_batches, whole_text
from recordloom.session import materialise

SUPPORT = 10
LONGEST = 3  # words of a phrase
INSIDE = 50  # hundredths of a phrase's count from which a longer one replaces it
TOP = 2000
NO_LANG = "und"
SHARDS = 4
AT_ONCE = 1 << 20  # words of a language counted at once; three of their numbers fit 63 bits
HELD = 2 << 20  # words of all languages a worker holds
SLICE_BYTES = 4 << 20  # bytes of a text that are cut into words at once
BUCKET_BYTES = 8 << 20  # bytes of text for each bucket of hashes
MOST_BITS = 1 << 28  # of a bitmap (32 MB)
BITS_A_KEY = 16

#: A-Z to a-z, ends of pieces to a line feed, tabs to spaces.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c
    for c in range(256)
)
BREAK = b"\n"  # stands between pieces; no word holds one


def words_and_breaks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with a BREAK between pieces, in lists of bounded length."""
    data = text.translate(TABLE)
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):
            near = max(data.rfind(b" ", at, end), data.rfind(BREAK, at, end))
            if near < at:  # one word beyond the slice: up to its end
                ends = [x for x in (data.find(b" ", end), data.find(BREAK, end)) if x >= 0]
                near = min(ends, default=len(data) - 1)
            end = near + 1
        yield [w for w in data[at:end].replace(BREAK, b" \n ").split(b" ") if w]
        at = end


@dataclass
class Grams:
    """Distinct phrases of some words: their words' numbers, and their counts."""

    vocabulary: list[bytes]
    phrases: list[tuple[np.ndarray, np.ndarray]]  # by length: (m, k) numbers, m counts
    words: int


def grams(words: list[bytes], starts: int) -> Grams:
    """The phrases that start at one of the first ``starts`` places."""
    vocabulary = [BREAK, *(set(words) - {BREAK})]
    number = {w: i for i, w in enumerate(vocabulary)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    bits = max(1, (len(vocabulary) - 1).bit_length())
    if bits * LONGEST > 63:
        raise ValueError("too many different words at once")
    found, key, whole = [], ids, ids > 0
    for length in range(1, LONGEST + 1):
        if length > 1:
            size = max(0, len(ids) - length + 1)
            whole = whole[:size] & (ids[length - 1 :] > 0)
            key = (key[:size] << bits) | ids[length - 1 :]
        distinct, counts = np.unique(key[:starts][whole[:starts]], return_counts=True)
        shifts = [bits * (length - 1 - k) for k in range(length)]
        parts = [(distinct >> s) & ((1 << bits) - 1) for s in shifts]
        found.append((np.column_stack(parts), counts))
    return Grams(vocabulary, found, int((ids[:starts] > 0).sum()))


def keys_of(grams_: Grams, lang: str) -> list[np.ndarray]:
    """A 64-bit hash for every distinct phrase of a language, by length."""
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in grams_.vocabulary], np.uint64)
    found = []
    for numbers, _ in grams_.phrases:
        total = np.full(len(numbers), seed ^ numbers.shape[1], np.uint64)
        for place in range(numbers.shape[1]):
            total = mixed((total + hashes[numbers[:, place]]) * MULTIPLIER)
        found.append(total)
    return found


Group = tuple[str, int, int]  # language, shard, local support


def _counted(batches) -> Iterator[tuple[Group, Grams]]:
    """Grams of the rows (lang, shard, need, text), AT_ONCE words of one group at a
    time. Phrases never reach over a document, and those that reach over the end of
    what is counted at once are counted with the words that follow."""
    held: dict[Group, list[bytes]] = {}
    total = 0

    def flushed(name, every: bool):
        words = held[name]
        while len(words) > AT_ONCE + LONGEST:
            yield name, grams(words[: AT_ONCE + LONGEST - 1], AT_ONCE)
            words = words[AT_ONCE:]
        if every and words:
            yield name, grams(words, len(words))
            words = []
        held[name] = words

    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "need")), strict=True)
        for name, text in zip(names, batch.column("text"), strict=True):
            held.setdefault(name, [])
            for some in words_and_breaks(text.as_py()):
                before = len(held[name])
                held[name].extend(some)
                if len(held[name]) > AT_ONCE + LONGEST:
                    yield from flushed(name, False)
                total += len(held[name]) - before
            held[name].append(BREAK)
            total += 1
            if total > HELD:
                for each in list(held):
                    yield from flushed(each, True)
                held, total = {}, 0
    for each in list(held):
        yield from flushed(each, True)


def _miner(bits: int):
    """Blocks (bucket, lang, shard, need, keys, counts) of sorted phrase hashes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for (lang, shard, need), found in _counted(batches):
            keys = np.concatenate(keys_of(found, lang))
            counts = np.concatenate([c for _, c in found.phrases]).astype(np.uint32)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            edges = np.searchsorted(buckets, np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(edges))
            # Most phrases occur once: only the others have a count.
            rows = []
            for bucket in full:
                part, times = keys[edges[bucket] : edges[bucket + 1]], counts[edges[bucket] : edges[bucket + 1]]
                often = times > 1
                rows.append(
                    (bucket, lang, shard, need, part[~often].tobytes(), part[often].tobytes(), times[often].tobytes())
                )
            for at in range(0, len(rows), 64):
                columns = list(zip(*rows[at : at + 64], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, _BLOCK.types, strict=True)], schema=_BLOCK
                )

    return run


_BLOCK = pa.schema(
    [("bucket", pa.int64()), ("lang", pa.string()), ("shard", pa.int32()), ("need", pa.int64()),
     ("single", pa.binary()), ("often", pa.binary()), ("counts", pa.binary())]
)
_BLOCK_ROW = "bucket bigint, lang string, shard int, need bigint, single binary, often binary, counts binary"
COMPACT = 4 << 20  # hashes of a bucket that are held before they are summed up


class LocalCounts:
    """Counts of one shard's phrases in one bucket."""

    def __init__(self):
        self.keys = np.empty(0, np.uint64)
        self.counts = np.empty(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, row: dict) -> None:
        single = np.frombuffer(row["single"], np.uint64)
        often = np.frombuffer(row["often"], np.uint64)
        counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.more += [(single, np.ones(len(single), np.int64)), (often, counts)]
        self.size += len(single) + len(often)
        if self.size > COMPACT:
            self.summed()

    def summed(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.more)])
        counts = np.concatenate([self.counts, *(c for _, c in self.more)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        self.keys = keys[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        self.more, self.size = [], 0

    def reaching(self, need: int) -> np.ndarray:
        self.summed()
        return self.keys[self.counts >= need]


def _local(batches) -> Iterator[pa.RecordBatch]:
    """The locally frequent hashes of every (bucket, lang, shard, need), which come
    sorted."""
    name, counts = None, LocalCounts()

    def row():
        keys = counts.reaching(name[3])
        return pa.RecordBatch.from_pydict(
            {"bucket": pa.array([name[0]], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary()),
             "n": pa.array([len(keys)], pa.int64())}
        )

    for batch in batches:
        for each in batch.to_pylist():
            here = (each["bucket"], each["lang"], each["shard"], each["need"])
            if here != name:
                if name is not None:
                    yield row()
                name, counts = here, LocalCounts()
            counts.add(each)
    if name is not None:
        yield row()


def _prepared(
    docs: DataFrame, lang: str, text: str, support: int
) -> tuple[DataFrame, DataFrame]:
    """(lang, text, _shard), the text as bytes, and (lang, _shard, need), the local support.

    A shard's share of a language is measured in bytes. The shares of all shards
    add up to one, so a phrase with ``support`` reaches ``need`` in one of them.
    """
    rows = docs.select(
        F.coalesce(column(lang).cast("string"), F.lit(NO_LANG)).alias("lang"),
        whole_text(text).cast("binary").alias("text"),
    )
    rows = rows.withColumn("_shard", F.pmod(F.spark_partition_id(), F.lit(SHARDS)))
    sizes = rows.groupBy("lang", "_shard").agg(F.sum(F.octet_length("text")).alias("_bytes"))
    share = sizes.join(sizes.groupBy("lang").agg(F.sum("_bytes").alias("_all")), "lang")
    needs = share.select(
        "lang", "_shard",
        F.greatest(F.lit(1), F.ceil(F.lit(support) * F.col("_bytes") / F.greatest("_all", F.lit(1)) - 1e-6))
        .cast("bigint").alias("need"), "_bytes",
    )
    return rows, needs


def _locally_frequent(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, keys, n): the locally frequent hashes of all shards, stored."""
    blocks = rows.mapInArrow(_miner(bits), _BLOCK_ROW)
    found = (
        blocks.repartition("bucket")
        .sortWithinPartitions("bucket", "lang", "shard", "need")
        .mapInArrow(_local, "bucket bigint, keys binary, n bigint")
    )
    return materialise(found.filter("n > 0"), "locally-frequent")


def _mapper(first_bit: int, bits: int):
    """Rows (bucket, keys) as slices of the bitmap of one range of hashes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = np.frombuffer(row["keys"], np.uint64) << np.uint64(first_bit)
                places = np.unique(places >> np.uint64(64 - bits))
                octets, starts = np.unique(places >> np.uint64(3), return_index=True)
                values = np.bitwise_or.reduceat(
                    np.left_shift(1, (places & np.uint64(7)).astype(np.uint8)).astype(np.uint8), starts
                )
                yield pa.RecordBatch.from_pydict(
                    {"octets": [octets.astype(np.uint32).tobytes()], "bits": [values.tobytes()]}
                )

    return run


def _bitmap(local: DataFrame, part: int, first_bit: int, bits: int, bucket_bits: int) -> np.ndarray:
    """One bit for each of the 2**bits places of a range, at most MOST_BITS in all."""
    bitmap = np.zeros(1 << max(0, bits - 3), np.uint8)
    here = local
    if first_bit:
        here = local.filter(F.shiftright("bucket", bucket_bits - first_bit) == part)
    slices = here.mapInArrow(_mapper(first_bit, bits), "octets binary, bits binary")
    for row in slices.toLocalIterator(prefetchPartitions=True):
        np.bitwise_or.at(bitmap, np.frombuffer(row.octets, np.uint32), np.frombuffer(row.bits, np.uint8))
    return bitmap


def _counter(shared, part: int, first_bit: int, bits: int):
    """Counts (lang, words, phrase, n) of the candidates' occurrences, and with
    ``words`` 0 those of all words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for (lang, _, _), found in _counted(batches):
            texts, lengths, counts = [pa.array([""])], [0], [np.array([found.words * (part == 0)])]
            vocabulary = pa.array(found.vocabulary, pa.binary())
            for (numbers, times), keys in zip(found.phrases, keys_of(found, lang), strict=True):
                places = (keys << np.uint64(first_bit)) >> np.uint64(64 - bits)
                hit = (bitmap[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1
                hit = hit.astype(bool)
                if first_bit:
                    hit &= keys >> np.uint64(64 - first_bit) == part
                words = [vocabulary.take(pa.array(n)) for n in numbers[hit].T]
                phrase = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, b" ")
                texts.append(phrase.view(pa.string()))
                lengths += [numbers.shape[1]] * int(hit.sum())
                counts.append(times[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(lengths)), pa.array(lengths, pa.int32()),
                 pa.concat_arrays(texts), pa.array(np.concatenate(counts), pa.int64())],
                ["lang", "words", "phrase", "n"],
            )

    return run


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, lang: str = "lang", text: str = "text",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """(lang, words, phrase, n): every phrase of one to three words with at least
    ``support`` occurrences, exactly counted, and with ``words`` 0 the count of all
    words of each language. Stored."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, needs = _prepared(docs, lang, text, support)
    needs = materialise(needs, "local-supports")
    size = needs.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    bucket_bits = max(4, (max(1, size // BUCKET_BYTES) - 1).bit_length())
    rows = lookup_join(rows, needs.drop("_bytes"), ["lang", "_shard"], "left", ["text"]).select(
        "lang", F.col("_shard").alias("shard"), F.coalesce("need", F.lit(1)).alias("need"), "text"
    )
    local = _locally_frequent(rows, bucket_bits)
    keys = local.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    every = max(8, (max(1, keys * BITS_A_KEY) - 1).bit_length())
    # Ranges of hashes, each a whole number of buckets, with a bitmap in bounds.
    first_bit = min(bucket_bits, max(0, every - (most_bits.bit_length() - 1)))
    bits = min(every - first_bit, most_bits.bit_length() - 1)
    found = None
    for part in range(1 << first_bit):
        shared = spark.sparkContext.broadcast(_bitmap(local, part, first_bit, bits, bucket_bits))
        counted = rows.mapInArrow(
            _counter(shared, part, first_bit, bits), "lang string, words int, phrase string, n bigint"
        )
        some = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
        some = materialise(some.filter(f"n >= {support} or words = 0 and n > 0"), "frequent-phrases")
        found = some if found is None else found.unionByName(some)
    return found


def cut_score(whole: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)), exact up to counts of 15 digits."""
    a, l, r = (f"cast({name} as decimal(15,0))" for name in (whole, left, right))
    return F.expr(f"({a} * {a} * cast(1000000 as decimal(7,0))) div ({l} * {r})")


def collocations(
    docs: DataFrame, support: int = SUPPORT, inside: int = INSIDE, top: int = TOP,
    lang: str = "lang", text: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    A null text is empty, a null language is ``und`` and shares its counts with a
    language of that name. Rows that repeat others count as often as they came. The
    first ``top`` of each language are kept by a partial rank before the shuffle.
    """
    frequent = frequent_phrases(docs, support, lang, text)
    totals = frequent.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = frequent.filter("words > 0")

    def counts(name: str, words: int) -> DataFrame:
        some = phrases.filter(F.col("words") == words)
        return some.select("lang", F.col("phrase").alias(f"_{name}"), F.col("n").alias(name))

    def cut(rows: DataFrame, left: int, right: int, k: int) -> DataFrame:
        """The cut after ``left`` words: a struct (score, k, l, r)."""
        rows = rows.withColumn("_l", F.substring_index("phrase", " ", left)).withColumn(
            "_r", F.substring_index("phrase", " ", -right)
        )
        # Both sides are phrases that passed the support, far fewer than the text has.
        # A word many phrases start with is left to the skew join: copies of the
        # counts for a salt would outweigh them.
        rows = lookup_join(rows, counts("l", left), ["lang", "_l"], "inner")
        rows = lookup_join(rows, counts("r", right), ["lang", "_r"], "inner")
        score = cut_score("a", "l", "r").alias("score")
        return rows.withColumn(f"_cut{k}", F.struct(score, F.lit(k).alias("k"), "l", "r")).drop(
            "l", "r", "_l", "_r"
        )

    pairs = phrases.filter("words = 2").select("lang", "phrase", F.col("n").alias("a"))
    triples = phrases.filter("words = 3").select("lang", "phrase", F.col("n").alias("a"))
    parts = F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))
    longer = (
        triples.select("lang", F.explode(parts).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    )
    pairs = pairs.join(longer, ["lang", "phrase"], "left").filter(
        f"_longer is null or 100 * _longer < {inside} * a"
    ).drop("_longer")
    two = cut(pairs, 1, 1, 1).select("lang", "phrase", "a", F.col("_cut1").alias("_cut"))
    three = cut(cut(triples, 1, 2, 1), 2, 1, 2).select(
        "lang", "phrase", "a", F.least("_cut1", "_cut2").alias("_cut")
    )
    scored = two.unionByName(three).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top)
    return lookup_join(ranked, totals, ["lang"], "inner", ["phrase"]).select(
        "lang", F.col("_rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
