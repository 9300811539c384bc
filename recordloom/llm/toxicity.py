"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

A model gives a character's probability from the ORDER - 1 before it, inside its
word. The highest order is counted for toxic and for ordinary training texts
separately; what it discounts is handed to lower orders that both classes share.
Their continuation counts (in how many contexts a sequence occurs) come from the
whole corpus. A sequence neither class has met says nothing by itself; rare and
bent forms of an expression are recognised by the sequences they share with it.

A text is judged by its length-normalised difference of log-likelihoods and by
the differences of its most toxic words, weighed by a logistic regression that is
fitted on training texts the models were not counted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm import logistic
from recordloom.llm.shared import column, fold, packed, slices, small_batches, whole_text
from recordloom.session import materialise

ORDER = 5
CODE = 12  # bits of a character in a sequence's key
START = 1  # the code in front of a word, as often as the order needs
END = 2
DISCOUNT = 0.75
FOLDS = 5
HELD_OUT = 0
#: The fold whose training texts calibrate; the models are counted on the others.
CALIBRATION = 4
#: Bound of the sample: so many labelled training texts of either class.
MOST_TEXTS = 20_000
CACHE_WORDS = 150_000  # words a task remembers
MOST_SEQUENCES = 1_000_000  # sequences a task remembers to have listed
FEATURES = 4


def codes(word: str) -> np.ndarray:
    """Characters as numbers below 4 096; those of rare scripts share numbers."""
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(points < 2048, points + 3, 2048 + points % 2047)


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER characters that end at each character of each word (and
    at its end), and the place of the word each belongs to."""
    padded = "".join("\0" * (ORDER - 1) + w + "\1" for w in words)
    lengths = np.array([len(w) + 1 for w in words])
    every = codes(padded)
    every[every == 3] = START
    every[every == 4] = END
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.arange(lengths.sum()) + (owner + 1) * (ORDER - 1)
    keys = np.zeros(len(ends), np.int64)
    for back in range(ORDER - 1, -1, -1):
        keys = (keys << CODE) | every[ends - back]
    return keys, owner


def words_of(text: str) -> list[str]:
    """Lower-case words: white space and the punctuation around a word are cut off."""
    text = text.lower().replace("\0", " ").replace("\1", " ")
    return [w for w in (x.strip(MARKS) for x in text.split()) if w]


MARKS = ".,;:!?()[]{}<>\"'`*#$%&|/\\+-=_~^@"


def suffix(key: str, length: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << (CODE * length)) - 1))


def _class_counter(batches) -> Iterator[pa.RecordBatch]:
    """(key, toxic, n) of the sequences in labelled texts, summed up per batch."""
    for batch in batches:
        for some in slices(batch):
            labels = some.column("toxic").to_numpy(zero_copy_only=False)
            for label in (0, 1):
                texts = some.column("_text").filter(pa.array(labels == label)).to_pylist()
                words = [w for t in texts for w in words_of(t)]
                if words:
                    keys, counts = np.unique(sequences(words)[0], return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"key": keys, "toxic": np.full(len(keys), label, np.int32), "n": counts}
                    )


def _sequence_lister(batches) -> Iterator[pa.RecordBatch]:
    """The distinct sequences of a task's texts, of whose words each is looked at
    once as long as it is remembered."""
    seen: set[str] = set()
    found = np.empty(0, np.int64)
    for batch in batches:
        for some in slices(batch):
            words = {w for t in some.column("_text").to_pylist() for w in set(words_of(t))}
            fresh = [w for w in words if w not in seen]
            if not fresh:
                continue
            if len(seen) > CACHE_WORDS:
                seen = set()
            seen.update(fresh)
            keys = np.unique(sequences(fresh)[0])
            keys = np.setdiff1d(keys, found, assume_unique=True)
            if len(keys):
                found = np.union1d(found, keys) if len(found) < MOST_SEQUENCES else keys
                yield pa.RecordBatch.from_pydict({"key": keys})


class Model:
    """Differences of log-probabilities by sequence, as sorted arrays."""

    def __init__(self, keys, gains, contexts, handed, beta, mean, scale):
        self.keys, self.gains = keys, gains
        self.contexts, self.handed = contexts, handed
        self.beta, self.mean, self.scale = beta, mean, scale

    def of_words(self, words: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word."""
        keys, owner = sequences(words)
        gains = looked_up(self.keys, self.gains, keys, np.nan)
        handed = looked_up(self.contexts, self.handed, keys >> CODE, 0.0)
        return np.bincount(owner, np.where(np.isnan(gains), handed, gains), len(words))


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default, np.float64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


class Scorer:
    """Features of texts; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def features(self, texts: list[str]) -> np.ndarray:
        cut = [words_of(t) for t in texts]
        fresh = list({w for words in cut for w in words if w not in self.known})
        if fresh:
            self.known.update(zip(fresh, self.model.of_words(fresh).tolist(), strict=True))
        rows = np.zeros((len(texts), FEATURES))
        for row, words in zip(rows, cut, strict=True):
            if words:
                gains = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
                top = np.sort(gains)[-3:][::-1]
                row[:] = (
                    gains.sum() / (sum(map(len, words)) + len(words)),
                    top[0], top.sum() / 3, np.log1p(len(words)),
                )
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        return rows


def _shared_tables(corpus: DataFrame, needed: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """For the orders ORDER - 1 down to 1: sorted sequences with the number of
    contexts they continue, that of all continuations of their own context, and
    how many different ones it has; only of sequences that end a needed one."""
    tables, level = [], corpus
    for length in range(ORDER - 1, 0, -1):
        level = level.groupBy(suffix("key", length).alias("key")).agg(F.count("*").alias("n"))
        sums = level.groupBy(F.shiftright("key", CODE).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds")
        )
        wanted = needed.select(suffix("key", length).alias("key")).distinct()
        rows = (
            wanted.join(level, "key")
            .withColumn("context", F.shiftright("key", CODE))
            .join(sums, "context")
            .select("key", "n", "total", "kinds")
            .toArrow()
            .sort_by("key")
        )
        tables.append(tuple(rows.column(i).to_numpy() for i in range(4)))
        level = level.select("key")
    return tables


def _shared_probability(tables: list[tuple[np.ndarray, ...]], keys: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of the last character given those before it, from
    the orders both classes share."""
    probability = np.full(len(keys), 1 / 256)
    for length in range(1, ORDER):
        names, n, total, kinds = tables[ORDER - 1 - length]
        wanted = keys & ((1 << (CODE * length)) - 1)
        if not len(names):
            continue
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        met = names[at] == wanted
        upper = (np.maximum(n[at] - DISCOUNT, 0) + DISCOUNT * kinds[at] * probability) / total[at]
        probability = np.where(met, upper, probability)
    return probability


def _class_tables(
    keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, shared: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Gains of the sequences met, and what their contexts hand down."""
    contexts, place = np.unique(keys >> CODE, return_inverse=True)
    logs, handed = [], []
    for counts in (toxic, ordinary):
        total = np.bincount(place, counts, len(contexts))
        kinds = np.bincount(place, counts > 0, len(contexts))
        rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[place]
        logs.append(np.log(own + rest[place] * shared))
        handed.append(np.log(rest))
    return keys, logs[0] - logs[1], contexts, handed[0] - handed[1]


def _feature_mapper(shared, passing: list[str]):
    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for some in slices(batch):
                rows = scorer.features(some.column("_text").to_pylist())
                names = [f"f{i}" for i in range(FEATURES)]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in passing), *(pa.array(c) for c in rows.T)],
                    [*passing, *names],
                )

    return run


_FEATURE_COLUMNS = ", ".join(f"f{i} double" for i in range(FEATURES))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_name: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_texts: int = MOST_TEXTS,
) -> Model:
    """Train on rows outside the held-out fold: a bounded number of labelled texts
    for the class counts and the calibration, all texts for the shared counts.

    The sample is chosen by a hash of the id: all texts of a class if there are
    no more than ``most_texts``, else about that many. What comes to the driver is
    bounded by it. Without labels of both classes every score is the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(column(id_name).alias("_id"), whole_text(text).alias("_text"))
    marked = (
        labels.select(column(id_name).alias("_id"), column(label).cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull())
        .filter(fold("_id", FOLDS) != HELD_OUT)
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))  # once toxic, whatever other rows say
    )
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.lit(0)
    for value, size in sizes.items():
        part = int(min(1.0, most_texts / size) * 1_000_000)
        share = F.when(F.col("toxic") == value, part).otherwise(share)
    chosen = marked.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < share)
    # At most about 2 * most_texts (id, label) rows.
    sample = materialise(texts.join(F.broadcast(chosen), "_id"), "toxicity-sample")
    counted = sample.filter(fold("_id", FOLDS) != CALIBRATION).mapInArrow(
        _class_counter, "key bigint, toxic int, n bigint"
    )
    counts = materialise(
        counted.groupBy("key").agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("ordinary"),
        ),
        "toxicity-counts",
    )
    corpus = texts.select("_text").mapInArrow(_sequence_lister, "key bigint").distinct()
    corpus = materialise(corpus, "corpus-sequences")
    tables = _shared_tables(corpus, counts)
    own = counts.toArrow().sort_by("key")
    keys, toxic, ordinary = (own.column(c).to_numpy() for c in ("key", "toxic", "ordinary"))
    parts = _class_tables(keys, toxic, ordinary, _shared_probability(tables, keys))
    model = Model(*parts, np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES))

    shared = spark.sparkContext.broadcast(model)
    rows = (
        sample.filter(fold("_id", FOLDS) == CALIBRATION)
        .select("toxic", "_text")
        .mapInArrow(_feature_mapper(shared, ["toxic"]), f"toxic int, {_FEATURE_COLUMNS}")
        .toArrow()
    )
    x = np.column_stack([rows.column(f"f{i}").to_numpy() for i in range(FEATURES)])
    y = rows.column("toxic").to_numpy().astype(float)
    if len(y):
        model.mean, model.scale = logistic.standardise(x)
    model.beta = logistic.fit((x - model.mean) / model.scale, y)
    return model


def _scored(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """(_row, _score) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for some in slices(batch):
                x = scorer.features(some.column("_text").to_pylist())
                x = (x - scorer.model.mean) / scorer.model.scale
                z = np.clip(scorer.model.beta[0] + x @ scorer.model.beta[1:], -30, 30)
                yield pa.RecordBatch.from_arrays(
                    [some.column("_row"), pa.array(1 / (1 + np.exp(-z)))], ["_row", "_score"]
                )

    rows = packed(docs, _text=whole_text(text))
    schema = T.StructType([rows.schema["_row"], T.StructField("_score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1 as its last column (in place of one of that
    name); a null or empty text gets the score of a text without words."""
    names = [F.col("_row")[n].alias(n) for n in docs.columns if n != name]
    return _scored(docs, model, text).select(*names, F.col("_score").alias(name))


def below(docs: DataFrame, model: Model, limit: float, text: str = "text") -> DataFrame:
    """The rows whose score is below ``limit``, with just their columns."""
    return _scored(docs, model, text).filter(F.col("_score") < limit).select("_row.*")
