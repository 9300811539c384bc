"""Near-duplicate groups by HyperMinHash sketches, bands and exact verification.

1. One pass turns each text into its shingle set's size, digest and registers.
   Documents with the same set are one group from the start; one of them, its
   smallest id, goes on.
2. Bands of registers put similar sets into buckets; sets of at most SHORT shingles,
   and those that one of them can be similar to, meet in buckets of the shingles of
   their prefixes instead, which miss no pair. A bucket is led by its most
   popular member, the one whose own buckets are fullest; in a family of copies
   that is the original or a text close to it. Every member is compared with two
   of its leaders, the one it meets most often and the most popular one.
3. Links found so connect most of every group. Only buckets that still hold
   members of different components are searched in full, block against block, by
   estimates from the registers; no pair inside one component is looked at.
4. Pairs whose estimate allows the threshold are verified on whole shingle sets. Where
   the blocks of a search give more of them than they have members, the members go on
   instead: their sets meet once more by blocks, pairs are verified there, best first,
   and only links between parts that are not connected yet are given out. Rows grow
   with the members, not with their pairs, and no link between components is lost.
5. Components by contraction: each round every node moves to its smallest
   neighbour, and the links are rewritten between what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.hyperminhash import (
    BANDS,
    REGISTERS,
    SHORT,
    Hasher,
    band_keys,
    estimates,
    may_reach,
    most_short,
    prefix_keys,
    sketch,
)
from recordloom.llm.shared import column, slices, small_batches, spread_join, whole_text
from recordloom.session import materialise

THRESHOLD = 0.75
BLOCK = 512  # members of a bucket that are compared with another BLOCK at once
#: Shingles of the sets that meet in a task (64 MB); blocks of longer ones give pairs.
MOST_SHINGLES = 8 << 20
#: Ids of at most this many documents are broadcast (16 bytes each).
MAX_IDS = 1_000_000
#: Shingles of short sets that come last in the order of prefixes: those of at least
#: COMMON sets, the most frequent MOST_COMMON of them. They only decide how even the
#: buckets are.
COMMON = 16
MOST_COMMON = 20_000
#: Members of a bucket from which it is dealt over SALTS tasks.
HOT = 1_000
SALTS = 8

Order = tuple[np.ndarray, np.ndarray]  # common shingles, sorted, and their counts


def _sketcher(threshold: float):
    most = most_short(threshold)

    def run(batches) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for some in slices(batch):
                sets = [hasher.shingles(x) for x in some.column("_text").to_pylist()]
                few = [s.tobytes() if len(s) <= most else b"" for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "_id": some.column("_id"),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                        "registers": [sketch(s).tobytes() for s in sets],
                        "few": pa.array(few, pa.binary()),
                    }
                )

    return run


def _few_shingles(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        few = np.frombuffer(b"".join(batch.column("few").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(few)], ["shingle"])


def _order(nodes: DataFrame) -> Order:
    """The common shingles of the short sets."""
    counts = (
        nodes.filter("few <> X''")
        .select("few")
        .mapInArrow(_few_shingles, "shingle bigint")
        .groupBy("shingle")
        .agg(F.count("*").alias("times"))
        .filter(F.col("times") >= COMMON)
        .orderBy(F.desc("times"), "shingle")
        .limit(MOST_COMMON)
        .collect()
    )
    common = np.array([r.shingle for r in counts], np.int64).view(np.uint64)
    at = np.argsort(common)
    return common[at], np.array([r.times for r in counts], np.int64)[at]


def _bands(n: int, registers: np.ndarray) -> np.ndarray:
    """Keys of the buckets a set shares with longer ones."""
    return band_keys(registers) if n > SHORT else np.empty(0, np.int64)


def _prefix(few: bytes, order: Order, threshold: float) -> np.ndarray:
    """Keys of the buckets a set shares with short ones."""
    if not few:
        return np.empty(0, np.int64)
    return prefix_keys(np.frombuffer(few, np.uint64), *order, threshold)


def _bander(order: Order, threshold: float):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                keys = [
                    np.concatenate(
                        [_bands(n, np.frombuffer(r, np.uint16)), _prefix(few, order, threshold)]
                    )
                    for n, r, few in zip(
                        *(some.column(c).to_pylist() for c in ("n", "registers", "few")), strict=True
                    )
                ]
                times = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(some.column("_id").to_numpy(), times)),
                        pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)),
                    ],
                    ["_id", "band"],
                )

    return run


def _set_rows(batches) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for some in slices(batch):
            sets = [hasher.shingles(x).view(np.int64) for x in some.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [some.column("_id"), pa.array(sets, pa.list_(pa.int64()))], ["_id", "shingles"]
            )


def _registers(column_: pa.Array) -> np.ndarray:
    rows = column_.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), REGISTERS)


def _estimator(threshold: float):
    """Map (a, b, na, nb, ra, rb) to the pairs (a, b) that may be similar."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            good = may_reach(
                _registers(batch.column("ra")), _registers(batch.column("rb")),
                batch.column("na").to_numpy(), batch.column("nb").to_numpy(), threshold,
            )
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _similar(one: np.ndarray, other: np.ndarray, hundredths: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * shared >= hundredths * (len(one) + len(other) - shared)


def _verifier(threshold: float):
    """Map (a, b, sa, sb) to the pairs that are similar, on whole sorted sets."""
    hundredths = round(threshold * 100)

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                left, right = (some.column(c) for c in ("sa", "sb"))
                good = [
                    _similar(left[i].values.to_numpy(), right[i].values.to_numpy(), hundredths)
                    for i in range(some.num_rows)
                ]
                yield some.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _pairs_within(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows of the same group; equal groups are adjacent."""
    ends = np.searchsorted(groups, groups, side="right")
    counts = ends - np.arange(len(groups)) - 1
    first = np.repeat(np.arange(len(groups)), counts)
    before = np.cumsum(counts) - counts
    return first, first + 1 + np.arange(len(first)) - np.repeat(before, counts)


NO_KEY = np.iinfo(np.int64).max


def _first_meeting(
    table: pa.Table, first: np.ndarray, second: np.ndarray, order: Order, threshold: float
) -> np.ndarray:
    """Whether this bucket is the first of all that the two rows share: a pair that
    meets in several is reported by one."""
    rows, place = np.unique(np.concatenate([first, second]), return_inverse=True)
    if not len(rows):
        return np.zeros(0, bool)
    taken = table.take(pa.array(rows))
    n, registers = taken.column("n").to_pylist(), _registers(taken.column("registers"))
    short = [_prefix(few, order, threshold) for few in taken.column("few").to_pylist()]
    bands = np.full((len(rows), BANDS), NO_KEY)
    prefix = np.full((len(rows), max(map(len, short))), NO_KEY)
    for at in range(len(rows)):
        if n[at] > SHORT:
            bands[at] = band_keys(registers[at])
        prefix[at, : len(short[at])] = short[at]
    here = table.column("band").to_numpy()[first]
    found = []
    for at in range(0, len(first), 10_000):
        one, other = place[: len(first)][at : at + 10_000], place[len(first) :][at : at + 10_000]
        least = np.where(bands[one] == bands[other], bands[one], NO_KEY).min(axis=1)
        for keys in prefix[one].T:
            met = (prefix[other] == keys[:, None]).any(axis=1)
            least = np.minimum(least, np.where(met, keys, NO_KEY))
        found.append(least == here[at : at + 10_000])
    return np.concatenate(found)


def _hopeful(
    table: pa.Table, order: Order, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of pairs of different components that may be similar, of whole sorted
    groups, and the number of every row's group."""
    keys = [table.column(c).to_numpy() for c in ("band", "i", "j")]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    groups = np.cumsum(new)
    first, second = _pairs_within(groups)
    side, comp, ids, n = (table.column(c).to_numpy() for c in ("side", "comp", "_id", "n"))
    # In a task of two blocks only pairs between them count, and a bucket's other
    # tasks see the pairs within each.
    meet = (side[first] == 0) | (side[first] != side[second])
    meet &= (comp[first] != comp[second]) & (ids[first] != ids[second])
    meet &= np.minimum(n[first], n[second]) >= threshold * np.maximum(n[first], n[second])
    first, second = first[meet], second[meet]
    registers = _registers(table.column("registers"))
    good = [np.zeros(0, bool)]
    for at in range(0, len(first), 10_000):
        a, b = first[at : at + 10_000], second[at : at + 10_000]
        good.append(may_reach(registers[a], registers[b], n[a], n[b], threshold))
    good = np.concatenate(good)
    first, second = first[good], second[good]
    alone = _first_meeting(table, first, second, order, threshold)
    return first[alone], second[alone], groups


def _crossing(table: pa.Table, order: Order, threshold: float) -> pa.RecordBatch:
    """Of whole sorted groups: the hopeful pairs (a, b) where they are few, else the
    members (a, without b) that are in one."""
    first, second, groups = _hopeful(table, order, threshold)
    ids, n = table.column("_id").to_numpy(), table.column("n").to_numpy()
    inside = np.unique(np.concatenate([first, second]))
    members = np.bincount(groups[inside], minlength=groups[-1] + 1)
    shingles = np.bincount(groups[inside], n[inside], minlength=groups[-1] + 1)
    pairs = np.bincount(groups[first], minlength=groups[-1] + 1)
    dense = (pairs > members) & (shingles <= MOST_SHINGLES)
    few = ~dense[groups[first]]
    a, b = ids[first[few]], ids[second[few]]
    rows = inside[dense[groups[inside]]]
    taken = table.select(["band", "i", "j", "side", "comp"]).take(pa.array(rows))
    nothing = len(a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.minimum(a, b), ids[rows]])),
            pa.concat_arrays([pa.array(np.maximum(a, b)), pa.nulls(len(rows), pa.int64())]),
            *(
                pa.concat_arrays([pa.nulls(nothing, c.type), *c.chunks])
                for c in taken.columns
            ),
        ],
        ["a", "b", *taken.column_names],
    )


def _connecting(table: pa.Table, order: Order, threshold: float) -> pa.RecordBatch:
    """Links of whole sorted groups that connect what is not connected yet, verified on
    whole sets; hopeful pairs that stay apart are refuted for good."""
    sets = [x.values.to_numpy() for x in table.column("shingles")]
    hashes = [x.view(np.uint64) for x in sets]
    most = most_short(threshold)
    facts = table.select(["band", "i", "j", "side", "comp", "_id"])
    facts = facts.append_column("n", pa.array([len(x) for x in sets], pa.int64()))
    facts = facts.append_column("registers", pa.array([sketch(x).tobytes() for x in hashes]))
    small = [x.tobytes() if len(x) <= most else b"" for x in hashes]
    facts = facts.append_column("few", pa.array(small, pa.binary()))
    first, second, _ = _hopeful(facts, order, threshold)
    n, ids = facts.column("n").to_numpy(), facts.column("_id").to_numpy()
    registers = _registers(facts.column("registers"))
    likeness = [np.zeros(0)]
    for at in range(0, len(first), 10_000):
        a, b = first[at : at + 10_000], second[at : at + 10_000]
        likeness.append(estimates(registers[a], registers[b], n[a], n[b])[0])
    best = np.argsort(-np.concatenate(likeness), kind="stable")
    above = {x: x for x in facts.column("comp").to_pylist()}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    comp = facts.column("comp").to_pylist()
    hundredths, links = round(threshold * 100), []
    for a, b in zip(first[best].tolist(), second[best].tolist(), strict=True):
        one, other = root(comp[a]), root(comp[b])
        if one != other and _similar(sets[a], sets[b], hundredths):
            above[one] = other
            links.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
    links = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def _by_groups(function, order: Order, threshold: float):
    """Map rows sorted by (band, i, j): a group has at most two blocks, and whole
    groups are searched together, many small ones at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in ("band", "i", "j")]
            last = np.all([k == k[-1] for k in keys], axis=0)
            start = table.num_rows - int(last.sum())  # of the group that may go on
            if start:
                yield function(table.slice(0, start), order, threshold)
                held = table.slice(start).to_batches()
        if held:
            yield function(pa.Table.from_batches(held), order, threshold)

    return run


_PAIR = "a bigint, b bigint"


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes and registers allow the threshold. Sizes come first: registers
    move for the pairs they leave only."""
    sizes = nodes.select("_id", "n").distinct()
    sized = materialise(
        pairs.join(sizes.toDF("a", "na"), "a")
        .join(sizes.toDF("b", "nb"), "b")
        .filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")),
        "sized-pairs",
    )
    side = nodes.join(_wanted_ids(sized), "_id", "left_semi").select("_id", "n", "registers")
    return (
        sized.join(side.toDF("a", "na", "ra"), ["a", "na"])
        .join(side.toDF("b", "nb", "rb"), ["b", "nb"])
        .select("a", "b", "na", "nb", "ra", "rb")
        .mapInArrow(_estimator(threshold), _PAIR)
    )


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    return (
        pairs.join(sets.toDF("a", "sa"), "a")
        .join(sets.toDF("b", "sb"), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_verifier(threshold), _PAIR)
    )


def _bucket_join(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Join rows that have their bucket's ``band`` and ``size`` with the one row of each
    bucket. Large buckets are dealt out by id, and only their rows are copied."""
    large = F.col("size") > HOT
    salt = F.when(large, F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(0).cast("int")
    last = F.when(large, SALTS - 1).otherwise(0)
    copies = buckets.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("size")
    return members.withColumn("_salt", salt).join(copies, ["band", "_salt"]).drop("_salt")


def _bucket_members(bands: DataFrame) -> DataFrame:
    """The rows of ``bands`` (_id, band) that are not alone in their bucket, with its size."""
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = materialise(sizes, "bucket-sizes")
    # At most one bucket for HOT rows.
    large = sizes.filter(F.col("size") > HOT)
    known = bands.join(F.broadcast(large), "band", "left").withColumn(
        "size", F.coalesce("size", F.lit(0))
    )
    whole = sizes.withColumn("members", F.col("size"))
    found = _bucket_join(known, whole)
    return found.select("_id", "band", F.col("members").alias("size"))


def _stars(members: DataFrame) -> DataFrame:
    """At most two pairs (a, b) of each member of a bucket with leaders it has."""
    popular = members.groupBy("_id").agg(F.sum("size").alias("popularity"))
    led = (
        members.join(popular, "_id")
        .groupBy("band")
        .agg(
            F.max(F.struct("popularity", (-F.col("_id")).alias("id"))).alias("_first"),
            F.max("size").alias("size"),
        )
        .select("band", "size", "_first.popularity", (-F.col("_first.id")).alias("leader"))
    )
    met = (
        _bucket_join(members, led)
        .filter("leader <> _id")
        .groupBy("_id", "leader")
        .agg(F.count("*").alias("shared"), F.max("popularity").alias("popularity"))
    )
    chosen = met.groupBy("_id").agg(
        F.max(F.struct("shared", "popularity", (-F.col("leader")).alias("id"))).alias("_often"),
        F.max(F.struct("popularity", (-F.col("leader")).alias("id"))).alias("_popular"),
    )
    leaders = F.explode(F.array_distinct(F.array(-F.col("_often.id"), -F.col("_popular.id"))))
    pairs = chosen.select("_id", leaders.alias("leader"))
    return pairs.select(
        F.least("_id", "leader").alias("a"), F.greatest("_id", "leader").alias("b")
    ).distinct()


def _wanted_ids(pairs: DataFrame) -> DataFrame:
    """The ids in ``pairs``, to be broadcast where they are few."""
    ids = pairs.select("a").union(pairs.select("b")).toDF("_id").filter("_id is not null")
    ids = materialise(ids.distinct(), "wanted-ids")
    return F.broadcast(ids) if ids.count() <= MAX_IDS else ids


def _shingle_sets(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(_id, shingles) of the documents in ``pairs``, stored once."""
    texts = rows.join(_wanted_ids(pairs), "_id", "left_semi")
    return materialise(texts.mapInArrow(_set_rows, "_id bigint, shingles array<bigint>"), "sets")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node that
    can be reached from it. One durable table a round; the links left shrink."""
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = materialise(links.filter("a < b").distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialise(nodes.withColumn("label", F.col("node")), "labels")
    while not links.isEmpty():
        above = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        above = materialise(above, "parents")
        # Two steps up at once, as far as there are two.
        up = above.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        up = above.join(up, "parent", "left").select(
            "node", F.coalesce("grand", "parent").alias("parent")
        )
        up = materialise(up, "parents")

        def moved(frame: DataFrame, name: str, up: DataFrame = up) -> DataFrame:
            step = up.toDF(name, "_up")
            return frame.join(step, name, "left").withColumn(
                name, F.coalesce("_up", name)
            ).drop("_up")

        labels = materialise(moved(labels, "label").select("node", "label"), "labels")
        links = moved(moved(links, "a"), "b").filter("a <> b")
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = materialise(links.distinct(), "links")
    return labels


def near_groups(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    id_name: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when their shingle sets have this Jaccard similarity;
    ``component_id`` is the smallest id that can be reached, ``kept`` marks it.
    A null text is empty; a text without words has no shingles and is linked with
    nothing. A row with a null id is linked with nothing either: its component is
    null and it is kept. Rows that share an id are one node with the links of all
    of them. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        column(id_name).cast("bigint").alias("_id"), whole_text(text).alias("_text")
    )
    sketches = materialise(
        rows.mapInArrow(
            _sketcher(threshold),
            "_id bigint, n bigint, set_key binary, registers binary, few binary",
        ),
        "sketches",
    )
    linked = sketches.filter("n > 0 and _id is not null")
    groups = materialise(
        linked.groupBy("set_key").agg(F.min("_id").alias("_id"), F.count("*").alias("_size")),
        "shingle-sets",
    )
    nodes = materialise(
        linked.join(groups.select("set_key", "_id"), ["set_key", "_id"])
        .select("_id", "n", "registers", "few", "set_key")
        .dropDuplicates(["_id", "set_key"]),
        "nodes",
    )
    order = _order(nodes)
    bands = nodes.select("_id", "n", "registers", "few").mapInArrow(
        _bander(order, threshold), "_id bigint, band bigint"
    )
    members = materialise(_bucket_members(bands), "bucket-members")
    stars = materialise(_stars(members), "stars")
    hopeful = materialise(_estimated(stars, nodes, threshold), "hopeful-pairs")
    sets = _shingle_sets(rows, hopeful)
    close = materialise(_verified(hopeful, sets, threshold), "links")
    comps = components(close)

    placed = members.join(comps.toDF("_id", "comp"), "_id", "left").withColumn(
        "comp", F.coalesce("comp", "_id")
    )
    placed = materialise(placed.select("band", "size", "_id", "comp"), "bucket-members")
    mixed = (
        placed.groupBy("band", "size")
        .agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count("*").alias("rows"))
        .filter("_low < _high")
        .select("band", "size", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    )
    spread = _bucket_join(placed, mixed).withColumn(
        "block", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int")
    )
    # Every member meets every block of its bucket once: side 0 within its own
    # block, sides 1 and 2 between two.
    tasks = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select(
        "band", "_id", "comp",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 0)
        .when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    crossing = (
        tasks.join(nodes.select("_id", "n", "registers", "few"), "_id")
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
        .mapInArrow(
            _by_groups(_crossing, order, threshold),
            f"{_PAIR}, band bigint, i int, j int, side int, comp bigint",
        )
    )
    crossing = materialise(crossing, "crossing-pairs")
    sets = _shingle_sets(rows, crossing)
    more = _verified(crossing.filter("b is not null").select("a", "b").distinct(), sets, threshold)
    dense = crossing.filter("b is null").select(
        F.col("a").alias("_id"), "band", "i", "j", "side", "comp"
    )
    connecting = (
        dense.join(sets, "_id")
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
        .mapInArrow(_by_groups(_connecting, order, threshold), _PAIR)
    )
    every = components(close.unionByName(more).unionByName(connecting))

    named = groups.join(every.toDF("_id", "comp"), "_id", "left")
    named = named.filter("_size > 1 or comp is not null").select(
        "set_key", F.coalesce("comp", "_id").alias("comp")
    )
    # Sets nobody shares and nobody is linked with are not in ``named``.
    found = spread_join(
        sketches.filter("_id is not null").select("_id", "n", "set_key"), named, ["set_key"], ["_id"]
    ).unionByName(
        sketches.filter("_id is null").select(
            "_id", "n", "set_key", F.lit(None).cast("bigint").alias("comp")
        )
    )
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.coalesce("comp", "_id"))
    return found.select(
        F.col("_id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("_id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    The ids that go are far fewer than those that stay; as long as they can be
    broadcast, no text moves.
    """
    ids = near_groups(docs, threshold).filter("doc_id is not null").groupBy("doc_id")
    gone = ids.agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    gone = materialise(gone, "dropped-documents")
    # Ids are unique on the right and nearly so on the left: an even shuffle.
    gone = F.broadcast(gone) if gone.count() <= MAX_IDS else gone.hint("merge")
    return docs.join(gone, "doc_id", "left_anti")
