"""Document fingerprints: a Merkle tree over sections, paragraphs and passages.

A paragraph is a line. It is divided into passages at words chosen by their own
hash, and inside long words (text without spaces) at places chosen by a checksum of
the characters before them; paragraphs are gathered into sections in the same way, so an edit moves
no boundary beyond its surroundings. A node's digest covers those of its
children; the root therefore tests equality of whole texts, and where two trees
differ, only the differing branches have to be followed to find the edit.

Fingerprint: ``root|section/section/...`` with ``section = digest:paragraph;...``,
``paragraph = digest:passage,...`` and ``passage = digest-length`` (lengths in
code points). The root has 64 hex digits, sections and paragraphs have 8, passages 6: those are
only compared between two documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import column, slices, small_batches, whole_text

WORDS_IN_PASSAGE = 8  # on average
MOST_WORDS = 16  # of a passage
MOST_CHARS = 64  # code points of a word that is not cut inside, and of a piece of one
LEAST_CHARS = 16  # of such a piece, but for the last one
ROLLED = 8  # code points that decide about a cut inside a word
CUT_BITS = 4  # of their checksum that have to be zero
SINGLE_WORDS = 16  # at the start of a text, so that short texts have branches too
PARAGRAPHS_IN_SECTION = 4  # on average
PARTS_PER_TASK = 4
WORD = re.compile(r"\S+\s*|\s+")


def _digest(content: bytes) -> bytes:
    return blake2b(content, digest_size=32).digest()


def cuts(word: str) -> list[int]:
    """Ends of the pieces of a long word: behind ROLLED code points whose checksum
    says so, or MOST_CHARS after the last cut where none does."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(len(codes) - ROLLED + 1, np.uint64)
    for at in range(ROLLED):
        total = (total + codes[at : at + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    chosen = np.flatnonzero(total >> np.uint64(64 - CUT_BITS) == 0) + ROLLED
    ends, start = [], 0
    for end in [*chosen.tolist(), len(codes)]:
        while end - start > MOST_CHARS:
            start += MOST_CHARS
            ends.append(start)
        if end - start >= LEAST_CHARS or end == len(codes) > start:
            ends.append(end)
            start = end
    return ends


def passages(paragraph: str, singles: int = 0) -> list[str]:
    """The paragraph: its first ``singles`` words one by one, the others cut
    behind words whose checksum says so, and where none of MOST_WORDS does. Words
    beyond MOST_CHARS are cut inside and behind, whatever the words around them."""
    found, start, at, words = [], 0, 0, 0
    for place, word in enumerate(WORD.findall(paragraph)):
        if len(word) > MOST_CHARS:
            if start < at:
                found.append(paragraph[start:at])
            ends = [at, *(at + end for end in cuts(word))]
            found += [paragraph[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            at += len(word)
            start, words = at, 0
            continue
        at += len(word)
        words += 1
        if (
            place < singles
            or words == MOST_WORDS
            or zlib.crc32(word.encode()) % WORDS_IN_PASSAGE == 0
        ):
            found.append(paragraph[start:at])
            start, words = at, 0
    if start < at:
        found.append(paragraph[start:])
    return found


Leaf = tuple[str, int]  # digest and length
Branch = tuple[bytes, str, list[Leaf]]


def _branch(line: str, singles: int) -> Branch:
    """Digest of a paragraph, its part of the fingerprint, and its passages."""
    leaves, digests = [], []
    for passage in passages(line, singles):
        digest = _digest(b"p" + passage.encode())
        digests.append(digest)
        leaves.append((digest[:3].hex(), len(passage)))
    own = _digest(b"l" + b"".join(digests))
    written = ",".join([f"{d}-{n}" for d, n in leaves])
    return own, f"{own[:4].hex()}:{written}", leaves


def _grown(text: str, known: dict[tuple[str, int], Branch]) -> tuple[str, Counter]:
    """Fingerprint and passages of a text; ``known`` holds paragraphs met before
    and gets the new ones."""
    sections, members, section, digests = [], [], [], []
    every: Counter = Counter()
    lines, singles = text.split("\n") if text else [], SINGLE_WORDS
    for number, line in enumerate(lines):
        branch = known.get((line, singles))
        if branch is None:
            branch = known[line, singles] = _branch(line, singles)
        own, written, leaves = branch
        singles = max(0, singles - len(leaves))
        every.update(leaves)
        section.append(written)
        digests.append(own)
        if own[4] % PARAGRAPHS_IN_SECTION == 0 or number == len(lines) - 1:
            whole = _digest(b"s" + b"".join(digests))
            sections.append(f"{whole[:4].hex()}:{';'.join(section)}")
            members.append(whole)
            section, digests = [], []
    return _digest(b"r" + b"".join(members)).hex() + "|" + "/".join(sections), every


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text; the empty one has a root only."""
    return _grown(text, {})[0]


def _tree(mark: str) -> Iterator[tuple[str, list[tuple[str, list[tuple[str, int]]]]]]:
    """(section digest, [(paragraph digest, [(passage digest, length)])])."""
    body = mark.partition("|")[2]
    for section in filter(None, body.split("/")):
        digest, _, rest = section.partition(":")
        paragraphs = []
        for paragraph in rest.split(";"):
            own, _, leaves = paragraph.partition(":")
            pairs = (leaf.split("-") for leaf in filter(None, leaves.split(",")))
            paragraphs.append((own, [(d, int(n)) for d, n in pairs]))
        yield digest, paragraphs


def _leaves(mark: str) -> Counter:
    return Counter(leaf for _, ps in _tree(mark) for _, leaves in ps for leaf in leaves)


def _shared(one: str, a: Counter, other: str, b: Counter) -> float:
    if one.partition("|")[0] == other.partition("|")[0]:
        return 1.0
    shared = sum(leaf[1] * min(count, b[leaf]) for leaf, count in a.items() if leaf in b)
    longer = max(sum(n * c for (_, n), c in x.items()) for x in (a, b))
    return min(1.0, shared / longer) if longer else 0.0


def likeness(one: str, other: str) -> float:
    """Shared characters, by passages, as a share of the longer text: 1 for equal
    texts, 0 where no passage occurs in both."""
    return _shared(one, _leaves(one), other, _leaves(other))


def changed_spans(one: str, other: str) -> list[tuple[int, int]]:
    """Spans of the first text (code points) whose passages the second lacks.
    Branches that the second also has are not descended into."""
    if one.partition("|")[0] == other.partition("|")[0]:
        return []
    theirs = list(_tree(other))
    sections = {d for d, _ in theirs}
    paragraphs = {d for _, ps in theirs for d, _ in ps}
    leaves = {leaf for _, ps in theirs for _, ls in ps for leaf in ls}
    spans: list[tuple[int, int]] = []
    at = 0
    for section, members in _tree(one):
        for paragraph, own in members:
            for leaf in own:
                end = at + leaf[1]
                if not (section in sections or paragraph in paragraphs or leaf in leaves):
                    if spans and spans[-1][1] >= at - 1:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((at, end))
                at = end
            at += 1  # the line break
    return spans


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text (null: empty) added."""

    @F.pandas_udf("string")
    def marks(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return docs.withColumn(name, marks(whole_text(text)))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the start of the next one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def _compare(rows: Iterable[dict]) -> Iterator[tuple]:
    """Rows of a part in order, each with the next one; the last of a part is
    only there to be looked at."""
    before = None
    for row in rows:
        known: dict[tuple[str, int], Branch] = {}
        mark, leaves = _grown(row["_text"], known)
        if before is not None and before[0]["_part"] == row["_part"]:
            old, own, own_leaves, own_known = before
            new = edited(old["_text"], row["_text"])
            new_mark, new_leaves = _grown(new, own_known)  # only the edit is new
            yield (
                old["_id"], len(old["_text"]), sha256(new.encode()).hexdigest(), own, new_mark,
                _shared(own, own_leaves, new_mark, new_leaves),
                _shared(own, own_leaves, mark, leaves),
            )
        before = row, mark, leaves, known


def _comparer(batches):
    def rows():
        for batch in batches:
            for some in slices(batch):
                yield from some.to_pylist()

    names = [c.split()[0] for c in _COMPARED.split(", ")]
    held: list[tuple] = []
    for found in _compare(rows()):
        held.append(found)
        if len(held) == 500:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)))
            held = []
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)))


def compare_with_next(docs: DataFrame, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form and their likeness to each
    other and to the next document, in descending id order, the first following
    the last.

    Ids are cut into parts at quantiles; one shuffle brings each part together,
    with a copy of the first document of the part behind it as its end. Null
    texts are empty, null ids come last, equal ids are ordered by text. A
    document that is alone follows itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        column(id_name).cast("bigint").alias("_id"), whole_text(text).alias("_text")
    )
    parts = PARTS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    # At most ``parts`` numbers come back.
    bounds = np.unique(rows.approxQuantile("_id", shares, 0.1 / parts)).astype("int64")
    last = len(bounds) + 1

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        place = len(bounds) - np.searchsorted(bounds, ids.fillna(0).astype("int64"), side="left")
        return pd.Series(np.where(ids.isna(), last, place), dtype="int32")

    placed = rows.withColumn("_part", part_of("_id"))
    # One row per part: its first document, in the order used below.
    order = [F.col("_id").desc_nulls_last(), F.col("_text")]
    top = placed.groupBy("_part").agg(F.max("_id").alias("_id"))
    heads = (
        placed.join(F.broadcast(top.withColumnRenamed("_id", "_top")), "_part")
        .filter(F.col("_id").eqNullSafe(F.col("_top")))
        .groupBy("_part")
        .agg(F.min("_text").alias("_text"))
    )
    filled = sorted(r["_part"] for r in top.select("_part").collect())
    before = {part: filled[k - 1] for k, part in enumerate(filled)}
    if not filled:
        return spark.createDataFrame([], _COMPARED)
    ahead = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    ends = heads.select(
        F.lit(None).cast("bigint").alias("_id"), "_text", ahead[F.col("_part")].alias("_part"),
        F.lit(True).alias("_end"),
    )
    return (
        placed.withColumn("_end", F.lit(False))
        .unionByName(ends)
        .repartition("_part")
        .sortWithinPartitions("_part", "_end", *order)
        .mapInArrow(_comparer, _COMPARED)
    )

