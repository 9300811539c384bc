"""Byte-level BPE by a rank file, whole texts of any length.

Texts up to one chunk are encoded where they are. Longer ones are cut into
overlapping chunks that are dealt over the tasks and pre-tokenised side by side.
Pre-token matching has no memory: from a boundary that two neighbouring chunks
agree on, the later chunk is right. These agreed boundaries cut the text into
pieces, and the pieces are dealt out again, encoded, and put together by text.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.shared import column, slices, small_batches, whole_text

CHUNK = 32_768  # code points; texts beyond it take the chunked way
OVERLAP = 512
#: How far a match may look beyond its start: the longest fixed alternative.
LOOK = 3


#: Takes the whole of what it is given as one pre-token.
EVERYTHING = r"[\s\S]+"


@lru_cache(maxsize=8)
def _coder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def _bytes_of(ranks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens behind one another, where each starts, and how long
    it is."""
    pairs = [line.split() for line in ranks.splitlines()]
    table = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        table[int(rank)] = base64.b64decode(token)
    sizes = np.array([len(token) for token in table])
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes


def encode_text(text: str, ranks: bytes, pattern: str) -> np.ndarray:
    """The ids of one text, every match of ``pattern`` on its own."""
    try:
        return np.array(_coder(ranks, pattern).encode_ordinary(text), np.int32)
    except BaseException as problem:
        # The library's matcher panics on runs of millions of spaces; ours does not.
        if type(problem).__name__ != "PanicException":
            raise
    whole = _coder(ranks, EVERYTHING)
    pieces = (whole.encode_ordinary(m.group()) for m in regex.finditer(pattern, text))
    return np.array([i for piece in pieces for i in piece], np.int32)


def decode_ids(ids: np.ndarray, ranks: bytes) -> bytes:
    """The bytes the ids stand for, gathered at once."""
    every, starts, sizes = _bytes_of(ranks)
    own = sizes[ids]
    before = np.cumsum(own) - own
    return every[np.repeat(starts[ids] - before, own) + np.arange(own.sum())].tobytes()


def boundaries(window: str, pattern: str, last: bool) -> Iterator[int]:
    """Ends of the matches in ``window`` that more text behind it cannot change
    and at which a text may be cut: not behind white space, whose run could end
    differently if nothing followed."""
    size = len(window)
    for match in regex.finditer(pattern, window):
        end = match.end()
        if not last and (end >= size or match.start() + LOOK > size):
            return
        if not window[end - 1].isspace():
            yield end


def window_ends(
    window: str, start: int, last: bool, pattern: str, chunk: int, overlap: int
) -> tuple[list[int], list[int]]:
    """Boundaries a chunk shares with its neighbours: those in the first and
    those behind its own ``chunk`` characters, as places in the text."""
    heads, tails = [start], []
    for end in boundaries(window, pattern, last):
        if end < overlap:
            heads.append(start + end)
        elif end >= chunk:
            tails.append(start + end)
    return heads, tails


def cuts(parts: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Where the pieces of a text start, from (start, heads, tails) of its chunks.

    Where two chunks never agree (a pre-token longer than the overlap), all that
    follows is one piece: it is matched from a known boundary, so it is right too.
    """
    parts = sorted(parts)
    starts = [0]
    for (_, _, tails), (_, heads, _) in zip(parts, parts[1:], strict=False):
        agreed = set(tails) & set(heads)
        if not agreed:
            break
        starts.append(min(agreed))
    return starts


IDS = T.ArrayType(T.IntegerType(), False)


def _encoder(ranks, pattern: str, text: str, decoded: str | None):
    """Map batches: the column ``text`` becomes ``ids``, the others pass; with
    ``decoded`` the bytes of the ids follow as a column of that name."""

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text)
            names = ["ids" if i == place else n for i, n in enumerate(batch.schema.names)]
            for some in slices(batch):
                texts = some.column(place).to_pylist()
                ids = [encode_text(x, ranks.value, pattern) for x in texts]
                columns = some.columns
                columns[place] = pa.array(ids, pa.list_(pa.int32()))
                if decoded:
                    raw = [decode_ids(x, ranks.value) for x in ids]
                    columns = [*columns, pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names + [decoded] * bool(decoded))

    return run


def _encoded(df: DataFrame, text: str, ranks, pattern: str, decoded: str | None = None):
    fields = [T.StructField("ids", IDS) if f.name == text else f for f in df.schema.fields]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))
    return df.mapInArrow(_encoder(ranks, pattern, text, decoded), T.StructType(fields))


def _cutter(piece_starts: str | None, chunk: int, overlap: int):
    """Map batches (_key, text[, starts]) to (_key, start, last, window): chunks
    with their overlap, or the pieces between ``starts``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                text, size = row["_text"], len(row["_text"])
                if piece_starts:
                    starts = row[piece_starts]
                    spans = list(zip(starts, [*starts[1:], size], strict=True))
                else:
                    spans = [(s, min(size, s + chunk + overlap)) for s in range(0, size, chunk)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "_key": [row["_key"]] * len(spans),
                        "_start": pa.array([s for s, _ in spans], pa.int64()),
                        "_last": [e == size for _, e in spans],
                        "_window": [text[s:e] for s, e in spans],
                    }
                )

    return run


_WINDOWS = "_key string, _start bigint, _last boolean, _window string"


def _matcher(pattern: str, chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            found = [
                window_ends(r["_window"], r["_start"], r["_last"], pattern, chunk, overlap)
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "_key": batch.column("_key"),
                    "_start": batch.column("_start"),
                    "_heads": pa.array([h for h, _ in found], pa.list_(pa.int64())),
                    "_tails": pa.array([t for _, t in found], pa.list_(pa.int64())),
                }
            )

    return run


def _stitcher(batches):
    for batch in batches:
        rows = batch.to_pylist()
        found = [cuts([(p["s"], p["h"], p["t"]) for p in r["_parts"]]) for r in rows]
        yield pa.RecordBatch.from_pydict(
            {"_key": batch.column("_key"), "_starts": pa.array(found, pa.list_(pa.int64()))}
        )


def encode(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of their text; with ``decoded`` also
    a column of that name, the bytes the ids decode to, made in the same worker.

    A null text counts as empty and has no ids. ``ranks`` is the content of a
    rank file, under a megabyte, and goes to the workers as a broadcast variable.
    Long texts are encoded once for all their copies. A column named ``ids`` that
    ``docs`` already has is replaced; all others pass through.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    row = F.struct(*[column(n) for n in docs.columns if n not in (text, "ids")], F.lit(0))
    rows = docs.select(row.alias("_row"), whole_text(text).alias("_text"))
    is_long = F.length("_text") > chunk
    short = _encoded(rows.filter(~is_long), "_text", shared, pattern, decoded)

    long = rows.filter(is_long).withColumn("_key", F.sha2("_text", 256))
    texts = long.select("_key", "_text").dropDuplicates(["_key"])
    windows = texts.mapInArrow(_cutter(None, chunk, overlap), _WINDOWS)
    starts = (
        windows.repartition("_key", "_start")
        .mapInArrow(
            _matcher(pattern, chunk, overlap),
            "_key string, _start bigint, _heads array<bigint>, _tails array<bigint>",
        )
        .groupBy("_key")
        .agg(
            F.collect_list(
                F.struct(
                    F.col("_start").alias("s"),
                    F.col("_heads").alias("h"),
                    F.col("_tails").alias("t"),
                )
            ).alias("_parts")  # some hundred numbers per chunk of the one text
        )
        .mapInArrow(_stitcher, "_key string, _starts array<bigint>")
    )
    pieces = (
        texts.join(starts, "_key")
        .mapInArrow(_cutter("_starts", chunk, overlap), _WINDOWS)
        .repartition("_key", "_start")
        .drop("_last")
    )
    whole = (
        _encoded(pieces, "_window", shared, pattern)
        .groupBy("_key")
        .agg(F.sort_array(F.collect_list(F.struct("_start", "ids"))).alias("_pieces"))
        .select("_key", F.flatten(F.col("_pieces.ids")).alias("ids"))
    )
    joined = long.drop("_text").join(whole, "_key").select("_row", "ids")
    if decoded:
        joined = decode(joined, ranks, name=decoded)
    names = [
        F.col("_row")[n].alias(n) for n in docs.columns if n not in (text, "ids", decoded)
    ]
    made = ["ids", decoded] if decoded else ["ids"]
    return short.select("_row", *made).unionByName(joined).select(*names, *made)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the bytes ``name`` that the ids stand for; null ids have none."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                rows = some.column(some.schema.get_field_index(ids))
                raw = [
                    decode_ids(row.values.to_numpy(), shared.value) if row.is_valid else None
                    for row in rows
                ]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(raw, pa.binary())], [*some.schema.names, name]
                )

    return df.mapInArrow(run, schema)


def with_digests(df: DataFrame) -> DataFrame:
    """Add the count of ``ids``, the digest of the ids in decimal, and that of
    ``decoded``."""
    return df.withColumns(
        {
            "n_tokens": F.size("ids").cast("bigint"),
            "ids_sha256": F.sha2(
                F.concat_ws(" ", F.col("ids").cast("array<string>")), 256
            ),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    )


def digests(docs: DataFrame, ranks: bytes, pattern: str, id_name: str = "doc_id") -> DataFrame:
    """Encode and decode; counts and digests of both, one row per document."""
    narrow = docs.select(column(id_name).alias("doc_id"), column("text"))
    both = with_digests(encode(narrow, ranks, pattern, decoded="decoded"))
    return both.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
