"""Token ids in length-delimited binary record files with an offset index.

Format of a data file: records one after the other, each framed as

    length   8 bytes, little-endian
    masked CRC-32C of the length, 4 bytes, little-endian
    payload  ``length`` bytes: the ids, little-endian, 2 bytes each if the
             vocabulary has at most 65 536 ids, else 4
    masked CRC-32C of the payload, 4 bytes, little-endian

The index beside it holds 24 bytes per record: place of the frame, number of
ids, and id of the document, 8 bytes each, little-endian. With it a reader can
fetch records in any order.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from recordloom.llm.crc32c import crc32c_all, masked
from recordloom.llm.shared import column, small_batches, whole_text
from recordloom.session import materialise, new_folder

HEAD = struct.Struct("<QI")
ENTRY = np.dtype([("place", "<i8"), ("ids", "<i8"), ("doc_id", "<i8")])
CACHE_WORDS = 500_000  # that a worker remembers, words met long ago are forgotten
CACHE_BYTES = 32 << 20  # of these words, whatever their number
MARKS = punctuation  # of ASCII
ALPHABETS = 0x0530  # Latin, Greek and Cyrillic letters are before it
#: Pattern of vocabularies that take contractions, runs of letters, digits and runs of marks apart.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TEXTS_AT_ONCE = 500  # that are framed together
BYTES_AT_ONCE = 4 << 20  # of texts whose words are looked up together
WORDS_AT_ONCE = 64  # letters only, that go to the tokenizer as one text
SEGMENT = 16 << 20  # bytes of a data file that are read at once
NO_ID = -(1 << 63)  # stands for a null id in the index


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder all executors share, and the path in it."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def words_of(texts: pa.Array) -> pa.ListArray:
    """Pieces texts may be cut into for a vocabulary that drops white space and
    never joins across it. Only two white-space characters cut; the others stay
    inside their piece, where the tokenizer treats them."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def texts_together(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in parts of BYTES_AT_ONCE, or of one text that is longer."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, before + BYTES_AT_ONCE, side="right")), first + 1)
        yield texts.slice(first, last - first)
        first = last


class WordCoder:
    """Ids of texts as bytes, remembering the ids of words met before, in arrays.

    Words are cut into letters and closing marks where the tokenizer does so, too: then
    a word costs nothing in capitals or with another mark behind it.
    """

    def __init__(self, vocabulary: str, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.width = width
        self.ends = _word_ends(self.tokenizer)
        self.normalizer, self.pre_tokenizer = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.letters = _plain_letters(self.tokenizer, json.loads(vocabulary))
        self.block = 0
        self.words = pa.array([""])  # remembered, with their ids one behind the other,
        self.ids = np.zeros(0, width)
        self.sizes = np.zeros(1, np.int64)  # how many ids each has
        self.used = np.zeros(1, np.int64)  # and the last block each was met in

    def _parts(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Different parts of words, and the places of each word's two: lower-case letters
        and marks, or the word as it is and nothing."""
        words = words.cast(pa.string())
        core, mark = pc.utf8_rtrim(words, MARKS), pc.utf8_ltrim(words, self.letters)
        both = pc.add(pc.binary_length(core), pc.binary_length(mark))
        clean = pc.equal(both, pc.binary_length(words))  # letters up to the marks, nothing between
        first = pc.if_else(clean, pc.utf8_lower(core), words)
        coded = pa.concat_arrays([first, pc.if_else(clean, mark, "")]).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().reshape(2, -1).T.ravel()

    def _learn(self, words: pa.Array) -> None:
        """Have the tokenizer encode new words, and remember them behind the others."""
        every = words.to_numpy(zero_copy_only=False).tolist()
        lettered = np.zeros(len(every), bool)
        if self.letters:
            lettered = pc.equal(pc.utf8_ltrim(words, self.letters), "").to_numpy(zero_copy_only=False)
        together = np.flatnonzero(lettered)
        some, counts, whole = self._letters([every[i] for i in together])
        rest = np.concatenate([np.flatnonzero(~lettered), together[~whole]])
        others, more = self._ids([every[i] for i in rest])
        order = np.argsort(np.concatenate([together[whole], rest]))
        ids, upto = _gathered(np.concatenate([some, others]), np.concatenate([counts, more]), order)
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, np.diff(upto)])
        self.used = np.concatenate([self.used, np.full(len(words), self.block)])

    def _forget(self) -> None:
        """Keep the words met last, up to half of what may be remembered."""
        order = np.argsort(-self.used, kind="stable")[: CACHE_WORDS // 2]
        lengths = pc.binary_length(self.words).to_numpy().astype(np.int64)
        order = order[np.cumsum(lengths[order]) <= CACHE_BYTES // 2]
        self.words = self.words.take(pa.array(order))
        self.ids, upto = _gathered(self.ids, self.sizes, order)
        self.sizes, self.used = np.diff(upto), self.used[order]

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each has."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = chain.from_iterable(x.ids for x in found)
        return np.fromiter(ids, self.width, int(lengths.sum())), lengths

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Have the tokenizer encode words of lower-case letters, many as one text; give
        back the ids of those it does not cut, how many each has, and which words these
        are: they end where an id ends a word. Words of letters are in normal form, and
        the vocabulary's pattern would cut them at spaces."""
        runs = [words[at : at + WORDS_AT_ONCE] for at in range(0, len(words), WORDS_AT_ONCE)]
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        try:
            ids, lengths = self._ids([" ".join(run) for run in runs])
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.normalizer, self.pre_tokenizer
        last = self.ends[ids]
        upto = np.concatenate([[0], np.cumsum(last)])
        edges = np.concatenate([[0], np.cumsum(lengths)])
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        whole = np.diff(upto[edges]) == sizes
        kept = np.repeat(whole, lengths)
        stops = np.flatnonzero(last[kept]) + 1
        return ids[kept], np.diff(stops, prepend=0), np.repeat(whole, sizes)

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """The ids of each text: those of the different words of many texts are laid
        out once and gathered by the places of the words."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        for some in texts_together(texts):
            cut = words_of(some)
            coded = cut.flatten().dictionary_encode()
            parts, places = self._parts(coded.dictionary)
            self.block += 1
            found = pc.index_in(parts, value_set=self.words)
            missing = found.is_null().to_numpy(zero_copy_only=False)
            found = found.fill_null(0).to_numpy().astype(np.int64)
            self.used[found] = self.block
            if missing.any():
                found[missing] = len(self.words) + np.arange(missing.sum())
                self._learn(parts.filter(pa.array(missing)))
            ids, upto = _gathered(self.ids, self.sizes, found[places])  # of the different words
            ids, upto = _gathered(ids, np.diff(upto[::2]), coded.indices.to_numpy())
            ends = upto[np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy())])].tolist()
            for first, last in zip(ends, ends[1:], strict=False):
                yield ids[first:last].tobytes()
            if len(self.words) > CACHE_WORDS or self.words.nbytes > CACHE_BYTES:
                self._forget()


def _gathered(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids at ``places``, one behind the other, of words that have ``sizes`` ids each,
    and the bounds of the places in them."""
    counts = sizes[places]
    upto = np.concatenate([[0], np.cumsum(counts)])
    index = np.int32 if max(len(ids), upto[-1]) < 1 << 31 else np.int64
    shift = ((np.cumsum(sizes) - sizes)[places] - upto[:-1]).astype(index)
    return ids[np.repeat(shift, counts) + np.arange(upto[-1], dtype=index)], upto


def _word_ends(tokenizer: Tokenizer) -> np.ndarray:
    """Whether an id ends a word, for all ids; none does without such a suffix."""
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    names = tokenizer.get_vocab()
    ends = np.zeros(max(names.values(), default=-1) + 1, bool)
    if suffix:
        ends[[i for name, i in names.items() if name.endswith(suffix)]] = True
    return ends


def _keeps_letters(normalizer: dict | None) -> bool:
    """Whether a tokenizer file's normalizer leaves lower-case letters in normal form
    and single spaces as they are: composition, white space and case alone."""
    if normalizer is None:
        return True
    if normalizer["type"] == "Sequence":
        return all(map(_keeps_letters, normalizer["normalizers"]))
    if normalizer["type"] == "Replace":
        return (normalizer["pattern"], normalizer["content"]) == ({"Regex": r"\s+"}, " ")
    return normalizer["type"] in ("NFC", "Lowercase")


def _cuts_at_letters(pre_tokenizer: dict | None) -> bool:
    """Whether a tokenizer file takes runs of letters and runs of marks apart, and does
    nothing else with them but to write their bytes as characters."""
    match pre_tokenizer:
        case {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
            ],
        }:
            return pattern == LETTER_RUNS
    return False


def _plain_letters(tokenizer: Tokenizer, file: dict) -> str:
    """Letters whose words a tokenizer takes as they are in lower case: those that it
    turns into one letter, the one Python and Arrow turn them into. None of a tokenizer
    of another kind. No two letters before ALPHABETS compose."""
    model = file["model"]
    if not (
        model["type"] == "BPE"
        and model.get("end_of_word_suffix")
        and _keeps_letters(file.get("normalizer"))
        and _cuts_at_letters(file.get("pre_tokenizer"))
        and all(token["special"] for token in file.get("added_tokens") or [])
    ):
        return ""
    every = [c for c in map(chr, range(ALPHABETS)) if c.isalpha()]
    lower = pc.utf8_lower(pa.array(every)).to_pylist()
    turned = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    return "".join(
        c
        for c, small in zip(every, lower, strict=True)
        if turned(c) == c.lower() == small == turned(small)
        and len(small) == 1
        and len(tokenizer.pre_tokenizer.pre_tokenize_str(small + small)) == 1
    )


@lru_cache(maxsize=2)
def word_coder(vocabulary: str, width: str) -> WordCoder:
    """One coder per worker process, whose memory outlives a task."""
    return WordCoder(vocabulary, width)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    sums = crc32c_all(lengths + payloads)
    tails = sums[len(payloads) :]
    return [
        b"".join((n, struct.pack("<I", masked(a)), p, struct.pack("<I", masked(b))))
        for n, a, p, b in zip(lengths, sums, payloads, tails, strict=False)
    ]


def unframed(data: bytes) -> list[bytes]:
    """The payloads of a whole data file; a damaged one raises."""
    view, payloads, lengths, sums, at = memoryview(data), [], [], [], 0
    while at < len(data):
        length, of_length = HEAD.unpack_from(view, at)
        if at + HEAD.size + length + 4 > len(data):
            raise ValueError(f"record at {at} goes beyond the end of the file")
        lengths.append(bytes(view[at : at + 8]))
        payloads.append(bytes(view[at + HEAD.size : at + HEAD.size + length]))
        (of_payload,) = struct.unpack_from("<I", view, at + HEAD.size + length)
        sums.append((of_length, of_payload))
        at += HEAD.size + length + 4
    found = list(map(masked, crc32c_all(lengths + payloads)))
    if found != [a for a, _ in sums] + [b for _, b in sums]:
        raise ValueError("a checksum does not match")
    return payloads


def _together(batches) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of as many batches as hold BYTES_AT_ONCE: the more texts, the fewer
    different words to each."""
    held, size = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.column("_text").nbytes
        if held and (batch is None or size >= BYTES_AT_ONCE):
            yield tuple(pa.concat_arrays([x.column(c) for x in held]) for c in ("_id", "_text"))
            held, size = [], 0


def _writer(folder: str, vocabulary, end_id: int, width: str):
    def run(batches):
        files, path = opened(folder)
        coder, part = word_coder(vocabulary.value, width), TaskContext.get().partitionId()
        last = np.array([end_id], width).tobytes()
        # A name of its own for every attempt: only the one whose row is kept counts.
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        data, index, place, total = None, [], 0, 0
        for doc_ids, texts in _together(batches):
            if data is None and len(texts):
                files.create_dir(path, recursive=True)
                data = files.open_output_stream(f"{path}/{name}.rec")
            payloads = [x + last for x in coder.encode(texts)]
            for at in range(0, len(payloads), TEXTS_AT_ONCE):
                some = payloads[at : at + TEXTS_AT_ONCE]
                ids = doc_ids[at : at + TEXTS_AT_ONCE].to_pylist()
                for frame, payload, doc_id in zip(frames(some), some, ids, strict=True):
                    count = len(payload) // np.dtype(width).itemsize
                    index.append((place, count, NO_ID if doc_id is None else doc_id))
                    data.write(frame)
                    place, total = place + len(frame), total + count
        if data is not None:
            data.close()
            with files.open_output_stream(f"{path}/{name}.idx") as out:
                out.write(np.array(index, ENTRY).tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [part], "name": [name], "records": [len(index)],
                    "n_ids": [total], "n_bytes": [place],
                }
            )

    return run


_FILES = "part bigint, name string, records bigint, n_ids bigint, n_bytes bigint"


def write_records(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    id_name: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode every text, append ``end_id``, write the files in ascending id
    order, and return one row per file in ``part`` order.

    One range shuffle brings the documents into order; each of its partitions
    becomes one data file and one index. A null text is empty (its record is the
    end id alone), a null id comes first, equal ids are ordered by text. Other
    columns of ``docs`` are not read. ``vocabulary`` is the content of a
    tokenizer file of a few megabytes, and goes out as a broadcast variable.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = Tokenizer.from_str(vocabulary).get_vocab_size()
    width = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(
        column(id_name).cast("bigint").alias("_id"), whole_text(text).alias("_text")
    )
    ordered = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    shared = spark.sparkContext.broadcast(vocabulary)
    written = ordered.mapInArrow(_writer(folder, shared, end_id, width), _FILES)
    # Stored once: reading the list again must not write the files again.
    return materialise(written, "record-files").withColumn("width", F.lit(width))


def _reader(folder: str):
    def run(batches):
        files, path = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["before"]
                with files.open_input_stream(f"{path}/{row['name']}.idx") as file:
                    index = np.frombuffer(file.read(), ENTRY)
                ends = np.append(index["place"][1:], row["n_bytes"])
                with files.open_input_file(f"{path}/{row['name']}.rec") as data:
                    first = 0
                    while first < len(index):
                        place = int(index["place"][first])
                        last = int(np.searchsorted(ends, place + SEGMENT, side="right"))
                        last = max(last, first + 1)
                        payloads = unframed(data.read_at(int(ends[last - 1]) - place, place))
                        counts = index["ids"][first:last]
                        ids = [np.frombuffer(p, row["width"]).astype("<u4") for p in payloads]
                        if [len(x) for x in ids] != counts.tolist():
                            raise ValueError(f"{row['name']} does not fit its index")
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        named = index["doc_id"][first:last]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(named, mask=named == NO_ID),
                                pa.array(starts),
                                pa.array(counts),
                                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        first = last

    return run


def read_digests(written: DataFrame, folder: str) -> DataFrame:
    """Read the files back, check every frame, and return per document: doc_id,
    start (ids of all documents before it), n_tokens, ids_crc32.

    Only the list of files, one narrow row each, meets in one task; a file is then
    read by a task of its own.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # A number of its own: by size alone so few rows would be put into one task.
    files = max(1, written.count())
    return placed.repartitionByRange(files, "part").mapInArrow(
        _reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def record_digests(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the records under the shared folder and read them back."""
    folder = new_folder(docs.sparkSession, "records")
    return read_digests(write_records(docs, folder, vocabulary, end_id), folder)
