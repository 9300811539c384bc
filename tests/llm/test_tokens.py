"""Byte-level BPE and binary records against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordloom.llm import bpe, crc32c, queries, records
from recordloom.session import new_folder

RANKS = queries.rank_file()
PATTERN = public_tokenizers.PATTERN
CODER = tiktoken.Encoding(
    "plain",
    pat_str=PATTERN,
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())},
    special_tokens={},
)


def wanted(text: str) -> tuple:
    ids = CODER.encode_ordinary(text)
    written = " ".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_query_encodes_like_the_library(spark, sf_dir, texts):
    found = queries.op2_byte_bpe(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {i: wanted(t) for i, t in texts.items()}


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (1_000, 50), (bpe.CHUNK, bpe.OVERLAP)])
def test_any_chunk_size_gives_the_same_ids(edge_docs, edge_rows, chunk, overlap):
    encoded = bpe.encode(edge_docs, RANKS, PATTERN, chunk=chunk, overlap=overlap)
    both = bpe.decode(encoded, RANKS).select("n", "ids", "decoded").collect()
    places = {row[11]: row[1] or "" for row in edge_rows}
    assert len(both) == len(edge_rows)
    for row in both:
        assert row.ids == CODER.encode_ordinary(places[row.n])
        assert bytes(row.decoded) == places[row.n].encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab' \n\t.!7é你sre", max_size=120))
def test_stitched_boundaries_are_those_of_the_whole(text):
    chunk, overlap = 12, 5
    true = {m.end() for m in regex.finditer(PATTERN, text)} | {0}
    parts = []
    for start in range(0, len(text), chunk):
        window = text[start : start + chunk + overlap]
        last = start + chunk + overlap >= len(text)
        heads, tails = bpe.window_ends(window, start, last, PATTERN, chunk, overlap)
        parts.append((start, heads, tails))
    starts = bpe.cuts(parts)
    assert set(starts) <= true
    pieces = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    ids = [i for piece in pieces for i in bpe.encode_text(piece, RANKS, PATTERN).tolist()]
    assert ids == CODER.encode_ordinary(text)


def test_a_run_the_library_panics_on():
    text = " " * 2_000_000 + "a"
    ids = bpe.encode_text(text, RANKS, PATTERN)
    assert bpe.decode_ids(ids, RANKS) == text.encode()


def test_empty_table(no_docs):
    encoded = bpe.encode(no_docs, RANKS, PATTERN)
    assert encoded.count() == 0 and encoded.columns[-1] == "ids"
    assert bpe.decode(encoded, RANKS).count() == 0


def test_crc32c():
    assert crc32c.crc32c_all([b"123456789"]) == [0xE3069283]
    random = np.random.default_rng(0)
    for size in (0, 1, 3, 4, 5, 511, 512, 513, 2_000):
        data = random.bytes(size)
        state = 0xFFFFFFFF
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = (state >> 1) ^ (crc32c.POLYNOMIAL if state & 1 else 0)
        assert crc32c.crc32c_all([b"", data, data]) == [0] + [state ^ 0xFFFFFFFF] * 2
    assert crc32c.unmasked(crc32c.masked(0x12345678)) == 0x12345678


def vocabulary() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def sequence(coder: Tokenizer, text: str) -> np.ndarray:
    return np.array([*coder.encode(text, add_special_tokens=False).ids, 1], "<u4")


def test_query_reads_back_what_the_library_encodes(spark, sf_dir, texts):
    coder = Tokenizer.from_str(vocabulary())
    want, start = {}, 0
    for doc_id in sorted(texts):
        ids = sequence(coder, texts[doc_id])
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = queries.op9_binary_records(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZΣσİÉéÅ .,'!7\n\t \x1c你", max_size=40))
def test_remembered_words_give_the_ids_of_the_whole_text(text):
    coder = records.word_coder(vocabulary(), "<u4")
    (found,) = coder.encode([text])
    plain = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(found, "<u4").tolist() == plain


def test_records_of_edge_rows(spark, edge_docs, edge_rows, no_docs):
    found = records.record_digests(edge_docs, vocabulary(), 1).collect()
    ids = [row[0] for row in edge_rows]
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in found)
    in_order = sorted(found, key=lambda r: r.start)
    known = [r.doc_id for r in in_order if r.doc_id is not None]
    assert known == sorted(known) and in_order[0].doc_id is None
    ends = [r.start + r.n_tokens for r in in_order]
    assert [r.start for r in in_order] == [0, *ends[:-1]]
    assert records.record_digests(no_docs, vocabulary(), 1).count() == 0


def test_files_follow_their_format_and_damage_is_found(spark, documents):
    folder = new_folder(spark, "records-test")
    written = records.write_records(documents, folder, vocabulary(), 1)
    row = written.orderBy("part").first()
    files, path = records.opened(folder)
    with files.open_input_file(f"{path}/{row.name}.rec") as file:
        data = file.read()
    with files.open_input_file(f"{path}/{row.name}.idx") as file:
        index = np.frombuffer(file.read(), records.ENTRY)
    place, count, doc_id = index[len(index) // 2]  # a record on its own
    (length, of_length) = struct.unpack_from("<QI", data, place)
    assert of_length == crc32c.masked(crc32c.crc32c_all([data[place : place + 8]])[0])
    payload = data[place + 12 : place + 12 + length]
    assert len(payload) == 2 * count and np.frombuffer(payload, "<u2")[-1] == 1
    text = documents.filter(f"doc_id = {doc_id}").first().text
    ids = sequence(Tokenizer.from_str(vocabulary()), text)
    assert np.frombuffer(payload, "<u2").tolist() == ids.tolist()
    broken = bytearray(data)
    broken[place + 12] ^= 1
    with pytest.raises(ValueError):
        records.unframed(bytes(broken))
    with pytest.raises(ValueError):
        records.unframed(data[:-1])


def test_words_of_letters_go_to_the_tokenizer_together():
    coder = records.WordCoder(vocabulary(), "<u4")
    plain = Tokenizer.from_str(vocabulary())
    plain.encode_special_tokens = True
    odd = ["\u0130stanbul", "\u0958\u0959", "\u039f\u0394\u039f\u03a3", "\u1112\u1161\u11ab", "t\u0308x", "a</w>", "\u01c5", "\u00df."]
    texts = [f"Word{'abcdefghij'[i % 10] * (i % 7 + 1)}q other {odd[i % len(odd)]} {chr(97 + i % 26) * (i % 90)}." for i in range(1_200)]
    learnt, sent = [], []
    learn, ids = coder._learn, coder._ids
    coder._learn = lambda words: (learnt.append(len(words)), learn(words))
    coder._ids = lambda some: (sent.append(len(some)), ids(some))[1]
    found = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)]
    assert found == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(learnt) == 1 and sum(sent) < learnt[0] / 5


def test_capitals_and_marks_make_no_new_words():
    coder = records.WordCoder(vocabulary(), "<u4")
    plain = Tokenizer.from_str(vocabulary())
    list(coder.encode(["alpha βήτα гамма étude !!! %%% '"]))
    sent, ids = [], coder._ids
    coder._ids = lambda some: (sent.extend(some), ids(some))[1]
    texts = ["ALPHA!!! Βήτα%%% ГАММА' Étude!!!", "Alpha' %%% ÉTUDE"]
    found = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)]
    assert found == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert sent == []


def test_words_met_last_are_remembered(monkeypatch):
    monkeypatch.setattr(records, "CACHE_WORDS", 200)
    coder = records.WordCoder(vocabulary(), "<u4")
    plain = Tokenizer.from_str(vocabulary())
    sent, ids = [], coder._ids
    coder._ids = lambda some: (sent.extend(" ".join(some).split()), ids(some))[1]
    for block in range(20):
        text = "always " + " ".join(f"{'abcdefghij'[block % 10] * (block + 1)}{'klmnopqrst'[i % 10] * (i + 1)}" for i in range(50))
        (found,) = coder.encode([text])
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sent.count("always") == 1 and len(coder.words) <= 200
    monkeypatch.setattr(records, "CACHE_BYTES", 1_000)
    (found,) = coder.encode(["x" * 5_000 + " always"])
    assert np.frombuffer(found, "<u4").tolist()[-1:] == plain.encode("always", add_special_tokens=False).ids[-1:]
    assert coder.words.nbytes <= 1_000
