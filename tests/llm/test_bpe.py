"""Byte-level BPE and token files against the tokenizers library."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulselake.llm import byte_bpe, huffman_tokens
from pulselake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "  ", "\n", "a\n", "\n\na", "a  b", "a \n b", "don't 'tis ''s 've x'll y'LL I'd'd'", " 's", "aaaaaaaaaaaaa aaaa",
    "<|endoftext|>", " <|endoftext|>  <|endoftext|><|endoftext|> a", "x y　z", "日本語 テスト 123４５ ½", "🙂🙂‍$$$", "'", "''", "'s",
]


def ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def ours(texts, coder=None):
    flat, sizes = (coder or byte_bpe.encoder(PATH)).encode(texts)
    return [part.tolist() for part in np.split(flat, np.cumsum(sizes)[:-1])]


def test_odd_texts():
    assert ours(ODD) == ids(ODD)
    assert ours(ODD, huffman_tokens.library_encoder(PATH)[0]) == ids(ODD)


def test_words_of_one_hash(monkeypatch):
    plain = byte_bpe.word_hashes
    monkeypatch.setattr(byte_bpe, "word_hashes", lambda *args: plain(*args) % np.uint64(7))
    texts = [*ODD, "w" * 700, "w" * 699 + "v", "many other words that share their hash with some of the others"]
    for coder in (byte_bpe.Encoder(*(lambda e: (e.special, e.encode_words))(byte_bpe.encoder(PATH))), huffman_tokens.library_encoder(PATH)[0]):
        coder._clear()
        for _ in range(2):
            assert ours(texts, coder) == ids(texts)
        coder._clear()


def test_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 5)
    for text in ODD:
        assert ours([text, "more words"]) == ids([text, "more words"])


def test_other_files_are_errors(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        content = json.load(file)
    changes = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": content["pre_tokenizer"] | {"add_prefix_space": True}}]
    changes += [{"added_tokens": [content["added_tokens"][0] | {"lstrip": True}]}, {"model": content["model"] | {"dropout": 0.1}}]
    for k, change in enumerate(changes):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(content | change))
        with pytest.raises(ValueError, match="no plain byte-level BPE"):
            byte_bpe.Vocabulary(str(path))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 't'sre\n\t1!é<|"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    assert ours(texts) == ids(texts)
    v = byte_bpe.vocabulary(PATH)
    for own in ids(texts):
        assert byte_bpe.decode(np.array(own, np.int64), v) == LIBRARY.decode(own, skip_special_tokens=False)


def test_decode_of_cut_characters():
    v = byte_bpe.vocabulary(PATH)
    rng = random.Random(4)
    for _ in range(300):
        some = [rng.randrange(50257) for _ in range(12)]
        assert byte_bpe.decode(np.array(some), v) == LIBRARY.decode(some, skip_special_tokens=False)


def test_query(spark, sf, read):
    texts = {r.doc_id: r.text or "" for r in read("documents").collect()}
    for r in QUERIES["op9_byte_bpe"](spark, sf).collect():
        (own,) = ids([texts[r.doc_id]])
        decoded = LIBRARY.decode(own, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_tables_round_trip(docs):
    df = docs([None, *ODD, "long " * 30000, "same", "same"], ids=[None, *range(len(ODD)), 90, 91, 91])
    coded = byte_bpe.encode_table(df, PATH)
    back = byte_bpe.decode_table(coded, PATH).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in back) == sorted(
        (r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect()
    )
    assert byte_bpe.digests(df.limit(0), PATH).count() == 0


def expected_files(rows):
    out, start = [], 0
    for i, text in sorted(rows):
        raw = np.array(ids([text or ""])[0] + [huffman_tokens.END_ID], "<u4")
        out.append((i, start, len(raw), zlib.crc32(raw.tobytes())))
        start += len(raw)
    return out


def test_token_files_query(spark, sf, read):
    rows = [(r.doc_id, r.text) for r in read("documents").collect()]
    assert sorted(map(tuple, QUERIES["op4_token_files"](spark, sf).collect())) == expected_files(rows)


def test_token_files_odd_rows(docs, monkeypatch):
    monkeypatch.setattr(huffman_tokens, "FILE_IDS", 50)
    texts = [*ODD, "long " * 3000, None]
    df = docs(texts)
    coded = huffman_tokens.encode(df, PATH)
    assert sorted(map(tuple, huffman_tokens.read(huffman_tokens.write(coded, 50257)).collect())) == expected_files(list(enumerate(texts)))
    empty = huffman_tokens.encode(df.limit(0), PATH)
    assert huffman_tokens.read(huffman_tokens.write(empty, 50257)).count() == 0


@pytest.mark.parametrize("counts", [[5], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128], [0, 3, 0, 3, 9], list(range(1, 300)), [1] * 1000])
def test_huffman_round_trip(counts):
    lengths = huffman_tokens.code_lengths(np.array(counts), limit=10)
    used = lengths[lengths > 0].astype(float)
    assert (2.0**-used).sum() <= 1 and (np.array(counts) > 0).sum() == len(used) and used.max() <= 10
    code = huffman_tokens.Code(lengths)
    sent = np.random.default_rng(0).choice(np.flatnonzero(lengths), 5000)
    bits, offsets = code.encode(sent)
    assert (code.decode(np.frombuffer(bits, np.uint8), offsets, len(sent)) == sent).all()


def test_huffman_is_optimal_when_not_limited():
    import heapq

    counts = np.random.default_rng(2).integers(1, 1000, 200)
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        cost += two
        heapq.heappush(heap, two)
    assert (huffman_tokens.code_lengths(counts, limit=30) * counts).sum() == cost


def test_file_is_independent_of_spark():
    code = huffman_tokens.Code(huffman_tokens.code_lengths(np.array([4, 3, 2, 1])))
    data = huffman_tokens.file_bytes([7, None], np.array([3, 0]), np.array([0, 1, 3]), code)
    names, sizes, found = huffman_tokens.read_bytes(data)
    assert (names, sizes.tolist(), found.tolist()) == ([7, None], [3, 0], [0, 1, 3])
    with pytest.raises(ValueError):
        huffman_tokens.read_bytes(b"something else")
    assert F is not None
