"""Byte-level BPE against tiktoken; the binary format by round trips."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandline.llm import ans, bpe
from strandline.llm.queries import QUERIES

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
SIGNS = " \n\t'sabcdéñ漢字 \x1c\x85　.,!12🎉​́\x01AÉΣİ<|"


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_as_tiktoken(reference):
    codec, rng = bpe.codec(RANKS, PATTERN), random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 300, "ab" * 900, "=-" * 400, "".join(rng.choice("abcdefgh") for _ in range(2000)), "x  y", " x ", "x \n y"]
    for batch in (texts, texts[:1], texts[-1:], []):
        ids = codec.encode(pa.array(batch, pa.string()))
        for t, own, back in zip(batch, ids.to_pylist(), codec.decode(ids).to_pylist(), strict=True):
            assert np.frombuffer(own, "<u4").tolist() == reference.encode_ordinary(t), repr(t)
            assert back == t.encode()


def test_walks_of_pieces(reference):
    codec, rng = bpe.codec(RANKS, PATTERN), random.Random(4)
    words = ["".join(rng.choice("abcdeéñ漢") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    ids, offsets = codec.walk([w.encode() for w in words])
    for k, w in enumerate(words):
        want = reference.encode_ordinary(w)
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want == codec.encode_piece(w.encode().decode("latin-1"))


def test_memo_that_overflows(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHUNKS", 50)
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 300)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 3)
    with open(RANKS, "rb") as lines:
        own = bpe.BpeCodec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, PATTERN)
    texts = [f"word{k} unlikely{k % 70}ness\n" + "x y " * (k % 3) for k in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(texts)).to_pylist()] == list(map(reference.encode_ordinary, texts))


def test_pairs_as_plain_merging():
    codec, rng = bpe.codec(RANKS, PATTERN), random.Random(2)
    for _ in range(3000):
        a, b = rng.randrange(5000), rng.randrange(5000)
        assert codec.compatible(a, b) == (codec.merged(codec.vocab[a] + codec.vocab[b]) == [a, b])


def test_bpe_odd_rows(odd_docs, no_docs, reference):
    rows = bpe.decode(bpe.encode(odd_docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    assert sorted(bytes(r.decoded) for r in rows) == sorted(t.encode() for t in texts)
    assert bpe.encode(no_docs, RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 127, 128, 129, 65536, 65537, 150_000])
def test_rans_round_trip(n):
    tokens = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_000)
    table = ans.Table.of(*np.unique(tokens, return_counts=True))
    assert table.frequency.sum() == 1 << table.scale
    payload = ans.encode_chunk(tokens, table)
    assert (ans.decode_chunk(payload, table) == tokens).all()


def test_rans_one_symbol_many_symbols_and_damage():
    for ids, counts in ((np.array([7]), np.array([10])), (np.arange(300_000), np.ones(300_000, int))):
        table = ans.Table.of(ids, counts)
        tokens = np.repeat(ids, counts)[::-1]
        assert (ans.decode_chunk(ans.encode_chunk(tokens, table), table) == tokens).all()
    payload = bytearray(ans.encode_chunk(tokens, table))
    payload[-5] ^= 1
    with pytest.raises(ValueError):
        ans.decode_chunk(bytes(payload), table)
    with pytest.raises(ValueError):
        ans.decode_chunk(ans.encode_chunk(np.array([7]), ans.Table.of(np.array([7]), np.array([1]))), table)


def test_words_as_the_library():
    own, whole, rng = ans.word_tokenizer(WORDS), Tokenizer.from_file(WORDS), random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["X" * 500]
    some = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|endoftext|", "<| endoftext |>", "<|endoftext|><|startoftext|>", "<<|endoftext|>>"]
    texts += [x.replace("#", m) for m in some for x in ("#", "a # B", "A#b", " #", "# ", "é#\n# Words of its own", "# x " * 50, "\x01#\x01")]
    for t, ids in zip(texts, own.encode(pa.array(texts), 2)):
        assert np.frombuffer(ids, own.kind).tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_file_set_odd_rows(odd_docs, no_docs):
    rows = ans.round_trip(odd_docs, WORDS, 2).collect()
    assert len(rows) == odd_docs.count()
    by_start = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in by_start] == [sum(x.n_tokens for x in by_start[:k]) for k in range(len(by_start))]
    assert [r.doc_id for r in by_start] == [None, 1, 1, 2, 3, 4, 5, 6]
    assert all(len(r.tokens) == 4 * r.n_tokens for r in rows)
    assert ans.round_trip(no_docs, WORDS, 2).count() == 0


def test_query_op3(spark, sf_dir):
    whole = Tokenizer.from_file(WORDS)
    start = 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in sorted(QUERIES["op3_rans_files"](spark, sf_dir).collect(), key=lambda r: r.doc_id):
        ids = np.array([*whole.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_query_op6(spark, sf_dir, reference):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op6_byte_bpe"](spark, sf_dir).collect():
        ids = np.array(reference.encode_ordinary(docs[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
