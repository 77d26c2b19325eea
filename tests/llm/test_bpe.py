"""Tokenizing against the library, by brute force over odd texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkflow.llm import bpe_chunks, id_blocks
from inkflow.llm._pieces import Encoder, vocabulary
from inkflow.llm._shared import text_slices
from inkflow.llm.token_count import token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'ll", "'re", "1", "23", "!", "?!", "é", "ñ", "漢字", "́", " ", "　", "<|endoftext|>", "<|endof", "🙂", "\t", "'S", "''s", "\U00011de0", "Ᲊ", "x" * 70, "aaaa", "\0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, longest=30, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("merge", ["rank_merge", "library_merge"])
def test_encoder_equals_library(library, merge):
    texts = [*odd_texts(4000), "", "q" * 5000, "ab" * 4000]
    own = Encoder(vocabulary(PATH), getattr(vocabulary(PATH), merge), kept=500)
    got = []
    for i, j, raw, offsets in text_slices(pa.array(texts), 4096):
        ids, at = own.encode(raw, offsets)
        assert (own.counts(raw, offsets) == np.diff(at)).all()
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(j - i)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_pre_tokens_go_to_the_library_together(monkeypatch):
    """Fewer texts than pre-tokens, with the same ids as one by one."""
    vocab, sent = vocabulary(PATH), []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **more)

    library = vocab.library
    for texts in (odd_texts(3000), [" ".join("".join(chr(97 + int(c)) for c in str(i)) for i in range(5000))], [" \u00e9t\u00e9 \u2003 \u3042 \u0085x \x1cy 's 't 're"], ["a\u00a0b"]):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        starts, ends, number, _ = vocab.split(raw, np.append(0, np.cumsum([len(x.encode()) for x in texts])))
        starts, ends = starts[number < 0], ends[number < 0]
        want = vocab._apart(raw, starts, ends)
        monkeypatch.setattr(vocab, "library", Counting())
        sent.clear()
        got = vocab.library_merge(raw, starts, ends)
        monkeypatch.setattr(vocab, "library", library)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, want))
        assert len(texts) > 1 or len(starts) < 1000 or len(sent) < len(starts) / 10


@pytest.mark.parametrize("bits,least", [(3, 4), (5, 16), (9, 128)])
def test_chunks_repaired(library, monkeypatch, bits, least):
    cut = bpe_chunks.chunk_starts
    monkeypatch.setattr(bpe_chunks, "chunk_starts", lambda raw, offsets: cut(raw, offsets, bits, least))
    store = bpe_chunks.ChunkStore(PATH)
    rng = random.Random(bits)
    shared = odd_texts(40, 60, seed=9)
    texts = ["", *odd_texts(600, 80, seed=3), *(" ".join(rng.choices(shared, k=6)) for _ in range(200)), "y" * 9000, "", "word " * 3000]
    got = []
    for i, j, raw, offsets in text_slices(pa.array(texts), 20000):
        ids, at = store.encode(raw, offsets)
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(j - i)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert store.reused > 0


def test_long_texts_go_window_by_window(library, monkeypatch):
    vocab = vocabulary(PATH)
    rng = random.Random(12)
    texts = ["".join(rng.choices(["the ", "a ", "x", "  ", "é ", " 12", "\n", "漢字 ", "'ll ", "<|endoftext|>"], k=4000)), "y" * 3000 + " the end " * 500, "z" * 4000]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        parts = vocab.windows(raw, np.array([0, len(raw)]), 600)
        assert b"".join(p.tobytes() for p, _ in parts) == text.encode()
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for p, _ in parts for i in library.encode(p.tobytes().decode(), add_special_tokens=False).ids] == want
        monkeypatch.setattr("inkflow.llm._pieces.LONG", 600)
        assert Encoder(vocab, vocab.rank_merge).counts(raw, np.array([0, len(raw)])).tolist() == [len(want)]
    assert len(vocab.windows(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0].encode())]), 600)) > 5


@pytest.mark.parametrize("keep", [0xFF, 0xFFFF])
def test_hashes_may_collide(library, monkeypatch, keep):
    from inkflow.llm import _pieces
    from inkflow.llm._words import span_hashes

    short = lambda *a: span_hashes(*a) & np.uint64(keep)
    monkeypatch.setattr(_pieces, "span_hashes", short)
    monkeypatch.setattr(bpe_chunks, "span_hashes", short)
    texts = [*odd_texts(300, 40, seed=5), *(f"word{i} and{i % 7}" for i in range(300))]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for own in (Encoder(vocabulary(PATH), vocabulary(PATH).rank_merge), bpe_chunks.ChunkStore(PATH)):
        got = []
        for i, j, raw, offsets in text_slices(pa.array(texts), 300):
            ids, at = own.encode(raw, offsets)
            got += [ids[at[k] : at[k + 1]].tolist() for k in range(j - i)]
        assert got == want


def test_a_wrong_chunk_is_found_out(library):
    store = bpe_chunks.ChunkStore(PATH)
    text = " ".join(random.Random(2).choices(["some", "words", "that", "stand", "in", "a", "row"], k=900))
    raw, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    want = library.encode(text, add_special_tokens=False).ids
    assert store.encode(raw, offsets)[0].tolist() == want and store.disagreed == 0
    store.ids.all[: store.ids.n] += 1
    assert store.encode(raw, offsets)[0].tolist() == want and store.disagreed == 1


def test_chunks_move_with_their_text():
    text = "".join(random.Random(4).choices("abcdefgh ", k=20000)).encode()
    one = bpe_chunks.chunk_starts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    two = bpe_chunks.chunk_starts(np.frombuffer(b"zzz" * 77 + text, np.uint8), np.array([0, 231 + len(text)]))
    assert len(set((one + 231).tolist()) & set(two.tolist())) > 0.8 * len(one)


ROWS = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "x <|endoftext|> y"), (5, "long " * 40000), (6, "ñandú 漢字")]


def test_very_long_text(spark, library):
    text = "".join(random.Random(6).choices(["word ", "é ", "and ", "12 ", "\n"], k=2_900_000))
    assert len(text.encode()) > 9_000_000
    docs = spark.createDataFrame([(1, "a"), (2, text), (3, "b")], "doc_id long, text string")
    want = library.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: r for r in bpe_chunks.encoding_digests(docs, PATH, with_ids=True).collect()}
    assert got[2].ids == want and got[2].n_tokens == len(want)
    assert got[2].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and got[2].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == {1: 1, 2: len(want), 3: 1}
    assert {r.doc_id: r.ids for r in bpe_chunks.encode_texts(docs, PATH).collect()}[2] == want
    blocks = {r.doc_id: r for r in id_blocks.read_digests(spark, id_blocks.write_ids(docs, PATH)).collect()}
    assert blocks[2].n_tokens == len(want) + 1 and blocks[3].start == len(want) + 3
    assert blocks[2].ids_crc32 == zlib.crc32(np.array([*want, 2], "<u4").tobytes())


def test_queries_on_odd_rows(spark, library):
    docs = spark.createDataFrame([(d, t, 9, "k") for d, t in ROWS], "doc_id long, text string, n_tokens int, ids string")
    want = sorted((d or -1, library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in ROWS)
    digests = bpe_chunks.encoding_digests(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted((d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, i, t in want)
    counts = token_counts(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == sorted((d, len(t.encode()), len(i), len(i) > 1024) for d, i, t in want)
    encoded = bpe_chunks.encode_texts(docs, PATH)
    assert sorted((r.doc_id or -1, r.ids) for r in encoded.collect()) == sorted((d, i) for d, i, _ in want)
    back = bpe_chunks.decode_ids(encoded, PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((d, t) for d, _, t in want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_chunks.encoding_digests(docs, PATH).collect() == []
    assert token_counts(docs, PATH).collect() == []
