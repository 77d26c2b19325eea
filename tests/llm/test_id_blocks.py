"""Token files: blocks, files and the query against the library, as exact round trips."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkflow.llm import id_blocks
from inkflow.llm.id_blocks import BLOCK, FileReader, FileWriter, pack_segment, read_digests, unpack_block, unpack_segment, write_ids

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32])
def test_segment_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, top, n) // rng.integers(1, 50, n)).astype(np.uint32)
    data = pack_segment(ids)
    assert (unpack_segment(data) == ids).all()
    for b in range(-(-n // BLOCK)):
        assert (unpack_block(data, b) == ids[b * BLOCK : (b + 1) * BLOCK]).all()


def test_outliers_go_to_exceptions():
    ids = np.full(BLOCK * 10, 7, np.uint32)
    ids[::50] = 40000
    assert len(pack_segment(ids)) < 24 + 10 * 10 + 5 * 26 + 10 * BLOCK // 8


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(id_blocks, "SEGMENT_IDS", 256)
    docs = [np.arange(k * 37 % 901, dtype=np.uint32) * 91 % 50000 for k in range(30)]
    sink = io.BytesIO()
    writer = FileWriter(sink)
    for k, d in enumerate(docs):
        writer.add([k if k else None], d, np.array([len(d)]))
    writer.close()
    reader = FileReader(io.BytesIO(sink.getvalue()), len(sink.getvalue()))
    assert reader.doc_ids == [None, *range(1, 30)]
    assert (np.concatenate(list(reader.parts())) == np.concatenate(docs)).all()
    assert reader.checksums().tolist() == [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]


def test_against_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 101, f"some text {i} " * (i % 13) + "<|endoftext|>" * (i % 2)) for i in range(101)]
    rows += [(200, None), (201, ""), (None, "no id"), (202, "very long ñ " * 60_000)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start int, n_tokens int").repartition(6)
    got = sorted(map(tuple, read_digests(spark, write_ids(docs, PATH)).collect()), key=lambda r: -1 if r[0] is None else r[0])
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r.start for r in read_digests(spark, write_ids(docs, PATH)).collect()) == [0, 2, 4]
    assert read_digests(spark, write_ids(docs.limit(0), PATH)).collect() == []
    # many rows of one doc_id and of none, over several files
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(600)]
    manifest = write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, files=9)
    assert manifest.where("first_id is null").count() > 1 and manifest.where("first_id = 7").count() > 1
    got = sorted(read_digests(spark, manifest).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((d is not None, d or 0) for d, _ in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(600)]
