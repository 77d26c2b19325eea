"""Token ids in files of patched frame-of-reference blocks.

Ids of all texts, in ascending order of doc_id and each text's followed by an end id, are one long sequence. It is written
in blocks of BLOCK ids: a block's minimum is subtracted, the rest is packed at the width that PERCENTILE of its values fit,
and the values that don't fit go to an exception list (place and value). Blocks are written in segments; every segment has
an index of its blocks' starts, and the file's footer an index of its segments and of its documents.

Each task writes one file under a name of its own; the manifest, a table, names the files of the tasks that succeeded, so
that a task run twice leaves an unread file and no wrong one. Reading deals files over tasks.

A file: magic, segments, footer, footer's length (8 bytes), magic; all numbers little-endian. A segment: minima (u32),
widths (u8), exception counts (u8), payload starts (u32), exception places (u8), exception values (u32), payload.

Defined results: a null text counts as empty and holds the end id alone; a null doc_id comes first; repeated doc_ids each
have their own ids, in any order among themselves; an empty table gives no files and an empty result. Other columns are
not looked at.
"""

from __future__ import annotations

import io
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._pieces import bounds, encoder
from ._shared import save, shared_path, text_slices, texts

MAGIC = b"PFORID01"
BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = BLOCK * 4096
#: Bytes of text, and documents, of a file at most, about; and bytes below which there are no more files for the sake of more tasks.
FILE_BYTES, FILE_ROWS, LEAST_BYTES = 64 << 20, 1 << 20, 1 << 20
#: Distinct pre-tokens that a worker remembers: nothing else of its size is held beside them here.
KEPT = 1_500_000
#: Documents of a batch that reading yields.
READ_ROWS = 1 << 14
MANIFEST = "path string, first_id long, last_id long, n_docs long, n_ids long"


def pack_segment(ids: np.ndarray) -> bytes:
    """A segment of any number of ids (u32)."""
    n = -(-len(ids) // BLOCK)
    grid = np.empty(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[-1:] if len(ids) else 0
    grid = grid.reshape(n, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    width_of = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    k = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(width_of, k, axis=1)[:, k] if n else np.zeros(0, np.uint8)
    over = width_of > width[:, None]
    places = np.nonzero(over)[1].astype(np.uint8)
    values = rest[over]
    rest[over] = 0
    sizes = width.astype(np.int64) * (BLOCK // 8)
    at = bounds(sizes)
    payload = np.empty(int(at[-1]), np.uint8)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(rest[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        payload[at[rows][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    parts = [low.astype("<u4"), width, over.sum(axis=1).astype(np.uint8), at[:-1].astype("<u4"), places, values.astype("<u4"), payload]
    return struct.pack("<QQQ", len(ids), len(places), len(payload)) + b"".join(p.tobytes() for p in parts)


def unpack_segment(data: bytes) -> np.ndarray:
    count, n_over, n_payload = struct.unpack_from("<QQQ", data)
    n = -(-count // BLOCK)
    at = 24

    def take(kind: str, size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, size, at)
        at += out.nbytes
        return out

    low, width, n_each, starts = take("<u4", n), take("u1", n), take("u1", n), take("<u4", n)
    places, values, payload = take("u1", n_over), take("<u4", n_over), take("u1", n_payload)
    grid = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        packed = payload[starts[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
        bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        grid[rows] = np.packbits(bits, axis=2, bitorder="little").reshape(len(rows), BLOCK * 4).view("<u4")
    grid[np.repeat(np.arange(n), n_each), places] = values
    grid += low[:, None]
    return grid.reshape(-1)[:count]


def unpack_block(data: bytes, block: int) -> np.ndarray:
    """One block of a segment, found by the index of block starts."""
    count, n_over, n_payload = struct.unpack_from("<QQQ", data)
    n = -(-count // BLOCK)
    low = np.frombuffer(data, "<u4", n, 24)[block]
    w = int(np.frombuffer(data, "u1", n, 24 + 4 * n)[block])
    each = np.frombuffer(data, "u1", n, 24 + 5 * n)
    start = int(np.frombuffer(data, "<u4", n, 24 + 6 * n)[block])
    base = 24 + 10 * n
    packed = np.frombuffer(data, "u1", w * BLOCK // 8, base + 5 * n_over + start)
    bits = np.zeros((BLOCK, 32), np.uint8)
    bits[:, :w] = np.unpackbits(packed, bitorder="little").reshape(BLOCK, w)
    out = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4").copy()
    first = int(each[:block].astype(np.int64).sum())
    mine = slice(first, first + int(each[block]))
    out[np.frombuffer(data, "u1", n_over, base)[mine]] = np.frombuffer(data, "<u4", n_over, base + n_over)[mine]
    return (out + low)[: min(BLOCK, count - block * BLOCK)]


class FileWriter:
    """Writes documents one after the other; holds one segment."""

    def __init__(self, sink: io.RawIOBase) -> None:
        self.sink, self.at = sink, len(MAGIC)
        sink.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.segments: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents and their ids; without doc_ids, more ids of the last one."""
        if doc_ids:
            self.doc_ids += doc_ids
            self.lengths += lengths.tolist()
        else:
            self.lengths[-1] += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= SEGMENT_IDS:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // SEGMENT_IDS * SEGMENT_IDS
            for i in range(0, whole, SEGMENT_IDS):
                self._segment(ids[i : i + SEGMENT_IDS])
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _segment(self, ids: np.ndarray) -> None:
        data = pack_segment(ids)
        self.segments.append((self.at, len(data), len(ids)))
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_waiting:
            self._segment(np.concatenate(self.waiting))
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        names = np.array([d or 0 for d in self.doc_ids], "<i8")
        footer = struct.pack("<QQ", len(self.segments), len(names)) + np.array(self.segments, "<i8").tobytes() + names.tobytes() + known.tobytes() + np.array(self.lengths, "<i8").tobytes()
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class FileReader:
    def __init__(self, source: object, size: int) -> None:
        self.source = source
        end = len(MAGIC) + 8
        tail = self._read(size - end, end)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token ids")
        (length,) = struct.unpack("<Q", tail[:8])
        footer = self._read(size - end - length, length)
        n_segments, n = struct.unpack_from("<QQ", footer)
        self.segments = np.frombuffer(footer, "<i8", 3 * n_segments, 16).reshape(-1, 3)
        at = 16 + 24 * n_segments
        names, known = np.frombuffer(footer, "<i8", n, at), np.frombuffer(footer, "u1", n, at + 8 * n)
        self.doc_ids = [d if k else None for d, k in zip(names.tolist(), known.tolist())]
        self.lengths = np.frombuffer(footer, "<i8", n, at + 9 * n)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def parts(self) -> Iterator[np.ndarray]:
        for at, size, _ in self.segments.tolist():
            yield unpack_segment(self._read(at, size))

    def checksums(self) -> np.ndarray:
        """CRC-32 of each document's ids as little-endian u32, segment by segment."""
        ends = np.cumsum(self.lengths)
        out = np.zeros(len(ends), np.int64)
        doc, at = 0, 0
        for ids in self.parts():
            data = ids.astype("<u4").tobytes()
            done = 0
            while done < len(ids):
                upto = min(len(ids), int(ends[doc]) - at)
                out[doc] = zlib.crc32(data[4 * done : 4 * upto], int(out[doc]))
                done = upto
                if at + upto == ends[doc]:
                    doc += 1
            at += len(ids)
        return out


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, files: int | None = None) -> DataFrame:
    """Writes the files and returns the manifest (path, first_id, last_id, n_docs, n_ids, start: the ids in files before)."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-ids")
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a file for FILE_BYTES of text, more files of less while there are no more than a task's worth for each
    files = files or max(math.ceil(size / FILE_BYTES), math.ceil(rows / FILE_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / LEAST_BYTES)), 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, "library_merge", KEPT)
        system, place = _open(folder)
        system.create_dir(place, recursive=True)
        name = f"part-{uuid.uuid4().hex}.ids"
        writer = sink = None
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for i, j, raw, offsets in text_slices(batch.column("text")):
                if writer is None:
                    sink = system.open_output_stream(f"{place}/{name}")
                    writer = FileWriter(sink)
                parts = own.vocab.windows(raw, offsets)
                if len(parts) == 1:
                    ids, at = own.encode(raw, offsets)
                    writer.add(names[i:j], np.insert(ids, at[1:], end_id).astype(np.uint32), np.diff(at) + 1)
                    continue
                writer.add(names[i:j], np.zeros(0, np.uint32), np.zeros(1, np.int64))
                for part in parts:
                    writer.add([], own.encode(*part)[0].astype(np.uint32), np.zeros(0, np.int64))
                writer.add([], np.array([end_id], np.uint32), np.zeros(0, np.int64))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first_id": writer.doc_ids[0], "last_id": writer.doc_ids[-1], "n_docs": len(writer.doc_ids), "n_ids": sum(writer.lengths)}], pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # rows of one doc_id, or of none, may go to several files
    tied = texts(docs).withColumn("tie", F.xxhash64("text"))
    ranged = tied.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id").select("doc_id", "text")
    manifest = save(ranged.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                system, place = _open(path)
                with system.open_input_file(place) as source:
                    file = FileReader(source, system.get_file_info(place).size)
                    at = start + bounds(file.lengths)[:-1]
                    sums = file.checksums()
                    for i in range(0, len(sums), READ_ROWS):
                        own = slice(i, i + READ_ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[own], pa.int64()), pa.array(at[own], pa.int64()), pa.array(file.lengths[own], pa.int64()), pa.array(sums[own], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = save(manifest.select("path", "start"), "token-files")
    return files.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
