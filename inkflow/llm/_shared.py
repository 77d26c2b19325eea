"""What the operators share: tables in the cluster's shared folder and slices of Arrow text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import small_batches

#: Bytes of text that one numpy step holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 20
#: A filter of keys has sixteen bits or more for a key, but no more than 2**MOST_BITS, in chunks of 2**CHUNK_BITS.
LEAST_BITS, MOST_BITS, CHUNK_BITS = 15, 27, 15


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, the context's checkpoint folder, or in local mode one of our own."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="inkflow-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and returns the table: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _scratches:
        _scratches[-1].paths.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that save() wrote and nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            delete(spark, folder)


class Scratch:
    """Deletes what save() wrote within its with block, but for the tables that are kept."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _scratches.append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        read = [f.split(":", 1)[-1].lstrip("/") for f in table.inputFiles()]
        kept = [p for p in self.paths if any(f.startswith(p.split(":", 1)[-1].lstrip("/") + "/") for f in read)]
        self.paths = [p for p in self.paths if p not in kept]
        if len(_scratches) > 1:
            _scratches[-2].paths += kept
        return table

    def __exit__(self, *error: object) -> None:
        _scratches.remove(self)
        for path in self.paths:
            delete(self.spark, path)


_scratches: list[Scratch] = []


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns and the whole text, null as empty."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", *more, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def release() -> None:
    """Gives free memory back to the system: a Python worker outlives its task, and what it holds adds to the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, end row, their bytes, and the byte offsets of the rows in these (one more than rows)."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        wide = chunk.cast(pa.large_string())
        _, offsets, data = wide.buffers()
        off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i, n = 0, len(wide)
        while i < n:
            j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
            j = min(n, max(i + 1, j))
            yield base + i, base + j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        base += n


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", share: int = 2000) -> DataFrame:
    """rows with the columns of their group; groups has one row a key, and in column size how many of the total rows are its own.

    Groups with more than a share-th of all rows, of which there are fewer than share, are broadcast, so their rows stay
    where they are; only rows of the others are shuffled.
    """
    least = max(1000, total // share)
    hot = groups.where(F.col(size) > least)
    if total <= least or hot.isEmpty():
        return rows.join(groups, keys, how)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) <= least), keys, how)
    return cold.unionByName(rows.join(F.broadcast(hot), keys).select(*cold.columns))


class KeyFilter:
    """Which keys (longs) may be among given ones: true of each of these, and of few others while there are bits enough. It takes 16 MB at most."""

    def __init__(self, keys: DataFrame, n_keys: int) -> None:
        self.bits = min(MOST_BITS, max(LEAST_BITS, (16 * n_keys).bit_length()))
        self.table = np.zeros(1 << self.bits >> 3, np.uint8)
        size = 1 << CHUNK_BITS >> 3

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunks: dict[int, np.ndarray] = {}
            for batch in batches:
                at = np.asarray(batch.column("at"))
                for c in np.unique(at >> CHUNK_BITS).tolist():
                    inside = at[at >> CHUNK_BITS == c] & ((1 << CHUNK_BITS) - 1)
                    np.bitwise_or.at(chunks.setdefault(c, np.zeros(size, np.uint8)), inside >> 3, (1 << (inside & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array([x.tobytes() for x in chunks.values()], pa.binary())], ["chunk", "bits"])

        places = keys.select(self.place(F.col("key")).alias("at")).distinct().repartition(F.shiftright("at", CHUNK_BITS))
        for r in places.mapInArrow(pack, "chunk long, bits binary").toLocalIterator():  # no more rows than the filter has chunks
            self.table[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(bytes(r.bits), np.uint8)

    def place(self, key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.bits)

    def maybe(self, key: Column) -> Column:
        table = self.table

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                at = np.asarray(batch)
                yield pa.array(table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "boolean")(self.place(key))
