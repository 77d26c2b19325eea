"""Exact duplicates through an extendible-hash index on shared files.

Every text gets a 64-bit key. The index has one entry a key (its rows are counted before anything is shuffled by key, so a key
that a third of all rows share is still one entry) and lies in bucket files in the shared folder. A directory over the
keys' leading bits names each key's bucket; a bucket with more entries than its capacity is split by the next bit, and
the directory doubles when such a bucket was as deep as the directory.

Buckets are in the order of their keys, and each owner task has a range of them. A row whose key may be shared is sent, with
its text, to the owner that the directory names; a filter of bounded size made from the index spares most other rows the way. The
owner takes the shared entries of its buckets from the index and chains, entry by entry, the texts that differ: a row's bytes are
compared with those of each link until one is equal, or head a new link. A row without an entry has its text alone. A key
with so many rows that they would crowd one owner is dealt over several; the heads of their links then meet in one more
such step, of one text a deal and link.

Defined results: a null text counts as empty. Rows that repeat both doc_id and text share one result each. Of rows with
a null doc_id, a row with a doc_id stays if the group has one, else keep_id is null. An empty table gives an empty result.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import KeyFilter, drop, join_groups, save, sha256_text, small_batches

#: Entries of a bucket before it is split.
CAPACITY = 1 << 14
#: The directory has at most 2**MAX_DEPTH pointers; a bucket that is still overfull there keeps its entries as a chain.
MAX_DEPTH = 20
#: Rows of one key that one owner compares at most, unless all such keys together would be more than HOT_KEYS.
CHAIN_ROWS, HOT_KEYS = 2000, 2000
#: Bytes of text that an owner task gets, about.
OWNER_BYTES = 64 << 20
OWNED = "doc_id long, key long, deal int, link int, sha string, head binary"


def text_key(text: Column, bits: int = 64) -> Column:
    """The leading bits of a hash of the text, as a long."""
    key = F.xxhash64(text)
    return key if bits >= 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def prefix(key: Column, depth: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth).cast("long")


def build_directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """The directory's depth and its buckets as (local depth, prefix).

    Counts come to the driver by prefix, a few bits at a time and only for prefixes that are still overfull, so it holds
    in the order of entries / capacity numbers.
    """
    total = entries.count()
    leaves: list[tuple[int, int]] = []
    pending = [(0, 0)] if total > capacity else []
    if not pending:
        return 0, [(0, 0)]
    depth = 0
    step = min(max_depth, max(1, math.ceil(math.log2(total / capacity)) + 1))
    while pending:
        upto = min(max_depth, depth + step)
        rows = entries
        if depth:
            wanted = entries.sparkSession.createDataFrame([(p,) for _, p in pending], "p long")
            rows = entries.join(wanted, prefix(F.col("key"), depth) == F.col("p"), "left_semi")
        counts = {r["p"]: r["n"] for r in rows.groupBy(prefix(F.col("key"), upto).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        level = {upto: counts}
        for d in range(upto - 1, depth - 1, -1):
            level[d] = {}
            for p, n in level[d + 1].items():
                level[d][p >> 1] = level[d].get(p >> 1, 0) + n
        deeper, todo = [], list(pending)
        while todo:
            d, p = todo.pop()
            if level[d].get(p, 0) <= capacity or d == max_depth:
                leaves.append((d, p))
            elif d == upto:
                deeper.append((d, p))
            else:
                todo += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        pending, depth, step = deeper, upto, 4
    return max(d for d, _ in leaves), sorted(leaves, key=lambda x: x[1] << (max_depth - x[0]))


def with_bucket(entries: DataFrame, depth: int, leaves: list[tuple[int, int]]) -> DataFrame:
    """Looks each key's bucket up in the directory: 2**depth pointers, at most 2**MAX_DEPTH."""
    if depth == 0:
        return entries.withColumn("bucket", F.lit(0))
    pointers = []
    for bucket, (d, p) in enumerate(leaves):
        pointers += [(slot, bucket) for slot in range(p << (depth - d), (p + 1) << (depth - d))]
    directory = entries.sparkSession.createDataFrame(pointers, "slot long, bucket int")
    return entries.join(F.broadcast(directory), prefix(F.col("key"), depth) == F.col("slot")).drop("slot")


@dataclass
class Index:
    """The bucket files (key, n: its rows, size: their bytes, bucket), the directory, and the filter made from them."""

    entries: DataFrame
    depth: int
    leaves: list[tuple[int, int]]
    total: int
    filter: KeyFilter
    key_bits: int

    def key(self, text: Column) -> Column:
        return text_key(text, self.key_bits)


def build_index(docs: DataFrame, key_bits: int = 64, capacity: int = CAPACITY) -> Index:
    small_batches(docs.sparkSession)
    text = whole_text()
    keyed = docs.select(text_key(text, key_bits).alias("key"), F.octet_length(text).cast("long").alias("size"))
    entries = save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "dedup-entries")
    depth, leaves = build_directory(entries, capacity)
    index = save(with_bucket(entries, depth, leaves).repartitionById(len(leaves), "bucket"), "dedup-index", ["bucket"])
    drop(docs.sparkSession, entries)
    total, n_shared = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    return Index(index, depth, leaves, total, KeyFilter(index.where("n > 1"), n_shared), key_bits)


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range of buckets by key and deal, each key's entry (which has n) first: the link of each row, -1 without an entry."""
    open_at, dealt, links = None, False, []
    for batch in batches:
        place, heads, mine = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("key", "deal", "n", "deals", "bytes"))
        for i, (key, deal, n, deals, own) in enumerate(zip(*columns)):
            if n is not None:
                open_at, dealt, links = (key, deal), deals > 1, []
                continue
            mine.append(i)
            if (key, deal) != open_at:
                place.append(-1)
                heads.append(None)
                continue
            link = next((j for j, known in enumerate(links) if known == own), len(links))
            if fresh := link == len(links):
                links.append(own)
            place.append(link)
            heads.append(own if fresh and dealt else None)
        kept = batch.select(["doc_id", "key", "deal", "sha"]).take(pa.array(mine, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column("doc_id").cast(pa.int64()), kept.column("key"), kept.column("deal"), pa.array(place, pa.int32()), kept.column("sha"), pa.array(heads, pa.binary())], ["doc_id", "key", "deal", "link", "sha", "head"])


def join_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads of one key's links in all its deals: the link that each is of the whole key."""
    last, links = None, []
    for batch in batches:
        place = []
        for key, own in zip(batch.column("key").to_pylist(), batch.column("head").to_pylist()):
            if key != last:
                last, links = key, []
            link = next((j for j, known in enumerate(links) if known == own), len(links))
            if link == len(links):
                links.append(own)
            place.append(link)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("deal"), batch.column("link"), pa.array(place, pa.int32())], ["key", "deal", "link", "of_key"])


def owned_rows(docs: DataFrame, index: Index, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """doc_id, key, link, sha of each row whose key the filter lets pass; rows of one key and link have the same text, and those of link -1 have theirs alone."""
    spark = docs.sparkSession
    shared = index.entries.where("n > 1").select("key", "n", "size", "bucket")
    bulk, crowd = shared.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(bulk / OWNER_BYTES))
    most = max(chain_rows, index.total // HOT_KEYS)
    deals = F.when(F.col("n") > most, F.ceil(F.col("n") / most)).otherwise(1).cast("int").alias("deals")
    text = whole_text()
    rows = docs.select("doc_id", index.key(text).alias("key"), sha256_text(text).alias("sha"), text.cast("binary").alias("bytes"))
    rows = with_bucket(rows.where(index.filter.maybe(F.col("key"))), index.depth, index.leaves)
    if crowd > most:
        hot = shared.where(F.col("n") > most).select("key", deals)  # fewer than HOT_KEYS
        rows = rows.join(F.broadcast(hot), "key", "left")
    else:
        rows = rows.withColumn("deals", F.lit(None).cast("int"))
    deal = F.coalesce(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("deals")), F.lit(0)).cast("int")
    rows = rows.select("key", "bucket", deal.alias("deal"), F.lit(None).cast("long").alias("n"), F.lit(1).alias("deals"), "doc_id", "sha", "bytes")
    opened = shared.select("key", "bucket", "n", deals).select("key", "bucket", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "n", "deals")
    opened = opened.select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("binary").alias("bytes"))
    owner = F.floor(F.col("bucket").cast("long") * owners / len(index.leaves)).cast("int") + F.col("deal")
    sent = rows.unionByName(opened).repartitionById(owners, owner).sortWithinPartitions("key", "deal", F.col("n").asc_nulls_last())
    owned = save(sent.select("key", "deal", "n", "deals", "doc_id", "sha", "bytes").mapInArrow(chain, OWNED), "dedup-owned")
    if crowd <= most:
        return owned.select("doc_id", "key", "link", "sha")
    heads = owned.where("head is not null").select("key", "deal", "link", "head").repartition("key").sortWithinPartitions("key", "deal", "link")
    of_key = heads.mapInArrow(join_chains, "key long, deal int, link int, of_key int")
    return owned.join(of_key, ["key", "deal", "link"], "left").select("doc_id", "key", F.coalesce("of_key", "link").alias("link"), "sha")


def _settled(docs: DataFrame, index: Index, chain_rows: int) -> DataFrame:
    """doc_id, sha, head and n of each row that the filter lets pass."""
    owned = owned_rows(docs, index, chain_rows)
    alone = owned.where("link < 0").select("doc_id", "sha", F.col("doc_id").alias("head"), F.lit(1).cast("long").alias("n"))
    linked = owned.where("link >= 0")
    groups = linked.groupBy("key", "link").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("head"))
    return join_groups(linked, groups, ["key", "link"], "n", index.total).select("doc_id", "sha", "head", "n").unionByName(alone)


def exact_groups(docs: DataFrame, key_bits: int = 64, capacity: int = CAPACITY, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """One row a document: doc_id, text_sha256, keep_id (largest doc_id of equal texts), group_size, kept."""
    index = build_index(docs, key_bits, capacity)
    found = _settled(docs, index, chain_rows).select("doc_id", F.col("sha").alias("text_sha256"), F.col("head").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("head")).alias("kept"))
    text = whole_text()
    others = docs.select("doc_id", text.alias("text")).where(~index.filter.maybe(index.key(F.col("text"))))
    return found.unionByName(others.select("doc_id", sha256_text(F.col("text")).alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))


def deduplicate(docs: DataFrame, key_bits: int = 64, capacity: int = CAPACITY, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """docs, all columns, without the copies: of equal texts the row with the largest doc_id stays, and of rows that repeat doc_id and text (null is empty) one."""
    index = build_index(docs, key_bits, capacity)
    kept = _settled(docs, index, chain_rows).where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("repeats"))
    kept = save(kept, "dedup-kept")
    text = whole_text()
    # the row travels as one column, so that no column of its own can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("whole")).withColumn("maybe", index.filter.maybe(index.key(F.col("whole"))))
    some = rows.where("maybe").select("row", F.col("row.doc_id").alias("doc_id"), sha256_text(F.col("whole")).alias("sha"))
    d, k = some.alias("d"), kept.alias("k")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.sha") == F.col("k.sha"))
    if kept.where("repeats > 1").isEmpty():
        stay = d.join(k, same, "left_semi").select("row")
    else:
        once = d.join(kept.where("repeats = 1").alias("k"), same, "left_semi").select("row")
        many = d.join(kept.where("repeats > 1").alias("k"), same, "left_semi")
        stay = once.unionByName(many.dropDuplicates(["doc_id", "sha"]).select("row"))
    return rows.where("not maybe").select("row").unionByName(stay).select("row.*")
