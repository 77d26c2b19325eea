"""N-gram Jaccard join: groups of texts whose word shingle sets have a Jaccard similarity of at least PERCENT / 100.

1. Each text becomes the set of its shingles, as 64-bit hashes. Texts with equal sets form a class (all link); from here on
   only classes count, so copies are never expanded. In the same pass a sketch of fixed size counts the shingles of the
   whole corpus by hash bucket.
2. All classes order their shingles alike: rare by the sketch first. Two sets of the required overlap share a shingle
   among the first n - ceil(t n) + 1 of each (prefix filter), so only these are posted to the inverted index. A list
   that the sketch says may be long is dealt over several tasks.
3. On each list a few members are queries for all others: stars, not all pairs. Every class has a sign, the parities of its shingles' counts on
   512 places; a pair whose signs differ in more places than sets of the required overlap can is no link, and no text of it moves. The queries that are left and the members that they ask for are
   dealt into blocks by the query's smallest shingle, so that near copies meet in one block and a text is sent there once for all its queries. T-occurrence
   search over the block's inverted lists decides which members reach the overlap, and links make components. While many pairs across
   components are left, there is another turn, with other queries, only on lists that still hold several components and for pairs across these.
4. Lists that then still hold several components give every pair across components that the size and position
   filters leave, in blocks of bounded size; the same search decides, and the components are joined.

T-occurrence search (Lists): a block's candidates are turned into inverted lists, a shingle's being the places of the candidates that hold it. Of the
lists of a query's shingles the L longest are set aside (DivideSkip); the others are merged with a heap that skips what can't reach T - L any
more (MergeSkip), T being the least overlap that any partner of the query's size or more or less needs; what reaches it is looked up in the long lists by binary
search. A candidate stays if its occurrences reach the overlap that its size requires. Nothing about an overlap is known before.

A pair is never left out: what isn't searched either fails a filter that proves it below the threshold, or is in one component already.

Defined results: words are what is between ASCII white space, A-Z in lower case. A null or empty text, or one without words, has an
empty set and links with nothing. Fewer words than a shingle's are one shingle. Repeated rows each give a row. Rows with a
null doc_id take part; component_id is the smallest doc_id that isn't null, and null without any. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._components import components
from ._shared import KeyFilter, Scratch, drop, join_groups, release, save, text_slices, texts
from ._words import shingles, words

#: The sketch has sixteen counters a document or more, but no more than 2**MOST_BITS of them, in chunks of CHUNK.
LEAST_BITS, MOST_BITS, CHUNK = 14, 24, 1 << 12
#: Counts are kept as STEPS times their logarithm to base 2, one byte each.
STEPS = 8
#: Members of a list, or candidates of a query, that one task handles together.
BLOCK = 4000
#: Candidates of a block of queries, and their shingles, about.
SEARCH_BLOCK, SEARCH_SHINGLES = 256, 1 << 20
#: Columns of a set's sign.
SIGN = tuple(f"sign{i}" for i in range(8))
#: Names of classes that a task remembers as posted, and pairs that it holds before it passes them on.
NAMES, HELD = 1 << 18, 1 << 16
#: Turns of stars at most, and queries on a list in each after the first; another turn needs so many pairs across components for a member.
TURNS, QUERIES, CROWDED = 3, 6, 20


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def overlap(n: int, m: int, percent: int) -> int:
    """Shared shingles that sets of n and m need: 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for _, _, raw, offsets in text_slices(column):
        hashes, at = words(raw, offsets)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(shingles(hashes[a:b], k)) if b > a else hashes[:0]


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


class Lists:
    """The inverted lists of a block of candidates (sorted arrays of distinct shingles)."""

    def __init__(self, candidates: list[np.ndarray]) -> None:
        self.sizes = np.array([len(c) for c in candidates], np.int64)
        every = np.concatenate(candidates) if candidates else np.zeros(0, np.uint64)
        places = np.repeat(np.arange(len(candidates)), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.places = every[order], places[order]
        head = np.ones(len(every), bool)
        head[1:] = every[1:] != every[:-1]
        self.shingles = every[head]
        self.at = np.append(np.flatnonzero(head), len(every))
        self.entries = (np.cumsum(head) - 1) << 32 | self.places

    def search(self, query: np.ndarray, percent: int, mu: float = 0.01) -> list[int]:
        """The places of the candidates that reach the required overlap with the query."""
        if not len(query) or not len(self.shingles):
            return []
        own = np.searchsorted(self.shingles, query)
        own = own[self.shingles[np.minimum(own, len(self.shingles) - 1)] == query]
        t = -(-percent * len(query) // 100)
        if len(own) < t:
            return []
        length = self.at[own + 1] - self.at[own]
        own = own[np.argsort(length, kind="stable")]
        n_long = max(0, min(int(t / (mu * math.log2(int(length.max()) + 1) + 1)), t - 1))
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        found = []
        for place, hits in self._merged(short, t - n_long):
            need = overlap(len(query), int(self.sizes[place]), percent)
            if hits + len(long) >= need and hits + self._probe(long, place) >= need:
                found.append(place)
        return found

    def _merged(self, short: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """Places in at least that many of the short lists, and in how many."""
        lists = [self.places[self.at[i] : self.at[i + 1]].tolist() for i in short.tolist()]
        at = [0] * len(lists)
        heap = [(x[0], i) for i, x in enumerate(lists)]
        heapq.heapify(heap)
        while len(heap) >= least:
            place = heap[0][0]
            popped = []
            while heap and heap[0][0] == place:
                popped.append(heapq.heappop(heap)[1])
            if len(popped) >= least:
                yield place, len(popped)
                upto = place + 1
            else:
                # nothing below the least-th smallest head can be in as many lists
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap)[1])
                if not heap:
                    return
                upto = heap[0][0]
            for i in popped:
                j = bisect_left(lists[i], upto, at[i])
                at[i] = j
                if j < len(lists[i]):
                    heapq.heappush(heap, (lists[i][j], i))

    def _probe(self, long: np.ndarray, place: int) -> int:
        """In how many of the long lists a place is, each searched by halves."""
        wanted = long << 32 | place
        i = np.minimum(np.searchsorted(self.entries, wanted), len(self.entries) - 1)
        return int((self.entries[i] == wanted).sum())


def sign(own: np.ndarray) -> np.ndarray:
    """For each of 64 * len(SIGN) bits whether an odd number of shingles falls on it: sets that differ in d shingles have signs that differ in at most d bits."""
    odd = np.bincount((own & np.uint64(64 * len(SIGN) - 1)).astype(np.int64), minlength=64 * len(SIGN)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _profile(docs: DataFrame, k: int, more: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, node (16 bytes that name the class), home (the smallest shingle), the sign and more (columns of 64-bit integers) of every row; and the sketch, a byte a bucket."""
    extra = ["home", *SIGN, *more]
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * docs.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "node", "chunk", "counts", *extra]
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            size, node, home, marks = [], [], [], np.zeros((len(batch), len(SIGN)), np.int64)
            for i, own in enumerate(sets(batch.column("text"), k)):
                size.append(len(own))
                node.append(digest(own) if len(own) else None)
                home.append(int(own[0].view(np.int64)) if len(own) else 0)
                marks[i] = sign(own)
                np.add.at(counts, _bucket(own, bits), 1)
            none = pa.nulls(len(size), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(node, pa.binary()), none, pa.nulls(len(size), pa.binary()), pa.array(home, pa.int64()), *(pa.array(marks[:, i].copy()) for i in range(len(SIGN))), *map(batch.column, more)], names)
        chunks = [c for c in range(len(counts) // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [pack(counts[c * CHUNK : (c + 1) * CHUNK].astype("<i8").tobytes()) for c in chunks]
        nothing = [pa.nulls(len(chunks), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(chunks, pa.int32()), pa.array(parts, pa.binary()), *[pa.nulls(len(chunks), pa.int64())] * len(extra)], names)
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for c, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                total[c] = total.get(c, 0) + np.frombuffer(unpack(part), "<i8")
        steps = [np.minimum(255, np.log2(np.maximum(x, 1)) * STEPS).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(steps, pa.binary())], ["chunk", "counts"])

    both = save(texts(docs, *more).mapInArrow(run, ", ".join(["doc_id long, n long, node binary, chunk int, counts binary", *[f"{c} long" for c in extra]])), "jaccard-profile")
    sketch = np.zeros(1 << bits, np.uint8)
    summed = both.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    for r in summed.toLocalIterator():  # as many rows as the sketch has chunks
        sketch[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(bytes(r.counts), np.uint8)
    return both.where("chunk is null").select("doc_id", "n", "node", *extra), sketch


def _postings(docs: DataFrame, k: int, percent: int, sketch: np.ndarray, block: int) -> DataFrame:
    """token, deal, deals, size, place (in the order), node: the prefixes of all classes; a task posts a class once."""
    bits = len(sketch).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            token, size, place, node, of = [], [], [], [], []
            for own in sets(batch.column("text"), k):
                if not len(own) or (name := digest(own)) in seen:
                    continue
                if len(seen) >= NAMES:
                    seen.clear()  # a class posted twice is found as one on its lists
                seen.add(name)
                often = sketch[_bucket(own, bits)]
                p = prefix_length(len(own), percent)
                first = np.lexsort((own, often))[:p]
                token.append(own[first])
                of.append(often[first])
                size.append(np.full(p, len(own), np.int32))
                place.append(np.arange(p, dtype=np.int32))
                node += [name] * p
            if token:
                deals = np.maximum(1, 2.0 ** (np.concatenate(of) / STEPS) // (block * 32)).astype(np.int64)
                deal = np.frombuffer(b"".join(n[:4] for n in node), "<u4") % deals
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(deal.astype(np.int32)), pa.array(deals.astype(np.int32)), pa.array(np.concatenate(size)), pa.array(np.concatenate(place)), pa.array(node, pa.binary())], ["token", "deal", "deals", "size", "place", "node"])
        release()

    return texts(docs).mapInArrow(run, "token long, deal int, deals int, size int, place int, node binary")


def _lists(posted: DataFrame, percent: int) -> DataFrame:
    """The postings, each class once a list, that may pass the size and position filters with another one of their list."""
    by_token = Window.partitionBy("token", "deal").orderBy("size", "node")
    once = posted.withColumn("before", F.lag("node").over(by_token)).where("before is null or before <> node").drop("before")
    near = once.withColumns({"below": F.lag("size").over(by_token), "above": F.lead("size").over(by_token), "least": F.min("size").over(by_token)})
    # the next sizes are the likeliest to be close enough, and the smallest partner that is asks for the least overlap
    close = (F.lit(100) * F.col("below") >= F.lit(percent) * F.col("size")) | (F.lit(100) * F.col("size") >= F.lit(percent) * F.col("above"))
    smallest = F.greatest("least", F.ceil(F.lit(percent) * F.col("size") / 100))
    reach = F.col("size") - F.col("place") >= F.ceil(F.lit(percent) * (F.col("size") + smallest) / F.lit(100 + percent))
    return near.where((F.col("deals") > 1) | (F.coalesce(close, F.lit(False)) & reach)).select("token", "deal", "size", "place", "node")


def _passes(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m whose common token is at places i and j can reach the overlap by sizes and places.

    The first common token of a pair is the one that counts; a pair that passes at any of its tokens is searched.
    """
    n, i, m, j = (x.astype(np.int64) for x in (n, i, m, j))
    need = -(-percent * (n + m) // (100 + percent))
    small, large = np.minimum(n, m), np.maximum(n, m)
    return (100 * small >= percent * large) & (np.minimum(n - i, m - j) >= need)


def _stars(lists: DataFrame, percent: int, queries: int, skip: int) -> DataFrame:
    """Pairs (a: a query, b) across components: on each list and range of sizes, a few members are queries for all others.

    Queries are the members with the token at the earliest places, but for the first skip of them: a set with few shingles
    that are rarer than a shared one is the likeliest to link with many others. Two sets of one range may pass the size filter.
    """
    band = F.floor(F.log("size") / math.log(100 / percent))
    by = Window.partitionBy("token", "deal", "band").orderBy("place", "node")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("size", "place", "node", "root")
    rows = lists.withColumn("band", band).select("size", "place", "node", "root", F.array(*(F.nth_value(member, i + 1).over(whole) for i in range(skip, skip + queries))).alias("heads"))

    def may(q: Column) -> Column:
        need = F.ceil(F.lit(percent) * (q["size"] + F.col("size")) / F.lit(100 + percent))
        sizes = F.lit(100) * F.least(q["size"], F.col("size")) >= F.lit(percent) * F.greatest(q["size"], F.col("size"))
        return q.isNotNull() & (q["root"] != F.col("root")) & sizes & (F.least(q["size"] - q["place"], F.col("size") - F.col("place")) >= need)

    pairs = rows.select("node", F.explode(F.filter("heads", may)).alias("q")).select(F.col("q.node").alias("a"), F.col("node").alias("b"))
    return pairs.distinct()


def _across(lists: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs across components on each list (token, blocks, mine, size, place, node, root), every pair of blocks by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            size = np.array([r[0] for r in rows])
            place = np.array([r[1] for r in rows])
            mine = np.array([r[2] for r in rows])
            roots: dict[bytes, int] = {}
            root = np.array([roots.setdefault(r[4], len(roots)) for r in rows])
            split = len(set(mine.tolist())) > 1
            for x in range(1, len(rows) + 1):
                if len(a) > HELD or x == len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                    a, b = [], []
                if x == len(rows):
                    return
                low = int(np.searchsorted(size, -(-percent * size[x] // 100)))
                near = np.arange(low, x)
                near = near[(root[near] != root[x]) & _passes(size[near], place[near], size[x], place[x], percent)]
                if split:
                    near = near[mine[near] != mine[x]]
                for y in near.tolist():
                    a.append(max(rows[x][3], rows[y][3]))
                    b.append(min(rows[x][3], rows[y][3]))

        last, held = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("token", "one", "two", "size", "place", "mine", "node", "root"))
            for token, one, two, *row in zip(*columns):
                if (token, one, two) != last:
                    if len(held) > 1:
                        yield from pairs(held)
                    last, held = (token, one, two), []
                held.append(tuple(row))
        if len(held) > 1:
            yield from pairs(held)

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = lists.select("token", "size", "place", "mine", "node", "root", other).withColumns({"one": F.least("mine", "other"), "two": F.greatest("mine", "other")})
    ordered = dealt.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "size", "node")
    return ordered.mapInArrow(run, "a binary, b binary").distinct()


def _classes(rows: DataFrame) -> DataFrame:
    """node, doc_id (the smallest of its rows), size, home and sign of each class."""
    return rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("size"), *(F.first(c).alias(c) for c in ("home", *SIGN)))


def _asked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """home, a, b, their doc_ids and b's size of those pairs (a, b) whose signs leave room for the overlap."""
    def of(side: str) -> DataFrame:
        return classes.select(*(F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in classes.columns))

    queries = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(of("a"), "a")
    both = join_groups(pairs, queries, ["a"], "n", pairs.count()).join(of("b"), "b")
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SIGN))
    sizes = F.col("a_size") + F.col("b_size")
    room = sizes - differ >= 2 * F.ceil(F.lit(percent) * sizes / F.lit(100 + percent))
    return both.where(room).select(F.col("a_home").alias("home"), "a", "a_doc_id", "b", "b_doc_id", "b_size")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, unique: bool, k: int, percent: int, search_block: int) -> DataFrame:
    """Pairs of classes that link, each of pairs (a, b) among them if it does: every a asks the blocks of its home that hold a b of it."""
    at_home = save(_asked(pairs, classes, percent), "jaccard-asked")
    members = at_home.select("home", "b", "b_size").distinct().groupBy("home").agg(F.count(F.lit(1)).alias("members"), F.sum("b_size").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / search_block, F.col("shingles") / SEARCH_SHINGLES)).cast("int").alias("blocks")
    homes = at_home.groupBy("home").agg(F.count(F.lit(1)).alias("n")).join(members, "home").select("home", "n", blocks)
    dealt = join_groups(at_home, homes, ["home"], "n", at_home.count()).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    # candidates (not asking) come first in a block
    roles = F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.col(f"{c}_doc_id").alias("doc_id"), F.lit(c == "a").alias("asks")) for c in "ab"))).alias("r")
    wanted = dealt.select("home", "block", roles).select("home", "block", "r.*").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, held, lists = None, [], [], None
        for batch in batches:
            a, b = [], []
            columns = (batch.column(c).to_pylist() for c in ("home", "block", "node", "asks"))
            for own, home, block, node, asks in zip(sets(batch.column("text"), k), *columns):
                if (home, block) != last:
                    last, names, held, lists = (home, block), [], [], None
                if digest(own) != node:
                    continue  # another text of the same doc_id
                if not asks:
                    names.append(node)
                    held.append(own)
                    continue
                if lists is None:
                    lists, held = Lists(held), []
                hits = [names[i] for i in lists.search(own, percent) if names[i] != node]
                a += [node] * len(hits)
                b += hits
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        release()

    either = [at_home.select(F.col(f"{c}_doc_id").cast("long").alias("key")) for c in "ab"]
    ordered = _with_texts(wanted, either[0].unionByName(either[1]).distinct(), docs, unique, k).repartition("home", "block").sortWithinPartitions("home", "block", "asks")
    return ordered.mapInArrow(run, "a binary, b binary")


def _with_texts(wanted: DataFrame, ids: DataFrame, docs: DataFrame, unique: bool, k: int) -> DataFrame:
    """home, block, node, asks and the text of each row (home, block, node, doc_id, asks; all doc_ids are in ids, as key); a doc_id's other texts may come too."""
    known = ids.where("key is not null")
    asked = texts(docs).where(KeyFilter(known, known.count()).maybe(F.col("doc_id").cast("long")))
    if not unique:
        asked = asked.dropDuplicates(["doc_id", "text"])
    out = asked.join(wanted, "doc_id").select("home", "block", "node", "asks", "text")
    if ids.where("key is null").isEmpty():
        return out
    nameless = wanted.where("doc_id is null")

    # classes of rows without a doc_id are found by their sets
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [digest(s) if len(s) else None for s in sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column("text")], ["node", "text"])

    there = texts(docs).where("doc_id is null").select("text").mapInArrow(named, "node binary, text string")
    there = there.join(nameless.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    return out.unionByName(there.join(nameless, "node").select("home", "block", "node", "asks", "text"))


def similar_classes(docs: DataFrame, k: int = 4, percent: int = 85, block: int = BLOCK, search_block: int = SEARCH_BLOCK, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, n, node and more) and the classes that link with others (node, root)."""
    spark = docs.sparkSession
    rows, sketch = _profile(docs, k, more)
    with Scratch(spark) as scratch:
        posted = _postings(docs, k, percent, sketch, block)
        lists = _lists(posted, percent)
        lists = save(lists, "jaccard-lists")
        classes = save(_classes(rows), "jaccard-classes")
        unique = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        tried = linked = None
        crowded, turn = True, 0
        while crowded and turn < TURNS:
            pairs = _stars(lists.withColumn("root", F.col("node")) if linked is None else lists, percent, QUERIES if turn else 1, 1 + QUERIES * (turn - 1) if turn else 0)
            pairs = pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"), "a", "b")
            if tried is not None:
                pairs = pairs.join(tried, ["x", "y"], "left_anti")
            pairs = save(pairs, "jaccard-pairs")
            tried = pairs.select("x", "y") if tried is None else tried.unionByName(pairs.select("x", "y"))
            linked = _joined(linked, _verified(pairs.select("a", "b"), classes, docs, unique, k, percent, search_block))
            lists, crowded = _still_open(lists, linked)
            turn += 1
        still = lists.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        across = _across(still, percent, block).join(tried.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")
        across = save(across, "jaccard-pairs")
        linked = _joined(linked, _verified(across, classes, docs, unique, k, percent, search_block))
        scratch.keep(linked)
    return rows, linked


def _joined(linked: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, root) of earlier ones and new links."""
    if linked is not None:
        links = linked.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(links)
    return components(links)


def _still_open(lists: DataFrame, linked: DataFrame) -> tuple[DataFrame, bool]:
    """The lists that hold several components, with each member's root and the number of members; and whether they hold so many pairs
    across components that another turn of stars is worth it."""
    rooted = lists.select("token", "deal", "size", "place", "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = save(rooted, "jaccard-rooted")
    by_root = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    several = by_root.groupBy("token").agg(F.sum("n").alias("members"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("across")).where("across > 0")
    several = save(several, "jaccard-open")
    members, across = several.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum("across"), F.lit(0.0))).first()
    return join_groups(rooted, several.select("token", "members"), ["token"], "members", max(members, 1)), across > CROWDED * members


def similar_groups(docs: DataFrame, k: int = 4, percent: int = 85, block: int = BLOCK, search_block: int = SEARCH_BLOCK) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    rows, linked = similar_classes(docs, k, percent, block, search_block)
    named = _named(rows, linked)
    full = rows.where("node is not null")
    out = join_groups(full, named, ["node"], "n_rows", full.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _named(rows: DataFrame, linked: DataFrame, *more: str) -> DataFrame:
    """node, component_id and n_rows of every class, and root if it is asked for."""
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    rooted = classes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = save(rooted.select("node", "root", "least", "n_rows"), "jaccard-classes")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return save(join_groups(rooted, least, ["root"], "n", rooted.count()).select("node", *more, "component_id", "n_rows"), "jaccard-named")


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """docs, all columns, with one document of each group of similar ones: that with the smallest doc_id. Rows with a null doc_id stay.

    A document is a doc_id with a text: rows that share a doc_id but not a text go or stay each by itself, and of those that are the smallest
    of one group one stays, whose text has the smallest hash. Rows equal in both go or stay together; exact_dedup settles these.
    """
    mark = "_text_mark"
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows, linked = similar_classes(marked, more=(mark,), **options)
    full = rows.where("node is not null and doc_id is not null")
    found = join_groups(full, _named(rows, linked, "root"), ["node"], "n_rows", full.count()).select("doc_id", mark, "root", "component_id")
    found = save(found, "jaccard-found")
    least = found.where("doc_id = component_id")
    # where several texts have a group's smallest doc_id
    ties = least.groupBy("root").agg(F.min(mark).alias("first"), F.max(mark).alias("last")).where("first <> last")
    others = least.join(ties, "root").where(F.col(mark) > F.col("first"))
    copies = save(found.where("doc_id <> component_id").select("doc_id", mark).unionByName(others.select("doc_id", mark)).distinct(), "jaccard-copies")
    key = F.xxhash64("doc_id", mark)
    maybe = KeyFilter(copies.select(key.alias("key")), copies.count()).maybe(key)
    # only rows that may be among the copies are sent to meet these
    flag = "_text_maybe"
    named = marked.where("doc_id is not null").withColumn(flag, maybe)
    some = named.where(F.col(flag)).join(copies, ["doc_id", mark], "left_anti")
    return named.where(~F.col(flag)).select(*docs.columns).unionByName(some.select(*docs.columns)).unionByName(docs.where("doc_id is null"))
