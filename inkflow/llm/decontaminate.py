"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of words (letters and digits, A-Z in lower case). A document is looked at when it shares a
run of SEED words with an item. The pair is then tiled: running Karp-Rabin finds the longest matches between words that no
tile covers yet, they are marked as tiles, and the search goes on with shorter matches down to SEED words. Tiles may
lie in any order, so a passage whose sentences were moved is covered as well. A document is contaminated by an item when
its tiles cover at least THRESHOLD of the item's words.

The items' seeds go to all tasks in parts of at most PART_BYTES; a larger benchmark means more parts, each run over all
documents. Documents aren't shuffled.

Defined results: a null text counts as empty. Items without words match nothing; an item with fewer words than a seed is
its own seed. Repeated rows and repeated items each give rows. A null doc_id or item_id stays null. Empty tables give an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import save, small_batches, text_slices, texts
from ._words import BARE, mix, powers, shingles, words

SEED = 5
THRESHOLD = 0.5
#: Bytes of benchmark text that a task holds at once.
PART_BYTES = 16 << 20
FIRST_SEARCH = 20
SCHEMA = "doc_id long, item_id long, n_tiles int, n_covered int, n_item int, coverage double, contaminated boolean"
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of size tokens, each from the running sum."""
    n = len(tokens)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * powers(_BASE, n), out=total[1:])
    return (total[size:] - total[:-size]) * powers(_INVERSE, n + 1)[: n - size + 1]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Whether no token of each window is marked."""
    total = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=total[1:])
    return total[size:] == total[:-size]


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item over a text (hashes of words): item place, text place, length."""
    least = max(1, min(least, len(item), len(text)))
    used_item, used_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(FIRST_SEARCH, len(item), len(text)))
    while True:
        matches, longest = _scan(item, text, used_item, used_text, size)
        if longest > 2 * size:
            size = longest
            continue
        for length, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            while length >= size:
                # what an earlier tile took off either end
                if used_item[p] or used_text[t]:
                    p, t, length = p + 1, t + 1, length - 1
                    continue
                taken = np.flatnonzero(used_item[p : p + length] | used_text[t : t + length])
                own = int(taken[0]) if len(taken) else length
                if own >= size:
                    used_item[p : p + own] = True
                    used_text[t : t + own] = True
                    out.append((p, t, own))
                p, t, length = p + own, t + own, length - own
        if size > 2 * least:
            size //= 2
        elif size > least:
            size = least
        else:
            return out


def _scan(item: np.ndarray, text: np.ndarray, used_item: np.ndarray, used_text: np.ndarray, size: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal matches of at least size free tokens; stops at one of more than twice that, whose length it returns."""
    mine, other = windows(item, size), windows(text, size)
    if not len(mine) or not len(other):
        return [], 0
    free_item, free_text = _free(used_item, size), _free(used_text, size)
    where: dict[int, list[int]] = {}
    for t in np.flatnonzero(free_text & np.isin(other, mine)).tolist():
        where.setdefault(int(other[t]), []).append(t)
    found, longest, seen = [], 0, set()
    for p in np.flatnonzero(free_item).tolist():
        for t in where.get(int(mine[p]), ()):
            if (p - 1, t - 1) in seen:
                seen.add((p, t))
                continue  # inside a match that began before
            k = 0
            while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not used_item[p + k] and not used_text[t + k]:
                k += 1
            if k >= size:
                seen.add((p, t))
                found.append((k, p, t))
                longest = max(longest, k)
                if k > 2 * size:
                    return found, longest
    return found, longest


class Benchmark:
    """A part of the items: their words, and the seeds of all."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.names = [i for i, _ in items]
        self.items = []
        for _, _, raw, offsets in text_slices(pa.array([t or "" for _, t in items], pa.string())):
            hashes, at = words(raw, offsets, BARE)
            self.items += [hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, own in enumerate(self.items):
            if len(own):
                by_width.setdefault(min(SEED, len(own)), []).append((np.unique(shingles(own, SEED)), i))
        for width, each in by_width.items():
            seed = np.concatenate([s for s, _ in each])
            of = np.concatenate([np.full(len(s), i) for s, i in each])
            order = np.argsort(seed, kind="stable")
            self.seeds[width] = (seed[order], of[order])

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of text and item that share a seed."""
        found = []
        for width, (seed, of) in self.seeds.items():
            if len(hashes) < width:
                continue
            own = hashes[: len(hashes) - width + 1].copy()
            for k in range(1, width):
                own = own * np.uint64(_BASE) + hashes[k : len(hashes) - width + 1 + k]
            own = mix(own + np.uint64(width))
            lo = np.searchsorted(seed, own)
            place = np.flatnonzero(seed[np.minimum(lo, len(seed) - 1)] == own)
            doc = np.searchsorted(at, place, "right") - 1
            inside = place + width <= at[doc + 1]
            for p, d in zip(place[inside].tolist(), doc[inside].tolist()):
                for j in range(int(lo[p]), len(seed)):
                    if seed[j] != own[p]:
                        break
                    found.append((d, int(of[j])))
        return sorted(set(found))

    def covered(self, hashes: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Text, item and tiles of all pairs that share a seed and reach the threshold."""
        for d, i in self.candidates(hashes, at):
            item = self.items[i]
            got = tiles(item, hashes[at[d] : at[d + 1]])
            if sum(n for _, _, n in got) >= threshold * len(item):
                yield d, i, got


def parts(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in parts of at most PART_BYTES (or one item)."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        own = len(r.text or "")
        if held and size + own > PART_BYTES:
            yield Benchmark(held)
            held, size = [], 0
        held.append((r.item_id, r.text or ""))
        size += own
    if held:
        yield Benchmark(held)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that contaminates it."""

    def of(part: Benchmark) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for first, _, raw, offsets in text_slices(batch.column("text")):
                    hashes, at = words(raw, offsets, BARE)
                    for d, i, got in part.covered(hashes, at, threshold):
                        n = sum(x for _, _, x in got)
                        rows.append((batch.column("doc_id")[first + d].as_py(), part.names[i], len(got), n, len(part.items[i]), n / len(part.items[i]), True))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "n_tiles", "n_covered", "n_item", "coverage", "contaminated"])

        return texts(docs).mapInArrow(run, SCHEMA)

    out = None
    for part in parts(benchmark):
        out = of(part) if out is None else out.unionByName(of(part))
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def is_contaminated(text: Column, part: Benchmark, threshold: float = THRESHOLD) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flags = np.zeros(len(batch), bool)
            for first, _, raw, offsets in text_slices(batch.fill_null("")):
                hashes, at = words(raw, offsets, BARE)
                for d, _, _ in part.covered(hashes, at, threshold):
                    flags[first + d] = True
            yield pa.array(flags)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents that an item contaminates."""
    small_batches(docs.sparkSession)
    first = True
    for part in parts(benchmark):
        if not first:
            docs = save(docs, "decontaminated")
        docs, first = docs.where(~is_contaminated(F.col("text"), part, threshold)), False
    return docs
