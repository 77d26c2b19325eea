"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes cuts texts into chunks, so that a passage that several documents share falls
into the same chunks wherever it stands. A worker encodes each distinct chunk once for as long as it remembers it; a hash finds a
chunk, its bytes decide. Tokens near a join may be wrong, since the chunks on both sides were encoded without each other. A safe cut is a single space
between two characters that aren't white space: a pre-token starts there whatever stands around. The stretch from a chunk's
last safe cut but one to the next one's second is encoded again, and must agree with what both chunks have between their outer and inner
cuts; a chunk without a safe cut joins the stretch. Where a join doesn't agree, the texts are encoded whole.
Rows are independent, so there is no shuffle; chunks are shared within a worker, not sent between workers, since that
would move every text twice. A long text goes window by window.

Defined results: a null text counts as empty, with no ids and an empty decoded text; repeated rows each give a row; a null
doc_id stays null; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._pieces import Growing, Vocabulary, bounds, encoder, ragged_take, same_bytes, vocabulary
from ._shared import release, text_slices, texts
from ._words import mix, span_hashes

WINDOW = 32
#: Chunks are 2**AVERAGE_BITS bytes on average and at least MIN_CHUNK.
AVERAGE_BITS, MIN_CHUNK = 9, 128
#: Ids that a worker keeps of its chunks before it starts anew.
KEPT_IDS = 4_000_000
_GEAR = mix(np.arange(1, 257, dtype=np.uint64))
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def chunk_starts(raw: np.ndarray, offsets: np.ndarray, bits: int = AVERAGE_BITS, least: int = MIN_CHUNK) -> np.ndarray:
    """Byte offsets of the chunks of the texts, each text's start among them; never within a UTF-8 character."""
    h = _GEAR[raw]
    width = 1
    while width < WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] if width < len(h) else h[:0]
        h += shifted << np.uint64(width)
        width *= 2
    cut = np.flatnonzero((h >> np.uint64(64 - bits)) == 0) + 1
    cut = cut[cut < len(raw)]
    cut = cut[(raw[cut] & 0xC0) != 0x80]
    heads = offsets[:-1][np.diff(offsets) > 0]
    # the first cut after least bytes counts; the next is sought from there
    doc = np.searchsorted(heads, cut, "right") - 1
    taken: list[int] = []
    last, now = -1, -1
    for c, d in zip(cut.tolist(), doc.tolist()):
        if d != now:
            now, last = d, int(heads[d])
        if c - last >= least:
            taken.append(c)
            last = c
    return np.unique(np.concatenate([heads, np.array(taken, np.int64)]))


class ChunkStore:
    """A worker's chunks: the bytes and ids of each, and its first two and last two safe cuts."""

    def __init__(self, path: str) -> None:
        self.encoder = encoder(path, "library_merge")
        self.seen = self.reused = self.disagreed = 0
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.bytes = Growing(np.int32), Growing(np.uint8)
        self.table = Growing(np.int64, 12)

    def place(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """The row of each chunk in table; None if two chunks have the same hash.

        A row: ids' start and number; bytes and ids before the first, the second, the last but one and the last safe cut (-1 without any); bytes' start and number.
        """
        if self.ids.n > KEPT_IDS:
            self.forget()
        size = ends - starts
        keys, sample, inverse = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        names = keys.tolist()
        place = np.array([self.known.get(k, -1) for k in names], np.int64)
        old = np.flatnonzero(place >= 0)
        rows, s, alike = self.table.all[place[old]], sample[old], sample[inverse]
        if (rows[:, 11] != size[s]).any() or (size[alike] != size).any():
            return None
        if not same_bytes(self.bytes.all, rows[:, 10], raw, starts[s], size[s]).all() or not same_bytes(raw, starts[alike], raw, starts, size).all():
            return None
        new = np.flatnonzero(place < 0)
        self.seen += len(starts)
        self.reused += len(starts) - len(new)
        if len(new):
            a, b = starts[sample[new]], ends[sample[new]]
            own = ragged_take(raw, a, b - a)
            at = bounds(b - a)
            ids, ids_at, cuts, cuts_ids = self.encoder.encode_cut(own, at)
            table = np.full((len(new), 12), -1, np.int64)
            table[:, 0] = self.ids.n + ids_at[:-1]
            table[:, 1] = np.diff(ids_at)
            lo, hi = np.searchsorted(cuts, at[:-1]), np.searchsorted(cuts, at[1:])
            has = np.flatnonzero(hi > lo)
            # with fewer than three cuts the inner ones are the outer ones, so that nothing is left between them to compare
            inner = (hi - lo)[has] > 2
            for column, cut in zip((2, 4, 6, 8), (lo[has], lo[has] + inner, hi[has] - 1 - inner, hi[has] - 1)):
                table[has, column] = cuts[cut] - at[has]
                table[has, column + 1] = cuts_ids[cut] - ids_at[has]
            table[:, 10] = self.bytes.n + at[:-1]
            table[:, 11] = b - a
            place[new] = self.table.add(table) + np.arange(len(new))
            self.ids.add(ids)
            self.bytes.add(own)
            for i in new.tolist():
                self.known[names[i]] = int(place[i])
        return place[inverse]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids start (one more than texts)."""
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        starts = chunk_starts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        place = self.place(raw, starts, ends)
        joined = None if place is None else self._joined(raw, offsets, starts, ends, self.table.all[place])
        if joined is None:
            self.disagreed += 1
            return self.encoder.encode(raw, offsets)
        return joined

    def _joined(self, raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The chunks' ids with every join encoded again; None if that doesn't agree with the chunks around a join."""
        size = ends - starts
        begins = np.isin(starts, offsets[:-1][np.diff(offsets) > 0], assume_unique=True)
        closes = np.append(begins[1:], True)
        has = t[:, 2] >= 0
        # what stays of each chunk: from its second safe cut (or the text's start) to its last but one (or the text's end)
        lo, ids_lo = np.where(begins, 0, t[:, 4]), np.where(begins, 0, t[:, 5])
        hi, ids_hi = np.where(closes, size, t[:, 6]), np.where(closes, t[:, 1], t[:, 7])
        # ids between the outer and the inner cuts are there twice, and must agree
        before, after = np.where(closes | ~has, 0, t[:, 9] - t[:, 7]), np.where(begins | ~has, 0, t[:, 5] - t[:, 3])
        alone = begins & closes
        head, tail = begins & ~has & ~alone, closes & ~has & ~alone
        hi[head] = ids_hi[head] = 0
        lo[tail], ids_lo[tail] = size[tail], t[tail, 1]
        # of a text's first chunk the ids before the inner cut stay, of its last those after it
        stays = has | begins | closes
        lo, hi, ids_lo, ids_hi = starts[stays] + lo[stays], starts[stays] + hi[stays], ids_lo[stays], ids_hi[stays]
        base, closing, before, after = t[stays, 0], closes[stays], before[stays], after[stays]
        # the stretches between are encoded again
        gap = np.flatnonzero(~closing)
        gap_len = lo[gap + 1] - hi[gap]
        again, again_at = self.encoder.encode(ragged_take(raw, hi[gap], gap_len), bounds(gap_len))
        m, n = before[gap], after[gap + 1]
        if (np.diff(again_at) < np.maximum(m, n)).any():
            return None
        left = same_bytes(again, again_at[:-1], self.ids.all, base[gap] + ids_hi[gap], m)
        right = same_bytes(again, again_at[1:] - n, self.ids.all, base[gap + 1] + ids_lo[gap + 1] - n, n)
        if not (left.all() and right.all()):
            return None
        kept_len = ids_hi - ids_lo
        kept = ragged_take(self.ids.all, base + ids_lo, kept_len)
        lengths = np.zeros(2 * len(lo), np.int64)
        lengths[::2] = kept_len
        lengths[2 * gap + 1] = np.diff(again_at)
        at = bounds(lengths)
        out = np.empty(int(at[-1]), np.int64)
        mine = np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)
        out[mine] = kept
        out[~mine] = again
        return out, at[2 * np.searchsorted(lo, offsets)] if len(lo) else np.zeros(len(offsets), np.int64)


@cache
def store(path: str) -> ChunkStore:
    return ChunkStore(path)


@cache
def decimals(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id in decimals with a comma after it: bytes, starts, lengths."""
    names = [b"%d," % i for i in range(len(vocabulary(path).words))]
    lengths = np.array([len(x) for x in names], np.int64)
    return np.frombuffer(b"".join(names), np.uint8), bounds(lengths)[:-1], lengths


def decode(vocab: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the tokens, and where each text's bytes start."""
    lengths = vocab.word_len[ids]
    data = ragged_take(vocab.word_pool, vocab.word_at[ids], lengths).tobytes()
    return data, bounds(lengths)[at]


def _as_text(data: bytes) -> bytes:
    """What decoding to a string and encoding that again makes of it: broken UTF-8 becomes U+FFFD."""
    try:
        data.decode("utf-8")
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and its token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = store(path)
        for batch in batches:
            for i, j, raw, offsets in text_slices(batch.column("text")):
                parts = [own.encode(*p) for p in own.encoder.vocab.windows(raw, offsets)]
                ids = np.concatenate([x.astype(np.int32) for x, _ in parts])
                at = parts[0][1] if len(parts) == 1 else np.array([0, len(ids)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), lists], ["doc_id", "ids"])
        release()

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.array(lists.value_lengths().fill_null(0), np.int64)
            ids = np.asarray(lists.flatten()).astype(np.int64)
            data, at = decode(vocab, ids, bounds(counts))
            cut = at.tolist()
            out = [data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of every whole text, encoded and decoded again; with_ids: and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocab = store(path), vocabulary(path)
        pool, start, length = decimals(path)
        for batch in batches:
            count, ids_sha, text_sha, lists = [], [], [], []
            for _, _, raw, offsets in text_slices(batch.column("text")):
                parts = vocab.windows(raw, offsets)
                n_texts = len(offsets) - 1
                n_ids = np.zeros(n_texts, np.int64)
                ids_hash, text_hash = ([hashlib.sha256() for _ in range(n_texts)] for _ in range(2))
                held = []
                for part in parts:  # windows of one text, or all texts
                    ids, at = own.encode(*part)
                    named_len = length[ids]
                    named = ragged_take(pool, start[ids], named_len).tobytes()
                    named_at = bounds(named_len)[at].tolist()
                    data, data_at = decode(vocab, ids, at)
                    data_at = data_at.tolist()
                    for d in range(n_texts):
                        last = part is parts[-1] and named_at[d + 1] > named_at[d]
                        ids_hash[d].update(named[named_at[d] : named_at[d + 1] - last])  # no comma after the last
                        text_hash[d].update(_as_text(data[data_at[d] : data_at[d + 1]]))
                    n_ids += np.diff(at)
                    if with_ids:
                        held.append(ids.astype(np.int32))
                count += n_ids.tolist()
                if with_ids:
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds(n_ids).astype(np.int32)), pa.array(np.concatenate(held))))
                ids_sha += [h.hexdigest() for h in ids_hash]
                text_sha += [h.hexdigest() for h in text_hash]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        release()

    return texts(docs).mapInArrow(run, DIGESTS + ", ids array<int>" * with_ids)
