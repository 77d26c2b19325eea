"""Quality by a byte-level convolutional network in numpy.

A text is bytes; each has a learned embedding and one more channel, which tells whether the four bytes from there stand
again within the next REACH bytes. Learned filters run over chunks of WIDTH bytes, each overlapping half of the last,
which cover the whole text (the end is padded with zeros). Each filter's maximum over the text goes through a rectifier into one hidden layer
and one probability. The gradient of a maximum goes to its chunk alone, so a step of training touches few chunks.

Fitted on at most SAMPLE labelled rows a class, of at most MAX_CHARS (see _sample); only rows whose crc32(doc_id as text) mod 5 isn't 0. Scored
on every whole text, row by row, without a shuffle.

Defined results: a null or empty text is one chunk of padding and gets that score; a null doc_id stays null and isn't held out;
repeated rows each give a row; an empty table gives an empty result; without labels of both kinds the score is 0.5 for all.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sample import labelled
from ._shared import text_slices, texts

WIDTH, STRIDE, REACH = 32, 16, 20
EMBEDDING, FILTERS, HIDDEN = 7, 24, 12
#: Labelled rows of either class that the network is fitted on, and the longest text among them.
SAMPLE, MAX_CHARS, EPOCHS = 800, 12_000, 16
CUT = 0.3
#: Bytes of a window of a longer text.
LONG = STRIDE << 16
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def chunk_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes + 1 of the texts, each padded with zeros to whole chunks; whether the four bytes from there come again; the first
    half-chunk of each text (one more than texts)."""
    size = np.diff(offsets)
    steps = np.maximum(1, -(-(size - STRIDE) // STRIDE)) + 1  # half-chunks; the number of chunks is one less
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(steps, out=at[1:])
    padded = np.zeros(int(at[-1]) * STRIDE, np.uint16)
    where = np.repeat(at[:-1] * STRIDE - offsets[:-1], size) + np.arange(len(raw))
    padded[where] = raw.astype(np.uint16) + 1
    again = np.zeros(len(padded), bool)
    if len(raw) > 4:
        four = raw[:-3].astype(np.uint32) | raw[1:-2].astype(np.uint32) << 8 | raw[2:-1].astype(np.uint32) << 16 | raw[3:].astype(np.uint32) << 24
        hit = np.zeros(len(raw), bool)
        for lag in range(2, REACH + 1):
            if len(four) > lag:
                hit[: len(four) - lag] |= four[lag:] == four[:-lag]
        # near a text's end what comes again may be the next text's
        tail = np.minimum(size, REACH + 4)
        near = np.repeat(offsets[1:] - np.cumsum(tail), tail) + np.arange(int(tail.sum()))
        left = np.repeat(offsets[1:], tail) - near
        hit[near] = False
        for lag in range(2, REACH + 1):
            own = near[left >= lag + 4]
            hit[own] |= four[own + lag] == four[own]
        again[where] = hit
    return padded, again, at


@dataclass
class Network:
    embedding: np.ndarray  # 257 x EMBEDDING
    filters: np.ndarray  # WIDTH * (EMBEDDING + 1) x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @staticmethod
    def random(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        f = np.float32
        return Network(rng.normal(0, 0.5, (257, EMBEDDING)).astype(f), rng.normal(0, 0.08, (WIDTH * (EMBEDDING + 1), FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(f), np.zeros(HIDDEN, f), rng.normal(0, 0.3, HIDDEN).astype(f), 0.0)

    def channels(self, padded: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Half-chunks x STRIDE * (EMBEDDING + 1)."""
        x = np.empty((len(padded), EMBEDDING + 1), np.float32)
        x[:, :EMBEDDING] = self.embedding[padded]
        x[:, EMBEDDING] = again
        return x.reshape(-1, STRIDE * (EMBEDDING + 1))

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """Chunks x FILTERS: a chunk is two half-chunks, so its response is the sum of two products."""
        half = STRIDE * (EMBEDDING + 1)
        return x[:-1] @ self.filters[:half] + x[1:] @ self.filters[half:]

    def pooled(self, padded: np.ndarray, again: np.ndarray, at: np.ndarray) -> np.ndarray:
        response = self.convolve(self.channels(padded, again))
        response = np.vstack([response, np.full((1, FILTERS), -np.inf, np.float32)])
        response[at[1:] - 1] = -np.inf  # the half-chunk that ends one text and begins the next
        return np.maximum.reduceat(response, at[:-1], axis=0)

    def pooled_windows(self, raw: np.ndarray, limit: int) -> np.ndarray:
        """pooled of one long text, window by window of limit bytes (whole half-chunks), each with the half-chunk and the bytes after it that its last chunk looks at."""
        best = np.full((1, FILTERS), -np.inf, np.float32)
        for a in range(0, len(raw), limit):
            if last := a + 2 * limit >= len(raw):
                limit = len(raw) - a
            part = raw[a : a + limit + (0 if last else 2 * WIDTH)]
            padded, again, _ = chunk_rows(part, np.array([0, len(part)]))
            response = self.convolve(self.channels(padded, again))
            best = np.maximum(best, (response if last else response[: limit // STRIDE]).max(axis=0))
            if last:
                break
        return best

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.maximum(pooled + self.bias, 0)
        h = np.maximum(a @ self.hidden + self.hidden_bias, 0)
        return a, h, 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -40, 40)))

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        if len(offsets) == 2 and len(raw) > 2 * LONG:
            return self.head(self.pooled_windows(raw, LONG))[2].astype(np.float64)
        return self.head(self.pooled(*chunk_rows(raw, offsets)))[2].astype(np.float64)


def fit_network(sample: list[str], good: list[int], epochs: int = EPOCHS, rate: float = 0.004, batch: int = 64, seed: int = 7) -> Network:
    net = Network.random(seed)
    if len(set(good)) < 2:
        net.out[:] = 0
        return net
    names = ("embedding", "filters", "bias", "hidden", "hidden_bias", "out")
    m = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    v = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    y_all = np.array(good, np.float32)
    rng = np.random.default_rng(seed)
    data = [s.encode() for s in sample]
    weight = np.where(y_all > 0, 0.5 / max(1, y_all.sum()), 0.5 / max(1, (1 - y_all).sum())) * len(y_all)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            raw = np.frombuffer(b"".join(data[j] for j in own), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(data[j]) for j in own])])
            padded, again, at = chunk_rows(raw, offsets)
            x = net.channels(padded, again)
            response = net.convolve(x)
            best = np.empty((len(own), FILTERS), np.int64)
            for d in range(len(own)):
                best[d] = at[d] + response[at[d] : at[d + 1] - 1].argmax(axis=0)
            a, h, p = net.head(response[best, np.arange(FILTERS)])
            d_out = ((p - y_all[own]) * weight[own] / len(own)).astype(np.float32)
            d_h = (d_out[:, None] * net.out) * (h > 0)
            d_a = (d_h @ net.hidden.T) * (a > 0)
            chunk = np.concatenate([x[best], x[best + 1]], axis=2)  # texts x FILTERS x WIDTH * channels
            g_filters = np.einsum("df,dfk->kf", d_a, chunk)
            d_x = (d_a[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH, EMBEDDING + 1)[:, :, :EMBEDDING]
            symbols = padded[(best.reshape(-1, 1) * STRIDE + np.arange(WIDTH))]
            g_embedding = np.zeros_like(net.embedding)
            np.add.at(g_embedding, symbols.reshape(-1), d_x.reshape(-1, EMBEDDING))
            grads = {"embedding": g_embedding, "filters": g_filters, "bias": d_a.sum(axis=0), "hidden": a.T @ d_h, "hidden_bias": d_h.sum(axis=0), "out": h.T @ d_out, "out_bias": float(d_out.sum())}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
            for k in names:
                setattr(net, k, getattr(net, k).astype(np.float32))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> Network:
    return fit_network(*labelled(docs, labels, "quality", sample, max_chars, ~held_out(F.col("doc_id"))))


def quality(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score (how likely label 1 is), predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, raw, offsets in text_slices(batch.column("text"), 1 << 19):
                scores.append(network.score(raw, offsets))
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
