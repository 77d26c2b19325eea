"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(cut_j - w.x): one weight vector for all thresholds, cuts in ascending order. Features are words and
their prefixes, hashed; those whose share of toxic documents stands out are chosen, and x is the logarithm of one
plus a feature's count. The result is the expected severity, sum of j P(grade = j), and the probability of any toxicity.

The labels say toxic or not. Grades of severity come from these and the text: 0 is not toxic; toxic documents get 1, 2 or 3 by
how many of their words the chosen features mark, at the terciles of the sample.

Fitted on a sample of at most SAMPLE labelled rows a class (see _sample), scored on every whole text, row by row, without a
shuffle. Defined results: a null or empty text has no features, and the severity that the cuts give it; a null doc_id
stays null; repeated rows each give a row; an empty table gives an empty result; without labels of both kinds
no feature is chosen and no document is toxic. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sample import labelled
from ._shared import release, small_batches, text_slices, texts
from ._words import _LOWER, BARE, _cuts, span_hashes, spans

#: Labelled rows of either class that the model is fitted on, and the longest text among them.
SAMPLE, MAX_CHARS = 3000, 20_000
BITS, FEATURES, GRADES = 22, 4096, 4
#: Likelihood ratio that a feature needs, above what chance gives the best of 2**BITS.
EVIDENCE = 26
#: Probability of any toxicity from which on a document is rejected.
THRESHOLD = 0.35
PREFIXES = (4, 5, 6, 8)
#: Bytes of a window of a longer text.
LONG = 1 << 21
SCHEMA = "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean"


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of every occurrence of a feature, and the number of words of each text."""
    text_of, bucket = [], []
    n_words = np.zeros(len(offsets) - 1, np.int64)
    for a, part, starts, ends in spans(raw, offsets, BARE):
        low = _LOWER[part]
        doc = np.searchsorted(offsets, starts + a, "right") - 1
        n_words += np.bincount(doc, minlength=len(n_words))
        text_of.append(doc)
        bucket.append(span_hashes(low, starts, ends) >> np.uint64(64 - BITS))
        for k in PREFIXES:
            longer = ends - starts > k
            at = starts[longer]
            text_of.append(doc[longer])
            bucket.append((span_hashes(low, at, at + k) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - BITS))
    if not text_of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    return np.concatenate(text_of), np.concatenate(bucket).astype(np.int64), n_words


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def __post_init__(self) -> None:
        self.place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"buckets": self.buckets, "weights": self.weights, "cuts": self.cuts, "place": None}

    def counted(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and count of the chosen features, and the words of each text."""
        if self.place is None:
            self.place = np.full(1 << BITS, -1, np.int16)
            self.place[self.buckets] = np.arange(len(self.buckets))
        if len(offsets) == 2 and len(raw) > 2 * LONG:
            # a long text goes window by window, cut between words
            total, n_words = np.zeros(len(self.buckets), np.int64), np.zeros(1, np.int64)
            cuts = _cuts(raw, BARE, LONG)
            for a, b in zip(cuts[:-1], cuts[1:]):
                _, own, n, of = self._counted(raw[a:b], np.array([0, b - a]))
                total[own] += n
                n_words += of
            own = np.flatnonzero(total)
            return np.zeros(len(own), np.int64), own, total[own], n_words
        return self._counted(raw, offsets)

    def _counted(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        doc, bucket, n_words = features(raw, offsets)
        own = self.place[bucket]
        hit = own >= 0
        pair, count = np.unique(doc[hit] << 16 | own[hit].astype(np.int64), return_counts=True)
        return pair >> 16, pair & 0xFFFF, count, n_words

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > j) for j = 0 ... GRADES - 2 of each text."""
        doc, own, count, _ = self.counted(raw, offsets)
        score = np.bincount(doc, np.log1p(count) * self.weights[own], minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1)
        return 1 - _sigmoid(self.cuts[None, :] - score[:, None])


def choose(sample: list[str], toxic: list[int]) -> np.ndarray:
    """The buckets whose documents are toxic far more often than others, the most telling first."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    total = np.bincount(toxic, minlength=2)
    row = 0
    for _, _, raw, offsets in text_slices(pa.array(sample, pa.string())):
        doc, bucket, _ = features(raw, offsets)
        pair = np.unique(doc << BITS | bucket)
        of = np.array(toxic[row : row + len(offsets) - 1])[pair >> BITS]
        for y in (0, 1):
            np.add.at(seen[y], pair[of == y] & ((1 << BITS) - 1), 1)
        row += len(offsets) - 1
    rate = (seen + 0.5) / (total[:, None] + 1)
    some = np.flatnonzero(seen[1])
    k, n = seen[:, some].astype(np.float64), total[:, None].astype(np.float64)
    both = k.sum(axis=0) / n.sum()
    gain = 2 * (_entropy(k, n, k / n) - _entropy(k, n, both[None])).sum(axis=0)
    score = np.where(np.log(rate[1, some] / rate[0, some]) > 1, gain, 0)
    best = np.argsort(-score, kind="stable")[:FEATURES]
    return some[best[score[best] > EVIDENCE]]


def _entropy(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log likelihood of k of n at rate p."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return k * np.log(p) + (n - k) * np.log1p(-p)


def fit_ordinal(doc: np.ndarray, own: np.ndarray, x: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the cumulative-link model by Adam on the mean log likelihood, classes weighted alike."""
    n = len(grade)
    w = np.full(n_features, 0.5)
    cut = np.concatenate([[1.0], np.full(GRADES - 2, np.log(1.0))])  # the first cut, then logarithms of the steps
    toxic = max(1, int((grade > 0).sum()))
    weight = np.where(grade > 0, 0.5 / toxic, 0.5 / max(1, n - toxic))
    m = [np.zeros_like(w), np.zeros_like(cut)]
    v = [np.zeros_like(w), np.zeros_like(cut)]
    rows = np.arange(n)
    for step in range(1, steps + 1):
        score = np.bincount(doc, x * w[own], minlength=n)
        cuts = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
        below = np.column_stack([np.zeros(n), _sigmoid(cuts[None, :] - score[:, None]), np.ones(n)])
        slope = below * (1 - below)
        p = np.maximum(below[rows, grade + 1] - below[rows, grade], 1e-12)
        d_score = weight * (slope[rows, grade + 1] - slope[rows, grade]) / p
        d_cuts = np.zeros(GRADES - 1)
        for j in range(GRADES - 1):
            up, down = grade == j, grade == j + 1
            d_cuts[j] = -(weight[up] * slope[up, j + 1] / p[up]).sum() + (weight[down] * slope[down, j + 1] / p[down]).sum()
        tail = np.cumsum(d_cuts[::-1])[::-1]
        grad = [np.bincount(own, d_score[doc] * x, minlength=n_features) + decay * w, np.concatenate([tail[:1], tail[1:] * np.exp(cut[1:])])]
        for k, (theta, g) in enumerate(zip((w, cut), grad)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            theta -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w, np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> Model:
    model = _fitted(*labelled(docs, labels, "toxic", sample, max_chars))
    release()  # the sample and its features are gone, and the driver goes on
    return model


def _fitted(sampled: list[str], toxic: list[int]) -> Model:
    if len(set(toxic)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.arange(1.0, GRADES) * 20)
    model = Model(choose(sampled, toxic), np.zeros(0), np.zeros(0))
    parts, marked, row = [], [], 0
    for _, _, raw, offsets in text_slices(pa.array(sampled, pa.string())):
        doc, own, count, n_words = model.counted(raw, offsets)
        parts.append((doc + row, own, np.log1p(count)))
        marked.append(np.bincount(doc, count, minlength=len(n_words)))
        row += len(n_words)
    doc, own, x = (np.concatenate(c) for c in zip(*parts))
    del parts
    y, n_marked = np.array(toxic), np.concatenate(marked)
    grade = np.where(y > 0, 1 + np.searchsorted(np.quantile(n_marked[y > 0], [1 / 3, 2 / 3]), n_marked), 0)
    model.weights, model.cuts = fit_ordinal(doc, own, x, grade, len(model.buckets))
    return model


def severity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, expected_severity (0 to GRADES - 1), p_toxic, grade (the likeliest), and toxic: p_toxic is at least threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = [np.zeros((0, GRADES - 1))]
            for _, _, raw, offsets in text_slices(batch.column("text")):
                above.append(model.probabilities(raw, offsets))
            p = np.concatenate(above)
            each = -np.diff(np.column_stack([np.ones(len(p)), p, np.zeros(len(p))]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= threshold)], ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    return texts(docs).mapInArrow(run, SCHEMA)


def is_toxic(text: Column, model: Model, threshold: float = THRESHOLD) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flags = [np.zeros(0, bool)]
            for _, _, raw, offsets in text_slices(batch.fill_null("")):
                flags.append(model.probabilities(raw, offsets)[:, 0] >= threshold)
            yield pa.array(np.concatenate(flags))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")(text)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents that the model finds toxic."""
    small_batches(docs.sparkSession)
    return docs.where(~is_toxic(F.col("text"), model, threshold))
