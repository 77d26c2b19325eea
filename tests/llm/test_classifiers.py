"""Held-out accuracy of the two fitted operators, plain-loop versions of their scores, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from inkflow.llm import byte_cnn, toxicity

ODD = [(90001, None), (90002, ""), (None, "no id here"), (5, "again"), (5, "again"), (90003, "long text " * 40_000)]


def prose(rng, n):
    return " ".join("".join(rng.choices("aeioubcdfglmnprst", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(900):
        text = prose(rng, rng.randint(20, 120))
        toxic, good = int(i % 4 == 0), 1
        if toxic:
            words = text.split()
            for _ in range(rng.choice([1, 2, 6])):
                words.insert(rng.randrange(len(words)), rng.choice(["zidiot", "yscum", "xmoron", "grackle" + prose(rng, 1)[:4]]))
            text = " ".join(words)
        elif i % 4 == 1:
            good = 0
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + rng.choice(["%%%", "$$$"]) for w in text.split()), " ".join(w for w in text.split()[:12] for _ in range(15))])
        docs.append((i, text))
        labels.append((i, good, toxic))
    d = spark.createDataFrame([(a, t, 1.0, "s") for a, t in docs + ODD], "doc_id long, text string, score double, grade string")
    return d, spark.createDataFrame([*labels, (None, 1, 1), (90001, None, None)], "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark, corpus):
    docs, labels, truth = corpus
    trained = labels.where("doc_id is null or doc_id % 3 <> 0")
    got = toxicity.severity(docs, toxicity.fit_model(docs, trained)).collect()
    assert len(got) == 900 + len(ODD)
    by_id = {r.doc_id: r for r in got}
    test = [(by_id[d], x) for d, _, x in truth if d % 3 == 0 and d != 5]
    assert np.mean([r.toxic == bool(x) for r, x in test]) > 0.97
    assert all(0 <= r.expected_severity <= 3 and r.toxic == (r.p_toxic >= toxicity.THRESHOLD) for r in got)
    assert not by_id[90001].toxic and by_id[90001].expected_severity == by_id[90002].expected_severity
    kept = toxicity.without_toxic(docs, toxicity.fit_model(docs, trained))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.toxic)


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    n = 600
    z = rng.normal(0, 2, n)
    grade = np.digitize(z + rng.logistic(0, 0.3, n), [0, 1, 2])
    doc = np.repeat(np.arange(n), 2)
    own = np.tile([0, 1], n)
    x = np.column_stack([np.maximum(z, 0), np.maximum(-z, 0)]).reshape(-1)
    w, cuts = toxicity.fit_ordinal(doc, own, x, grade, 2)
    assert w[0] > 0 and (np.diff(cuts) > 0).all()
    score = np.maximum(z, 0) * w[0] + np.maximum(-z, 0) * w[1]
    means = [score[grade == g].mean() for g in range(4)]
    assert means == sorted(means)


def test_quality(spark, corpus):
    docs, labels, truth = corpus
    got = byte_cnn.quality(docs, byte_cnn.fit(docs, labels)).collect()
    assert len(got) == 900 + len(ODD)
    by_id = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    test = [(by_id[d], q) for d, q, _ in truth if by_id[d].held_out and d != 5]
    assert np.mean([r.predicted == q for r, q in test]) > 0.95
    assert by_id[90001].score == by_id[90002].score


def test_scores_do_not_depend_on_the_slice():
    net = byte_cnn.Network.random(3)
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 50)).encode() if i % 5 else b"" for i in range(40)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    together = net.score(raw, np.cumsum([0, *map(len, texts)]))
    for t, s in zip(texts, together):
        x, again, at = byte_cnn.chunk_rows(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        padded = np.zeros(len(x), np.uint16)
        padded[: len(t)] = np.frombuffer(t, np.uint8).astype(np.uint16) + 1
        assert (x == padded).all()
        assert abs(net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] - s) < 1e-5


def plain_quality(net, text):
    """The network's score, byte by byte, filter by filter."""
    width, stride = byte_cnn.WIDTH, byte_cnn.STRIDE
    chunks = max(1, -(-(len(text) - stride) // stride))
    rows = []
    for i in range((chunks + 1) * stride):
        again = any(len(text[i : i + 4]) == 4 and text[i : i + 4] == text[i + lag : i + lag + 4] for lag in range(2, byte_cnn.REACH + 1))
        rows.append([*net.embedding[text[i] + 1 if i < len(text) else 0].astype(float), float(again)])
    pooled = []
    for f in range(byte_cnn.FILTERS):
        column = net.filters[:, f].astype(float)
        pooled.append(max(sum(a * b for a, b in zip((x for row in rows[c * stride : c * stride + width] for x in row), column)) for c in range(chunks)))
    a = [max(0.0, x + float(b)) for x, b in zip(pooled, net.bias)]
    h = [max(0.0, sum(x * float(w) for x, w in zip(a, net.hidden[:, j])) + float(net.hidden_bias[j])) for j in range(byte_cnn.HIDDEN)]
    return 1 / (1 + np.exp(-sum(x * float(w) for x, w in zip(h, net.out)) - net.out_bias))


def test_quality_against_plain_loops():
    net = byte_cnn.Network.random(5)
    rng = random.Random(6)
    texts = [b"", b"a", b"x" * 15, b"ab" * 8, b"y" * 17, b"z" * 33, *(prose(rng, rng.randint(1, 30)).encode() for _ in range(8)), b"again " * 20, "\u00fc\ud55c".encode() * 9]
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.abs(got - [plain_quality(net, t) for t in texts]).max() < 1e-5


def test_severity_against_plain_loops():
    """Counts of the chosen buckets, one occurrence at a time, and P(grade > j) from these."""
    rng = random.Random(8)
    texts = ["", *(prose(rng, rng.randint(1, 60)) for _ in range(12)), "same same SAME same"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    one_by_one = [toxicity.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1].tolist() for t in texts]
    buckets = np.array(sorted({b for own in one_by_one for b in own})[::3])
    weights = np.random.default_rng(1).normal(0, 1, len(buckets))
    model = toxicity.Model(buckets, weights, np.array([0.5, 1.5, 4.0]))
    got = model.probabilities(raw, offsets)
    for own, row in zip(one_by_one, got):
        score = 0.0
        for b, w in zip(buckets.tolist(), weights.tolist()):
            n = sum(1 for x in own if x == b)
            score += w * np.log(1 + n)
        assert np.abs(row - [1 - 1 / (1 + np.exp(-(c - score))) for c in (0.5, 1.5, 4.0)]).max() < 1e-9


def test_long_texts_go_window_by_window(monkeypatch):
    net = byte_cnn.Network.random(3)
    rng = random.Random(4)
    buckets = np.unique(np.random.default_rng(0).integers(0, 1 << toxicity.BITS, 300_000))[:30_000]
    model = toxicity.Model(buckets, np.zeros(len(buckets)), np.arange(3.0))
    for size in (50, 400, 900):
        raw = np.frombuffer(prose(rng, size).encode() + b"x" * (size % 7), np.uint8)
        whole, counted = net.score(raw, np.array([0, len(raw)])), model.counted(raw, np.array([0, len(raw)]))
        with monkeypatch.context() as m:
            m.setattr(byte_cnn, "LONG", 64)
            m.setattr(toxicity, "LONG", 100)
            assert abs(net.score(raw, np.array([0, len(raw)])) - whole).max() < 1e-6
            assert all((a == b).all() for a, b in zip(model.counted(raw, np.array([0, len(raw)])), counted))


def test_without_labels_or_rows(spark, corpus):
    docs, labels, _ = corpus
    few = docs.limit(3)
    assert [r.toxic for r in toxicity.severity(few, toxicity.fit_model(docs, labels.limit(0))).collect()] == [False] * 3
    assert {r.score for r in byte_cnn.quality(few, byte_cnn.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.severity(docs.limit(0), toxicity.fit_model(docs, labels.limit(0))).collect() == []
    assert byte_cnn.quality(docs.limit(0), byte_cnn.fit(docs, labels.limit(0))).collect() == []


def test_driver_gives_memory_back_after_the_fit(spark, monkeypatch):
    """The sample is gone when free memory is given back, not only afterwards."""
    import gc
    import weakref

    import numpy as np

    from inkflow.llm import toxicity

    alive, seen, fit = [], [], toxicity.fit_ordinal

    def watched(doc, own, x, grade, n):
        alive.append(weakref.ref(x))
        return fit(doc, own, x, grade, n)

    monkeypatch.setattr(toxicity, "fit_ordinal", watched)
    monkeypatch.setattr(toxicity, "release", lambda: (gc.collect(), seen.append(alive[-1]() is None)))
    docs = spark.createDataFrame([(i, f"word{i % 7} {'vile nasty' if i % 2 else 'kind'} more {i}") for i in range(60)], "doc_id long, text string")
    assert isinstance(toxicity.fit_model(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic")).weights, np.ndarray)
    assert seen == [True]
