"""The pipeline against plain versions of its stages, on a small fixture with planted cases."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from inkflow.llm import toxicity
from tests.llm.test_jaccard_join import shingle_set

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def fixture(spark, folder):
    rng = random.Random(3)

    def prose(n):
        return [("".join(rng.choices("aeioubcdfglmnprst", k=rng.randint(3, 9)))) for _ in range(n)]

    items = [(i, " ".join(prose(40))) for i in range(4)]
    rows, labels, toxic = [], [], set()
    for i in range(240):
        words = prose(rng.randint(30, 150))
        if i % 6 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zidiot", "yscum", "xmoron"]))
            toxic.add(i)
        rows.append([i, " ".join(words)])
        labels.append((i, 1, int(i % 6 == 0)))
    leaked = {11: 0, 13: 1, 17: 3}
    for d, item in leaked.items():
        rows[d][1] += " " + items[item][1]
    for k in range(30):  # exact copies
        rows.append([300 + k, rows[rng.choice([1, 2, 3, 23])][1]])
    for k in range(30):  # near copies
        words = rows[rng.choice([7, 8, 9])][1].split()
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append([400 + k, " ".join(words)])
    rows += [[500, None], [501, ""], [502, "short text"]]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, toxic, items


def plain(rows, toxic, items):
    rows = [(d, t) for d, t in rows if d not in toxic]
    last = {t or "": max(d for d, u in rows if (u or "") == (t or "")) for _, t in rows}
    rows = [(d, t) for d, t in rows if last[t or ""] == d]
    sets = {d: shingle_set(t, 5) for d, t in rows}
    root = {d: d for d, _ in rows}
    while True:
        changed = False
        for a in root:
            for b in root:
                if root[a] < root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                    root[b], changed = root[a], True
        if not changed:
            break
    rows = [(d, t) for d, t in rows if root[d] == d]
    return [(d, t) for d, t in rows if not any(i in (t or "") for _, i in items)]


def test_pipeline(spark, tmp_path):
    rows, toxic, items = fixture(spark, tmp_path)
    library = Tokenizer.from_file(PATH)
    want = []
    for d, t in plain(rows, toxic, items):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns
            assert (out.count() > 0) == (given is docs)


def test_toxic_documents_go(spark, tmp_path):
    rows, toxic, _ = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in toxicity.without_toxic(docs, toxicity.fit_model(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    assert kept == {d for d, _ in rows} - toxic


def test_near_copies_by_doc_id_and_text(spark):
    rng = random.Random(6)
    text = {name: " ".join("".join(rng.choices("aeioubcdfglmnprst", k=6)) for _ in range(60)) for name in "abcd"}
    rows = [
        (1, text["a"]),
        (2, text["a"] + " more"),  # goes
        (2, text["b"]),  # shares its doc_id with a copy
        (3, text["c"]),  # one of these three stays
        (3, text["c"] + " more"),
        (3, text["c"].upper()),
        (3, text["d"]),  # a group of its own
        (4, text["c"] + " less"),  # goes
        (None, text["a"] + " less"),
        (None, text["a"] + " less"),
        (5, None),
        (5, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, "").collect()]
    of_c = [r for r in got if r in rows[3:6]]
    assert len(of_c) == 1
    assert sorted(map(str, got)) == sorted(map(str, [rows[0], rows[2], *of_c, rows[6], *rows[8:]]))
