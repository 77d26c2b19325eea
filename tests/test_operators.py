"""Operators against plain loops over small random tables."""

import random

import pytest
from collections import defaultdict

from pyspark.sql import functions as F

from inkflow.operators import assets, grid, order, relate


def by_key(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return {k: sorted(v, key=lambda x: x[1]) for k, v in out.items()}


def test_islands(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), i, rng.choice(["a", "b", None])) for i in range(120)]
    got = {(r.k, r.i): r.island for r in order.islands(spark.createDataFrame(rows, "k int, i int, v string"), ["k"], ["i"], F.col("v")).collect()}
    for k, group in by_key(rows).items():
        n, last = 0, object()
        for _, i, v in group:
            n, last = (n if v == last else n + 1), v
            assert got[k, i] == n


def test_level_markers(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), i, rng.choice([0, 1, 2, 3, 9, 10, 11, 12]), rng.random() < 0.8) for i in range(300)]
    got = {(r.k, r.i): r.marker for r in order.level_markers(spark.createDataFrame(rows, "k int, i int, level int, ordered boolean"), ["k"], "i").collect()}
    for k, group in by_key(rows).items():
        counts = {}
        for _, i, level, ordered in group:
            if ordered:
                counts = {x: n for x, n in counts.items() if x <= level}
                counts[level] = counts.get(level, 0) + 1
                assert got[k, i] == counts[level]
            else:
                counts.pop(level, None)
                assert got[k, i] is None


def test_spacers_and_quota_and_pages(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 2), i, rng.choice(["blank", "blank", "hr", "para"]), rng.randint(1, 9)) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, i int, type string, size int")
    kept = {(r.k, r.i) for r in order.without_spacers(df, ["k"], "i").collect()}
    taken = {(r.k, r.i): r.accepted for r in order.greedy_quota(df, ["k"], "i", "size", 7, 40).collect()}
    pages = {(r.k, r.i): r.page for r in order.paginate(df, ["k"], "i", "size", 12).collect()}
    for k, group in by_key(rows).items():
        used = page = height = 0
        for n, (_, i, kind, size) in enumerate(group):
            before = next((x[2] for x in reversed(group[:n]) if x[2] != "blank"), None)
            after = next((x[2] for x in group[n + 1 :] if x[2] != "blank"), None)
            assert ((k, i) in kept) == (kind != "blank" or "hr" not in (before, after))
            fits = size <= 7 and used + size <= 40
            used += size * fits
            assert taken[k, i] == fits
            if height and height + size > 12:
                page, height = page + 1, 0
            height += size
            assert pages[k, i] == page


def test_titles(spark):
    blocks = spark.createDataFrame([(k, n, 0, t, lv, x, str(n)) for k, own in {1: [("heading", 1, "목차"), ("heading", 1, "Real"), ("para", None, "x")], 2: [("para", None, "Parsed"), ("heading", 1, "Parsed")], 3: [("para", None, " ")], 4: [("heading", 2, "Kept")], 5: [("heading", 1, "Same")]}.items() for n, (t, lv, x) in enumerate(own)], "k int, pos int, depth int, type string, level int, text string, block_id string")
    blocks = blocks.withColumn("runs", F.lit(None).cast("array<struct<text:string>>"))
    docs = spark.createDataFrame([(1, "Contents", "md", "f1"), (2, "Parsed", "md", "f2"), (3, "", "txt", "f3"), (4, "Doc", "docx", "f4"), (5, "Gone title", "md", "f5")], "k int, title string, ext string, file_base string")
    titled = order.titles(docs, blocks, "k", F.when(F.col("k") == 5, " Asked  for "), F.lit("document"))
    assert {r.k: (r.title, r.title_source) for r in titled.collect()} == {1: ("Real", "first"), 2: ("Parsed", "parsed"), 3: ("f3", "filename"), 4: ("Kept", "first"), 5: ("Asked for", "custom")}
    assert {r.k: (r.title, r.title_source) for r in order.titles(docs, blocks, "k", F.lit(None).cast("string"), F.lit("filename")).collect()}[2] == ("f2", "filename")

    def body(keep):
        out = defaultdict(list)
        for r in order.body_with_title_policy(blocks, titled, docs, "k", keep).orderBy("k", "pos").collect():
            out[r.k].append(r.text)
        return dict(out)

    assert body(False) == {1: ["목차", "x"], 2: ["Parsed"], 3: [" "], 5: ["Gone title", "Same"]}
    assert body(True) == {1: ["목차", "Real", "x"], 2: ["Parsed", "Parsed"], 3: [" "], 4: ["Kept"], 5: ["Gone title", "Same"]}
    assert {r.k: (r.pos, r.text) for r in order.first_headings(blocks, "k").collect()} == {1: (0, "목차"), 2: (1, "Parsed"), 5: (0, "Same")}


def test_dictionaries_numbers_names(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "x"), (1, 3, None), (2, 0, "y")], "k int, i int, v string")
    assert sorted((r.k, r.signature, r.id) for r in order.dictionary_ids(df, ["k"], ["i"], F.col("v"), 13).collect()) == [(1, "x", 13), (1, "y", 14), (2, "y", 13)]
    assert [r.number for r in order.list_numbers(df, ["k"], "i", F.col("v").isNotNull()).orderBy("k", "i").collect()] == [1, 2, 3, None, 1]
    colours = spark.createDataFrame([(1, "#A", 0), (1, "#B", 5)], "k int, colour string, order int")
    assert sorted((r.colour, r.side, r.id) for r in order.border_variants(colours, ["k"]).collect()) == [("#A", "both", 23), ("#A", "full", 20), ("#A", "left", 21), ("#A", "right", 22), ("#B", "both", 27), ("#B", "full", 24), ("#B", "left", 25), ("#B", "right", 26)]
    names = spark.createDataFrame([(0, "a.txt"), (1, "a.txt"), (2, "b"), (3, "b"), (4, "a.txt")], "i int, name string")
    assert [r.unique_name for r in order.unique_names(names, [], ["i"]).orderBy("i").collect()] == ["a.txt", "a (2).txt", "b", "b (2)", "a (3).txt"]
    names = spark.createDataFrame(list(enumerate(["x", "x (2)", "x", "x (2)", "x", "y (2).z", "y.z", "y.z", "y.z", None])), "i int, name string")
    assert [r.unique_name for r in order.unique_names(names, [], ["i"]).orderBy("i").collect()] == ["x", "x (2)", "x (3)", "x (2) (2)", "x (4)", "y (2).z", "y.z", "y (3).z", "y (4).z", None]
    with pytest.raises(ValueError):
        order.greedy_quota(names, [], "i", "i", 1, 1)


def test_relations(spark):
    used = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "k int, id string")
    defined = spark.createDataFrame([(1, "a"), (2, "b")], "k int, id string")
    assert sorted(map(tuple, relate.dangling(used, defined, ["k", "id"]).collect())) == [(1, "b"), (2, "a")]
    assert sorted(map(tuple, relate.unpaired(used, defined, ["k", "id"]).collect())) == [(1, "b", 2, 0), (2, "a", 1, 0), (2, "b", 0, 1)]
    assert sorted(map(tuple, relate.broken_chain(used, [("one", defined), ("two", used)], ["k", "id"]).collect())) == [(1, "b", "one"), (2, "a", "one")]
    values = spark.createDataFrame([(1, "a", "x")], "k int, id string, v string")
    assert sorted(relate.look_up(used, values, ["k", "id"], "v", F.col("id"), "out").select("k", "id", "out").collect()) == [(1, "a", "x"), (1, "b", "b"), (1, "b", "b"), (2, "a", "a")]
    steps = [(spark.createDataFrame([("a", "n1")], "x string, y string"), "x", "y"), (spark.createDataFrame([("n1", 7)], "y string, z int"), "y", "z")]
    assert sorted((r.id, r.z or 0) for r in relate.look_up_chain(used.distinct(), steps, "id", "z").collect()) == [("a", 7), ("a", 7), ("b", 0)]
    assert relate.same_rows(used, used).count() == 0 and relate.same_rows(used, defined).count() == 4
    declared = spark.createDataFrame([(1, 3), (2, 2), (3, 0)], "k int, n int")
    assert list(map(tuple, relate.count_mismatches(declared, used, ["k"], "n").collect())) == [(2, 2, 1)]
    before = spark.createDataFrame([(1, "code", "a\nb", "0"), (2, "code", "x", "0"), (2, "para", "y", "1")], "k int, type string, text string, block_id string")
    assert sorted(map(tuple, relate.code_audit(before, "k").collect())) == [(1, 1, 2), (2, 1, 1)]
    assert sorted(map(tuple, relate.code_edges(before, "k").collect())) == [(1, "0", 2, "a", "b"), (2, "0", 1, "x", "x")]
    assert relate.audit_mismatches(relate.code_audit(before, "k"), relate.code_audit(before.where("k = 1"), "k"), "k").select("k").collect() == [(2,)]
    parts = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, None)], "k int, i int, t string")
    assert relate.joined_text(parts, ["k"], "i", "t", "-").collect() == [(1, "a-c")]
    assert list(map(tuple, relate.status_counts(spark.createDataFrame([(1, s) for s in ("done", "warn", "error", "unsupported", "done")], "k int, status string"), ["k"]).collect())) == [(1, 3, 1, 1, 1, 5)]


def test_grid(spark):
    rng = random.Random(5)
    cells = []
    for k in range(12):
        for row in range(rng.randint(1, 5)):
            cells += [(k, row, o, rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 9]), f"{row}.{o}") for o in range(rng.randint(1, 4))]
    df = spark.createDataFrame(cells, "k int, row int, ord int, col_span int, row_span int, text string")
    placed = grid.place(df, ["k"])
    assert grid.coverage(placed, ["k"]).count() == 0
    assert grid.coverage(placed.where("filler = false or col > 0").union(placed.limit(1)), ["k"]).count() > 0
    got = placed.where("not filler").select("k", "text").collect()
    assert len(got) == len(set(got))
    simple = spark.createDataFrame([(1, 0, 0, 2, 1, "a"), (1, 0, 1, 1, 2, "b"), (1, 1, 0, 1, 1, "c")], "k int, row int, ord int, col_span int, row_span int, text string")
    assert sorted(map(tuple, grid.place(simple, ["k"]).collect())) == [(1, 0, 0, 2, 1, "a", False), (1, 0, 2, 1, 2, "b", False), (1, 1, 0, 1, 1, "c", False), (1, 1, 1, 1, 1, "", True)]


def test_merges_and_widths(spark):
    df = spark.createDataFrame([(1, r, 0, m) for r, m in enumerate(["restart", "continue", None, "continue", "restart", "continue", "continue"])], "k int, row int, col int, merge string")
    assert sorted((r.row, r.row_span) for r in grid.merged_down(df, ["k"]).collect()) == [(0, 2), (2, 1), (3, 1), (4, 3)]
    cells = spark.createDataFrame([(1, 0, "ab"), (1, 1, "가나다"), (1, 0, "x"), (2, 0, "one"), (3, 0, "a")] + [(4, c, "a") for c in range(20)], "k int, col int, text string")
    widths = {(r.k, r.col): r.width for r in grid.column_widths(cells, ["k"], 48000).collect()}
    assert widths[1, 0] == 3000 + 2 * 42000 // 8 and widths[1, 1] == 48000 - widths[1, 0]
    assert widths[2, 0] == 48000 and widths[4, 0] == 48000 // 20


def test_assets(spark):
    import base64
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 10, 20)
    url = "data:image/png;base64," + base64.b64encode(png).decode()
    rows = [(1, "0", url, "alt"), (1, "1", "img/local.png", ""), (1, "2", "https://x/y.png", ""), (1, "3", "data:image/png;base64,!!", ""), (1, "4", f"<{url}>", "")]
    df = spark.createDataFrame(rows, "k int, block_id string, source string, alt string")
    for name, kind in (("data", "binary"), ("bin_name", "string"), ("width", "int"), ("height", "int")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    got = {r.block_id: r for r in assets.resolve(df, "k").collect()}
    assert [(got[i].bin_name, got[i].width, got[i].height) for i in ("0", "4")] == [("image1.png", 750, 1500), ("image2.png", 750, 1500)]
    assert [got[i].fallback for i in ("0", "1", "2", "3")] == [None, "[이미지: img/local.png]", "[이미지: https://x/y.png]", "[이미지: data:image/png;base64,!!]"]
    assert [got[i].reason for i in ("1", "2", "3")] == ["상대 경로 이미지", "외부 이미지", "읽을 수 없는 이미지"]
    with_fetch = {r.block_id: r for r in assets.resolve(df, "k", lambda u: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\1\0\0\0\1").collect()}
    assert with_fetch["2"].bin_name == "image2.png" and with_fetch["2"].reason is None
