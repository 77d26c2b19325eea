"""HTML, packages and their checks, conversion of batches, and streams."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from inkflow.plans import convert
from inkflow.sinks import html as sink_html
from inkflow.sinks.package import Writer, archive, page_width, problems
from inkflow.sources import registry
from inkflow.sources.registry import parse_one
from inkflow.streaming import files as stream_files

RICH = """# Title

Text with **bold**, [link](https://a.b/?q=1) and [other](mailto:a@b.c)[^n].

## Two

1. one
   - sub
2. two

- [x] done

| a | b |
|---|---|
| 1,000 | &lt;tag> & "q" |

> quoted **words**

```
code  line
  two
```

---

![p](data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==)

[^n]: the note
"""


def test_html(spark):
    docs = registry.parse(spark.createDataFrame([(1, RICH), (2, "just text"), (3, "> a\n>\n> > b\n\nc")], "k int, t string"), "k", F.lit("md"), F.col("t"))
    parts = [registry.part_table(docs, "k", x) for x in ("blocks", "items", "cells")]
    got = {r.k: r.html for r in sink_html.blocks_html(*parts, "k").collect()}
    assert got[2] == "<p>just text</p>"
    assert got[3] == "<blockquote><p>a</p><blockquote><p>b</p></blockquote></blockquote><p>c</p>"
    for piece in ('<strong>bold</strong>', '<a href="https://a.b/?q=1">link</a>', "<sup>the note</sup>", "<h2>Two</h2>", "<ol><li>one</li><ul><li>sub</li></ul><li>two</li></ol>", "<ul><li>☑ done</li></ul>", "<tr><th>a</th><th>b</th></tr><tr><td>1,000</td><td>&lt;tag&gt; &amp; &quot;q&quot;</td></tr>", "<blockquote><p>quoted <strong>words</strong></p></blockquote>", "<pre><code>code  line\n  two</code></pre>", "<hr>"):
        assert piece in got[1], piece
    page = sink_html.standalone(registry.docs_table(docs, "k").select("k", "title").join(sink_html.blocks_html(*parts, "k"), "k"), "k").where("k = 1").first().html
    assert page.startswith("<!DOCTYPE html>") and "<title>Title</title>" in page


@pytest.mark.parametrize("paper,landscape", [(p, o) for p in ("A4", "A3", "B5", "Letter") for o in (False, True)])
def test_package_passes_its_checks(paper, landscape):
    doc = parse_one("md", RICH)
    for a in doc["assets"]:
        a["data"] = b"\x89PNG"
    data = Writer(doc, paper, landscape, {"left": 15}).build()
    assert problems(data, {"left": 15}) == []
    assert any("left" in p for p in problems(data))
    z = zipfile.ZipFile(io.BytesIO(data))
    section = z.read("Contents/section0.xml").decode()
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert f'horzsize="{page_width(paper, landscape, {"left": 15})}"' in section
    assert section.count("fieldBegin ") == section.count("fieldEnd ") == 2 and "<hp:pic" in section and "BinData/image1.png" in z.namelist()
    assert "javascript" not in section and Writer(doc, paper, landscape, {"left": 15}).build() == data


def test_round_trip():
    doc = parse_one("md", RICH.replace("[^n].", ""))
    back = parse_one("hwpx", Writer(doc).build())
    assert back["status"] == "done" and back["title"] == "Title"
    words = set(" ".join(b["text"] or "".join(r["text"] for r in b["runs"] or []) for b in doc["blocks"]).split())
    said = " ".join([b["text"] or "" for b in back["blocks"]] + [c["text"] for c in back["cells"]])
    assert words <= set(re.split(r"\s+", said))
    assert [c["text"] for c in back["cells"]] == [c["text"] for c in doc["cells"]]


def test_checks_find_what_is_broken():
    data = Writer(parse_one("md", RICH)).build()

    def changed(name, old, new):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
            for i in z.infolist():
                body = z.read(i.filename)
                if i.filename == name:
                    assert old in body
                    if new is None:
                        continue
                    body = body.replace(old, new, 1)
                w.writestr(i.filename, body)
        return problems(out.getvalue())

    section, header = "Contents/section0.xml", "Contents/header.xml"
    assert "charPrIDRef" not in str(problems(data))
    for args, message in (((section, b'charPrIDRef="0"', b'charPrIDRef="99"'), 'charPrIDRef="99" 미정의'), ((section, b'colSpan="1"', b'colSpan="2"'), "표 격자"), ((section, b"fieldEnd beginIDRef", b"fieldEnd xIDRef"), "링크 짝"), ((header, b'itemCnt="17"', b'itemCnt="3"'), "itemCnt"), ((section, b'horzsize="', b'horzsize="9'), "본문 폭"), ((section, b"</hs:sec>", b""), "XML"), (("mimetype", b"application", b"app"), "mimetype"), (("META-INF/manifest.xml", b"", None), "필수 파일")):
        assert any(message in p for p in changed(*args)), (args, changed(*args))
    assert problems(b"no zip")[0].startswith("ZIP") and problems(None)[0].startswith("ZIP")


def test_batch(spark, tmp_path):
    rows = [("q", i, n, t.encode()) for i, (n, t) in enumerate([("s.md", RICH), ("s.html", "<p>x</p>"), ("s.csv", "a,b\n1,2"), ("broken.json", '{"open":'), ("skip.bin", "?"), ("s.md", "again")])]
    files = convert.queue(spark.createDataFrame(rows, "batch string, i int, name string, content binary"), "batch", "i", cap=4)
    assert {r.overflow for r in files.collect()} == {1}
    files = convert.queue(spark.createDataFrame(rows, "batch string, i int, name string, content binary"), "batch", "i")
    got = convert.converted(files, convert.Options("B5", True))
    out = {r.i: r for r in got.drop("doc", "content").collect()}
    assert out[0].issues == []
    assert {i: r.status for i, r in out.items()} == {0: "done", 1: "done", 2: "done", 3: "error", 5: "done"}
    assert out[3].package is None and "JSON 파싱 오류" in out[3].error and out[3].error_category == "파싱 오류"
    assert all(problems(r.package) == [] for r in out.values() if r.package)
    named = convert.archive_names(got, "batch", "i")
    assert sorted(r.unique_name for r in named.select("unique_name").collect()) == ["s (2).hwpx", "s (3).hwpx", "s (4).hwpx", "s.hwpx"]
    archive(named, "unique_name", "package", str(tmp_path / "all.zip"))
    assert len(zipfile.ZipFile(tmp_path / "all.zip").namelist()) == 4
    pasted = convert.converted(convert.pasted(spark.createDataFrame([(1, "이름\t수량\n사과\t3")], "k int, t string"), F.col("t"), F.lit("CSV")))
    assert pasted.select("status", F.size("doc.cells").alias("n")).first() == ("done", 4)


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.md").write_text("# A")
    (inbox / "b.json").write_text("{")

    def run():
        q = stream_files.store(stream_files.arriving(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "state"))
        assert q.awaitTermination(120)
        return sorted((r.ext, r.doc.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("json", "error"), ("md", "done")]
    (inbox / "c.txt").write_text("late")
    assert run() == [("json", "error"), ("md", "done"), ("txt", "done")]
    windows = stream_files.status_by_window(stream_files.arriving(spark, str(inbox)))
    q = windows.writeStream.format("memory").queryName("by_window").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.status, r.n) for r in spark.sql("SELECT status, sum(n) AS n FROM by_window GROUP BY status").collect()} == {("done", 2), ("error", 1)}
