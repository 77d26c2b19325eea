"""Parsers against hand-written documents, round trips and malformed inputs."""

import base64
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from inkflow.operators.relate import same_rows
from inkflow.sources import registry
from inkflow.sources.delimited import csv_rows, delimiter, number_text
from inkflow.sources.registry import parse_one
from inkflow.sources.text import text_blocks, text_documents


def kinds(doc):
    return [(b["block_id"], b["type"]) for b in doc["blocks"]]


def plain(block):
    return block["text"] if block["text"] is not None else "".join(r["text"] for r in block["runs"])


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


# --- text, delimited, JSON


def test_text():
    d = parse_one("txt", "# Title\n\npara\nline two\n\n- a\n- b\n\n1. x\n2. y\n\n```py\ncode\n```\n\n## Sub\n\n- a\nnot a list")
    assert d["title"] == "Title"
    assert [b["type"] for b in d["blocks"]] == ["para", "list", "list", "code", "heading", "para"]
    assert [i["text"] for i in d["items"]] == ["a", "b", "x", "y"]
    assert [b["ordered"] for b in d["blocks"] if b["type"] == "list"] == [False, True]
    assert d["blocks"][3]["text"] == "code" and d["blocks"][4]["level"] == 2


def test_text_encodings():
    text = "제목\r\n\r\n본문"
    for data in (text.encode(), b"\xef\xbb\xbf" + text.encode(), b"\xff\xfe" + text.encode("utf-16-le"), b"\xfe\xff" + text.encode("utf-16-be"), text.encode("euc-kr")):
        assert [plain(b) for b in parse_one("txt", data)["blocks"]] == ["제목", "본문"]
    assert parse_one("txt", b"\xff\xff\x00\x81")["status"] == "error"


def test_native_text_equals_parser(spark):
    rng = random.Random(1)
    parts = ["# One", "## Two", "plain\nlines", "- a\n- b", "1. x\n2. y\n\n", "```\ncode\n```", "", "  ", "\x01ctl", "#no", "- a\nb", "#　x"]
    rows = [(i, "\n\n".join(rng.choices(parts, k=rng.randint(0, 6)))) for i in range(150)] + [(900, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    docs, body = text_documents(df, "k", F.col("t"))
    title = {r.k: r.title for r in docs.collect()}
    got = {}
    for r in body.orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.type, r.level, r.text, r.ordered, r["items"]))
    for k, t in rows:
        want = parse_one("txt", t or "")
        assert title[k] == want["title"]
        items = {}
        for i in want["items"]:
            items.setdefault(i["block_id"], []).append(i["text"])
        assert got.get(k, []) == [(b["type"], b["level"], b["text"], b["ordered"], items.get(b["block_id"])) for b in want["blocks"]]
    assert text_blocks(df.limit(0), "k", F.col("t")).count() == 0


def test_csv():
    assert csv_rows('a,"b ""q"" ,x",c\r\n\n , \n1,"two\nlines",3', ",") == [["a", 'b "q" ,x', "c"], ["1", "two\nlines", "3"]]
    assert csv_rows('mid"dle,x"y,z', ",") == [["middle,xy", "z"]]
    assert delimiter("a\tb\n1\t2,3") == "\t" and delimiter('"a\tb",c') == ","
    d = parse_one("csv", "h1,h2\n1\n2,3,4")
    assert [(c["row"], c["ord"], c["text"], c["is_header"]) for c in d["cells"]] == [(0, 0, "h1", True), (0, 1, "h2", True), (0, 2, "", True), (1, 0, "1", False), (1, 1, "", False), (1, 2, "", False), (2, 0, "2", False), (2, 1, "3", False), (2, 2, "4", False)]
    assert [i["text"] for i in parse_one("csv", "only,one,row")["items"]] == ["only", "one", "row"]
    assert parse_one("csv", "")["blocks"] == []


def test_json():
    d = parse_one("json", json.dumps({"title": "T", "b": 1.0, "10": None, "2": True, "list": [1, "x", None], "rows": [{"a": 1}, {"b": {"c": [1]}, "a": 1e21}], "mix": [1, {"k": 2}]}))
    assert d["title"] == "T"
    assert [(b["type"], b["text"]) for b in d["blocks"]] == [("table", None), ("heading", "list"), ("list", None), ("heading", "rows"), ("table", None), ("heading", "mix"), ("heading", "[0]"), ("para", "1"), ("heading", "[1]"), ("table", None)]
    first = [c["text"] for c in d["cells"] if c["block_id"] == "0"]
    assert first == ["키", "값", "2", "true", "10", "", "b", "1"]
    assert [c["text"] for c in d["cells"] if c["block_id"] == "4"] == ["a", "b", "1", "", "1e+21", '{"c":[1]}']
    assert [i["text"] for i in d["items"]] == ["1", "x", "null"]
    assert parse_one("json", "3.50")["blocks"][0]["text"] == "3.5"
    for x, text in ((1.0, "1"), (0.1, "0.1"), (1e-7, "1e-7"), (123456789012345680000.0, "123456789012345680000"), (1.5e300, "1.5e+300"), (-0.000001, "-0.000001"), (10**25, "1e+25")):
        assert number_text(x) == text


def test_json_that_spells_out_blocks():
    d = parse_one("json", json.dumps({"title": "T\x01", "blocks": [{"type": "para", "runs": [{"text": "b\x02old", "bold": True}]}, {"type": "table", "header": ["h", {"text": "i", "colSpan": 2}], "rows": [["a", None, 3]]}, {"type": "quote", "blocks": [{"type": "para", "text": "q"}]}, "loose", {"type": "list", "items": ["x", {"text": "y", "level": 1}]}]}))
    assert d["title"] == "T" and d["blocks"][0]["runs"][0]["text"] == "bold" and d["blocks"][0]["runs"][0]["bold"]
    assert kinds(d) == [("0", "para"), ("1", "table"), ("2", "quote"), ("2.0", "para"), ("3", "para"), ("4", "list")]
    assert [(c["text"], c["col_span"], c["is_header"]) for c in d["cells"]] == [("h", 1, True), ("i", 2, True), ("a", 1, False), ("", 1, False), ("3", 1, False)]


# --- Markdown and HTML


def test_markdown():
    text = """---
title: Front
---
# Main

A **bold** and *it* `code` ~~gone~~ [link](https://a.b "t") [bad](javascript:x) ***both***[^1]

Setext
------

- one
  - two
    1. three
- [x] done
- [ ] open

3. c
4. d

| a | b |
|---|:-:|
| 1 | **2** |
| x |

> quote
> > deep

```js
let x = 1;


[^1]
```

![pic](data:image/png;base64,AA==) after

***

`sole`

<h1>Raw</h1>

[^1]: the note
"""
    d = parse_one("md", text)
    assert d["title"] == "Main"
    assert kinds(d) == [("0", "para"), ("1", "heading"), ("2", "list"), ("3", "list"), ("4", "table"), ("5", "quote"), ("5.0", "para"), ("5.1", "quote"), ("5.1.0", "para"), ("6", "code"), ("7", "image-source"), ("8", "para"), ("9", "hr"), ("10", "code"), ("11", "heading")]
    runs = {r["text"]: r for r in d["blocks"][0]["runs"]}
    assert runs["bold"]["bold"] and runs["it"]["italic"] and runs["code"]["code"] and runs["gone"]["strike"] and runs["both"]["bold"] and runs["both"]["italic"]
    assert runs["link"]["href"] == "https://a.b" and runs["link"]["title"] == "t"
    assert not any(r["href"] for t, r in runs.items() if "bad" in t)
    assert [r["footnote"] for r in d["blocks"][0]["runs"] if r["footnote"]] == ["the note"]
    assert [(i["text"], i["level"], i["ordered"], i["marker"], i["task"], i["checked"]) for i in d["items"]] == [("one", 0, False, None, False, False), ("two", 1, False, None, False, False), ("three", 2, True, 1, False, False), ("done", 0, False, None, True, True), ("open", 0, False, None, True, False), ("c", 0, True, 3, False, False), ("d", 0, True, 4, False, False)]
    assert [c["text"] for c in d["cells"]] == ["a", "b", "1", "2", "x", ""]
    assert d["blocks"][9]["text"] == "let x = 1;\n\n\n[^1]" and d["blocks"][9]["lang"] == "js"
    assert d["blocks"][13]["inline"] and d["blocks"][14]["text"] == "Raw"
    assert parse_one("md", "no heading")["title"] == "제목 없음"
    assert parse_one("md", "---\ntitle: 'F'\n---\nx")["title"] == "F"


def test_html():
    d = parse_one("html", """<html><head><title>T &amp; U</title><style>x{}</style></head><body><h1>H</h1>
      <p>a <b>bold <i>both</i></b> <span style="color:#c62828">red</span><p>next <u>u</u>
      <ul><li>one<ul><li>two</ul><li>three</ul><ol start=5><li>five<li>six</ol>
      <table><tr><th>a<th colspan=2>b<tr><td rowspan=2>c<td>d<td>e<tr><td>f<td>g</table>
      <blockquote><p>q</p></blockquote><pre> code </pre><hr><p></p><script>alert(1)</script><nav>menu</nav>tail</body></html>""")
    assert d["title"] == "T & U"
    assert [b["type"] for b in d["blocks"]] == ["heading", "para", "para", "list", "list", "table", "quote", "para", "code", "hr", "blank", "para"]
    runs = {r["text"].strip(): r for r in d["blocks"][1]["runs"]}
    assert runs["bold"]["bold"] and runs["both"]["bold"] and runs["both"]["italic"] and runs["red"]["color"] == "#C62828"
    assert [(i["text"], i["level"], i["marker"]) for i in d["items"]] == [("one", 0, None), ("two", 1, None), ("three", 0, None), ("five", 0, 5), ("six", 0, 6)]
    assert [(c["row"], c["text"], c["col_span"], c["row_span"]) for c in d["cells"]] == [(0, "a", 1, 1), (0, "b", 2, 1), (1, "c", 1, 2), (1, "d", 1, 1), (1, "e", 1, 1), (2, "f", 1, 1), (2, "g", 1, 1)]
    assert "alert" not in json.dumps(d) and "menu" not in json.dumps(d)


def test_html_reopens_formatting():
    d = parse_one("html", "<body><p>a <b>b<p>c</b> d<h1>Title</h1>")
    assert [[(r["text"], r["bold"]) for r in b["runs"]] for b in d["blocks"]] == [[("a ", False), ("b", True)], [("c", True), (" d", False)]]
    assert d["title"] == "Title"


def test_hostile_markup_keeps_only_safe_links():
    d = parse_one("md", "# x\n\n<script>alert(1)</script>\n\n<img src=x onerror=alert(1)>\n\n[bad](javascript:alert(1)) [good](https://ok.example)")
    links = [r["href"] for b in d["blocks"] for r in b["runs"] or [] if r["href"]]
    assert links == ["https://ok.example"] and "alert(1)" not in "".join(plain(b) for b in d["blocks"] if b["text"])


# --- notebooks and office formats


def test_notebook():
    png = base64.b64encode(b"\x89PNG").decode()
    book = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "\n", "text"]}, {"cell_type": "code", "source": "print(1)\n", "outputs": [{"output_type": "stream", "text": ["1\n"]}, {"output_type": "execute_result", "data": {"text/plain": "2"}}, {"output_type": "display_data", "data": {"image/png": png}}, {"output_type": "error"}]}, {"cell_type": "raw", "source": "raw"}]}
    d = parse_one("ipynb", json.dumps(book))
    assert d["title"] == "T"
    assert [(b["type"], b["text"] or plain(b) if b["type"] != "image-source" else "") for b in d["blocks"]] == [("para", "text"), ("code", "print(1)"), ("para", "[출력] 1"), ("para", "[출력] 2"), ("image-source", ""), ("para", "raw")]
    assert d["assets"][0]["bin_name"] == "ipynb-out1.png" and d["assets"][0]["source"].endswith(png)
    assert parse_one("ipynb", json.dumps({"worksheets": [{"cells": [{"cell_type": "code", "input": "x"}]}]}))["blocks"][0]["text"] == "x"


W = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:a="http://a" xmlns:wp="http://wp"'
REL = '<Relationships xmlns="http://rel">{}</Relationships>'


def test_docx():
    body = """<w:p><w:pPr><w:pStyle w:val="T"/></w:pPr><w:r><w:t>Doc title</w:t></w:r></w:p>
    <w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
    <w:p><w:pPr><w:outlineLvl w:val="2"/></w:pPr><w:r><w:t>Outline</w:t></w:r></w:p>
    <w:p><w:r><w:rPr><w:b/></w:rPr><w:t>All bold</w:t></w:r></w:p>
    <w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:t xml:space="preserve">plain </w:t></w:r><w:r><w:rPr><w:i/><w:b w:val="0"/><w:color w:val="ff0000"/></w:rPr><w:t>red</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:footnoteReference w:id="9"/></w:r></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>sub</w:t></w:r></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>sub again</w:t></w:r></w:p>
    <w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/><w:shd w:fill="aabbcc"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc></w:tr>
    <w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr>
    <w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>
    <w:p><w:r><w:drawing><wp:extent cx="127000" cy="254000"/><wp:docPr descr="pic"/><a:blip r:embed="r2"/></w:drawing></w:r></w:p><w:p/>"""
    d = parse_one("docx", package({
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": REL.format('<Relationship Id="r1" Type="x/hyperlink" Target="https://a.b" TargetMode="External"/><Relationship Id="r2" Type="x/image" Target="media/i.png"/><Relationship Id="r3" Type="x/header" Target="header1.xml"/>'),
        "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>",
        "word/media/i.png": b"PNGDATA",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="4"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="-1"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    }))
    assert d["status"] == "done", d["error"]
    assert d["title"] == "Doc title" and d["header"] == "Top"
    assert [(b["type"], b["level"]) for b in d["blocks"]] == [("heading", 2), ("heading", 3), ("heading", 3), ("para", None), ("list", None), ("table", None), ("image", None), ("blank", None)]
    para = d["blocks"][3]
    assert para["align"] == "center" and [(r["text"], r["italic"], r["bold"], r["color"], r["href"], r["footnote"]) for r in para["runs"]] == [("plain ", False, False, None, None, None), ("red", True, False, "#FF0000", None, None), ("link", False, False, None, "https://a.b", None), ("", False, False, None, None, "note")]
    assert [(i["text"], i["level"], i["marker"]) for i in d["items"]] == [("one", 0, 4), ("sub", 1, 1), ("two", 0, 5), ("sub again", 1, 1)]
    assert [(c["row"], c["ord"], c["text"], c["col_span"], c["row_span"], c["bg"]) for c in d["cells"]] == [(0, 0, "wide", 2, 1, None), (0, 1, "tall", 1, 3, "#AABBCC"), (1, 0, "a", 1, 1, None), (1, 1, "b", 1, 1, None), (2, 0, "c", 1, 1, None), (2, 1, "d", 1, 1, None)]
    image = d["assets"][0]
    assert (image["width"], image["height"], image["alt"], bytes(image["data"])) == (1000, 2000, "pic", b"PNGDATA")


def test_pptx():
    p = 'xmlns:p="http://p" xmlns:a="http://a" xmlns:r="http://r"'

    def shape(text, kind="", props=""):
        return f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p>{props}<a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    bullet = '<a:pPr lvl="5"><a:buChar char="x"/></a:pPr>'
    grid = '<a:tr><a:tc gridSpan="2" rowSpan="2"><a:txBody><a:p><a:r><a:t>big</a:t></a:r></a:p></a:txBody></a:tc><a:tc hMerge="1"/><a:tc><a:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></a:txBody></a:tc></a:tr><a:tr><a:tc vMerge="1"/><a:tc hMerge="1" vMerge="1"/><a:tc><a:txBody><a:p><a:r><a:t>y</a:t></a:r></a:p></a:txBody></a:tc></a:tr>'
    one = f'<p:sld {p}><p:spTree>{shape("Title", "title")}{shape("b1", "", bullet)}{shape("b2", "", bullet)}<p:grpSp>{shape("in group")}</p:grpSp><p:graphicFrame><a:tbl>{grid}</a:tbl></p:graphicFrame></p:spTree></p:sld>'
    d = parse_one("pptx", package({
        "ppt/presentation.xml": f'<p:presentation {p}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/><Relationship Id="r2" Type="x/slide" Target="slides/slide2.xml"/>'),
        "ppt/slides/slide1.xml": one,
        "ppt/slides/slide2.xml": f"<p:sld {p}><p:spTree>{shape('second file first')}</p:spTree></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": REL.format('<Relationship Id="n" Type="x/notesSlide" Target="../notesSlides/n1.xml"/>'),
        "ppt/notesSlides/n1.xml": f"<p:notes {p}><p:spTree>{shape('say this', 'body')}{shape('1', 'sldNum')}</p:spTree></p:notes>",
    }))
    assert d["status"] == "done", d["error"]
    assert [(b["type"], b["text"]) for b in d["blocks"]] == [("heading", "슬라이드 1"), ("para", "second file first"), ("heading", "슬라이드 2"), ("heading", "Title"), ("list", None), ("para", "in group"), ("table", None), ("para", "[발표자 노트] say this")]
    assert [(i["text"], i["level"]) for i in d["items"]] == [("b1", 2), ("b2", 2)]
    assert [(c["row"], c["text"], c["col_span"], c["row_span"]) for c in d["cells"]] == [(0, "big", 2, 2), (0, "x", 1, 1), (1, "y", 1, 1)]


def test_xlsx():
    s = 'xmlns:r="http://r"'
    d = parse_one("xlsx", package({
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="First" r:id="r1"/><sheet name="Other" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="r1" Type="x" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="x" Target="worksheets/sheet2.xml"/>'),
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row/><row><c r="B3"><f>SUM(1)</f><v>1234</v></c><c r="C3" t="b"><v>1</v></c></row><row><c r="A4" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": "<worksheet><sheetData><row><c><v>no</v></c></row></sheetData></worksheet>",
    }))
    assert d["title"] == "First"
    assert [c["text"] for c in d["cells"]] == ["name", "value", "", "", "1234", "TRUE", "in", "", ""]


def test_own_package():
    h = 'xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"'
    section = f'<hs:sec {h}><hp:p paraPrIDRef="1"><hp:run><hp:t>Title</hp:t></hp:run></hp:p><hp:p paraPrIDRef="2"><hp:run><hp:t>Head</hp:t></hp:run></hp:p><hp:p><hp:run><hp:t>a</hp:t></hp:run><hp:run><hp:t>b</hp:t></hp:run></hp:p><hp:p/><hp:p><hp:run><hp:tbl><hp:tr><hp:tc header="1"><hp:p><hp:t>h</hp:t></hp:p></hp:tc></hp:tr><hp:tr><hp:tc><hp:p><hp:t>c</hp:t></hp:p></hp:tc></hp:tr></hp:tbl></hp:run></hp:p></hs:sec>'
    d = parse_one("hwpx", package({"Contents/section0.xml": section}))
    assert d["title"] == "Title" and [(b["type"], b["text"]) for b in d["blocks"]] == [("heading", "Head"), ("para", "ab"), ("blank", None), ("table", None)]
    assert [(c["text"], c["is_header"]) for c in d["cells"]] == [("h", True), ("c", False)]


@pytest.mark.parametrize(
    "name,data,status,message",
    [
        ("json", b'{"open":', "error", "JSON 파싱 오류"),
        ("ipynb", b"{not notebook", "error", "IPYNB 파싱 오류"),
        ("csv", b'a,b\n"open,cell', "error", "닫히지 않은 따옴표"),
        ("docx", b"not a zip", "error", "DOCX ZIP 열기 실패"),
        ("hwp", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "error", "HWP5 바이너리"),
        ("hwp", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 600, "unsupported", "HWP5 바이너리를 열지 못했습니다"),
        ("hwp", b"????", "error", "알 수 없는"),
        ("xls", b"\xd0\xcf\x11\xe0", "unsupported", "지원하지 않는"),
        ("zzz", b"x", "unsupported", "지원하지 않는 확장자"),
        ("docx", package({"other.xml": "<x/>"}), "error", "document.xml"),
        ("hwpx", package({"Contents/section0.xml": "<x/>"}), "error", "추출하지 못했습니다"),
        ("docx", package({"word/document.xml": "<broken"}), "error", "XML 파싱 오류"),
        ("json", b"[" * 100_000, "error", "JSON 파싱 오류"),
    ],
)
def test_malformed_is_an_error_row(name, data, status, message):
    d = parse_one(name, data)
    assert d["status"] == status and message in d["error"] and d["blocks"] == []


def test_archive_cap(monkeypatch):
    from inkflow.sources import office

    monkeypatch.setattr(office, "UNZIPPED_CAP", 10)
    assert "초과" in parse_one("docx", package({"word/document.xml": "x" * 11}))["error"]


# --- tables


def test_tables_and_parity(spark, tmp_path):
    texts = {"a.md": "# A\n\n- x\n- y", "b.html": "<h1>B</h1><p>t</p>", "c.txt": "plain", "d.csv": "a,b\n1,2", "e.json": '{"title":"E","k":1}', "f.bin": "?"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = registry.read_files(spark, str(tmp_path))
    assert "length" in files.select("ext")._jdf.queryExecution().toString()
    from_files = registry.parse(files, "ext", F.col("ext"), F.col("content"))
    pasted = spark.createDataFrame([(n.rsplit(".")[-1], t) for n, t in texts.items()], "ext string, text string")
    from_text = registry.parse(pasted, "ext", F.col("ext"), F.col("text"))
    for make in (registry.docs_table, lambda p, k: registry.part_table(p, k, "blocks").drop("runs"), lambda p, k: registry.part_table(p, k, "cells").drop("runs")):
        assert same_rows(make(from_files, "ext"), make(from_text, "ext")).count() == 0
    docs = {r.ext: (r.title, r.status) for r in registry.docs_table(from_files, "ext").collect()}
    assert docs == {"md": ("A", "done"), "html": ("B", "done"), "txt": ("텍스트 문서", "done"), "csv": ("스프레드시트", "done"), "json": ("E", "done"), "bin": (None, "unsupported")}
    assert registry.part_table(from_files, "ext", "items").count() == 2


def test_too_large_files_are_error_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "big.docx").write_bytes(b"x" * 900)
    (tmp_path / "big.txt").write_text("y" * 900)
    (tmp_path / "small.txt").write_text("fine")
    monkeypatch.setattr(registry, "BINARY_CAP", 500)
    files = registry.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/")[-1]: (r.length, r.content is None) for r in files.collect()}
    assert got == {"big.docx": (900, True), "big.txt": (900, False), "small.txt": (4, False)}
    assert parse_one("txt", None, 200 << 20) == parse_one("txt", b"", 200 << 20) | {} and parse_one("txt", None, 200 << 20)["status"] == "error"
    docs = registry.parse(files.withColumn("length", F.when(F.col("path").endswith("small.txt"), 200 << 20).otherwise(F.col("length")).cast("long")).withColumn("content", F.when(F.col("ext") == "txt", F.col("content"))), "path", F.col("ext"), F.col("content"), F.col("length"))
    assert {r.path.rsplit("/")[-1]: r.doc.status for r in docs.collect()}["small.txt"] == "error"


def test_new_format():
    registry.register_format("upper", lambda t: registry.parse_text(t.upper()))
    assert parse_one("upper", "abc")["blocks"][0]["text"] == "ABC"
    del registry.TEXT_FORMATS["upper"]


def test_block_items(spark):
    given = ["- a\n- b\n\nx\n\n1. c\n   - d\n2. e", "no list", "", "- z"]
    docs = registry.parse(spark.createDataFrame(list(enumerate(given)), "k int, md string"), "k", F.lit("md"), F.col("md"))
    got = {r.k: [tuple(x) for x in r.x] for r in docs.select("k", registry.block_items(F.col("doc"), "+").alias("x")).collect()}
    assert got == {0: [("0", "a+b"), ("2", "c+d+e")], 1: [], 2: [], 3: [("0", "z")]}


def test_slides_are_parsed_once(spark):
    """Blocks and items of a deck come from one parse, and only the orders are shuffled."""
    from inkflow.plans.catalog import QUERIES

    plan = QUERIES["pptx_slides"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse(pptx") == 1 and "Join" not in plan


def test_many_documents_in_a_batch(spark):
    n = 3 * registry.PARSED_AT_ONCE + 1
    docs = registry.parse(spark.range(n).repartition(1), "id", F.lit("txt"), F.col("id").cast("string"))
    assert docs.select("id", F.col("doc.blocks")[0]["text"].alias("t")).where("t = string(id)").count() == n
