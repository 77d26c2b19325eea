"""Scalar functions against hand-written values."""

import struct

import pytest
from pyspark.sql import functions as F

from inkflow.functions import text as ft
from inkflow.functions import units as fu
from inkflow.functions import values as fv


def values(spark, rows, f, schema="x string"):
    return [r.y for r in spark.createDataFrame([(x,) for x in rows], schema).select(f(F.col("x")).alias("y")).collect()]


def test_text(spark):
    assert values(spark, ["a\x00b\x0bc\td\n", None, "\x7f"], ft.sanitize) == ["abc\td\n", "", ""]
    assert values(spark, ["&amp;lt; &lt;b&gt; &#39;&apos;&quot;"], ft.decode_entities) == ["&lt; <b> ''\""]
    assert values(spark, ["<a href='x'>&\""], ft.html_escape) == ["&lt;a href=&#039;x&#039;&gt;&amp;&quot;"]
    assert values(spark, ["<a href='x'>&\""], ft.xml_escape) == ["&lt;a href='x'&gt;&amp;&quot;"]
    assert values(spark, ["ok 😀 ☀️ 👨‍👩 ⭕ 가"], ft.replace_emoji) == ["ok □ □ □□ □ 가"]
    assert values(spark, ["abc", "한글ab", "x" * 99, ""], ft.display_width) == [3, 6, 40, 0]
    assert values(spark, ["  a 　\n b\xa0", None], ft.title_candidate) == ["a b", ""]
    assert values(spark, ["목 차", "[Table of Contents]", "Overview:", "My overview", ""], ft.is_generic_title) == [True, True, True, False, False]


def test_closed_references(spark):
    given = ["a&amp;b &copy; &#39; &#x27;", "a&amp</p> &quot &#39 &#x2 &lt", "a & b && &; c&", None]
    assert values(spark, given, ft.closed_references) == [given[0], "a&amp;amp</p> &amp;quot &amp;#39 &amp;#x2 &amp;lt", given[2], None]


def test_names(spark):
    assert values(spark, ["a.b.MD", "noext", "x.", ".hidden"], ft.extension) == ["md", "noext", "", "hidden"]
    assert values(spark, ["a.b.MD", "noext"], ft.extension_or_empty) == ["md", ""]
    assert values(spark, ["a.b.md", "noext", " x .txt"], ft.base_name) == ["a.b", "noext", "x"]
    assert values(spark, ['a/b:c*?"<>|.docx', "y" * 120, None], ft.safe_base_name) == ["abc", "y" * 100, ""]
    assert values(spark, ["a.docx", "b.HWPX", "", None, "plain"], ft.package_name) == ["a.hwpx", "b.HWPX", "document.hwpx", "document.hwpx", "plain.hwpx"]
    assert values(spark, [0, 1023, 1536, 805120, 5 << 20], ft.format_bytes, "x long") == ["0 B", "1023 B", "1.5 KB", "786.3 KB", "5.00 MB"]
    assert values(spark, ["https://a.b/?q=\\"], ft.hyperlink_command) == ["https\\://a.b/\\?q=\\\\;1;0;1;"]


def test_frontmatter_and_spans(spark):
    assert values(spark, ["---\nTitle: \"A: b\"\nx: 1\nX: 2\n---\nbody", "no", "---\nopen"], ft.frontmatter) == [{"title": "A: b", "x": "2"}, {}, {}]
    assert values(spark, ["a **b** c **d e**", "none"], ft.strong_spans) == [["b", "d e"], []]


def test_units(spark):
    assert values(spark, [20.0, 10.0, -0.00176], fu.mm_to_units, "x double") == [5669, 2835, 0]
    assert values(spark, [-2.5, 2.5], fu.round_half_up, "x double") == [-2, 3]
    assert values(spark, ["150", "155", "200%", None], fu.line_spacing) == [150, 160, 200, 160]
    assert values(spark, ["15", "x", None, ""], lambda c: fu.margin_mm(c, "left")) == [15.0, 20.0, 20.0, 20.0]
    assert values(spark, ["relaxed", "other"], lambda c: fu.paragraph_spacing(c)["heading_next"]) == [850, 567]
    assert [tuple(x) for x in values(spark, ["12", "99", "2"], lambda c: fu.heading_sizes(c, F.lit("standard")))] == [(1200, 1800, 1600, 1400, 1300, 1200, 1100, 1200, 1100), (3600, 4200, 4000, 3800, 3700, 3600, 3500, 3600, 3500), (600, 1200, 1000, 800, 800, 600, 800, 600, 800)]
    assert [tuple(x) for x in values(spark, [4, 5, 6, 9, None], fu.heading_ids, "x int")] == [("4", "4"), ("10", "15"), ("11", "16"), ("11", "16"), ("1", "1")]
    assert [tuple(x) for x in values(spark, [100, 2000], lambda c: fu.image_size(c, F.lit(300)), "x int")] == [(7500, 22500), (40000, 6000)]
    assert values(spark, ["report", "?"], fu.table_style) == ["report", "standard"]
    assert values(spark, ["plain", "?"], fu.link_style) == ["plain", "blue"]
    assert [tuple(x) for x in values(spark, ["75", "80"], lambda c: fu.image_options(c, F.lit("up")))] == [(75, "center"), (100, "center")]
    assert values(spark, ["1.2.3"], lambda c: fu.next_version(c, F.lit(True))) == ["1.2.4"]
    assert values(spark, ["1.2.3"], lambda c: fu.next_version(c, F.lit(False))) == ["1.3.0"]
    assert values(spark, [5669, 2835], fu.units_to_mm, "x int") == [20.0, 10.0]
    assert values(spark, ["120", "-3", "x"], fu.clamp_percent) == [100.0, 0.0, 0.0]


@pytest.mark.parametrize("paper,landscape,width", [("A4", False, 48190), ("A4", True, 72850), ("A3", False, 72851), ("A3", True, 107717), ("B5", False, 40092), ("B5", True, 61479), ("Letter", False, 50582), ("Letter", True, 68798), ("?", False, 48190)])
def test_content_width(spark, paper, landscape, width):
    assert values(spark, [paper], lambda c: fu.content_width(c, F.lit(landscape), F.lit(5669), F.lit(5669))) == [width]


def test_values(spark):
    assert values(spark, ["#abc", "#A1b2C3", "rgb(1, 300,16)", "Navy", "none", None], fv.hex_colour) == ["#AABBCC", "#A1B2C3", "#01FF10", "#000080", None, None]
    assert values(spark, ["margin:0; Color : red; x:y", ""], lambda c: fv.node_colour(c, F.lit("#123"))) == ["#FF0000", "#112233"]
    assert values(spark, ["1,234.5", "-3%", "₩ 1,000", "a1", "", None, "1.", ","], fv.is_numeric_cell) == [True, True, True, False, False, False, False, True]
    assert values(spark, ["https://A.com", "javascript:alert(1)", "mailto:a@b.c", " http://x:80/a b?q=1#f ", "ftp://x", None, "http://"], fv.safe_link) == ["https://a.com/", "", "mailto:a@b.c", "http://x/a%20b?q=1#f", "", "", ""]
    assert values(spark, ["[t](http://x)", "<y.png>", "z.png"], fv.image_source) == ["http://x", "y.png", "z.png"]
    assert values(spark, ["Unsupported size", "too large", "bad JSON", "HWP5 x", "blocked", "?", None], fv.error_category) == ["지원하지 않는 포맷", "파일 크기", "파싱 오류", "지원하지 않는 구조", "브라우저 다운로드 차단", "변환 처리", "변환 처리"]
    assert values(spark, ["../media/a.png", "./b/../c.xml", "/abs/d"], lambda c: fv.resolve_path(F.lit("ppt/slides"), c)) == ["ppt/media/a.png", "ppt/slides/c.xml", "abs/d"]


def test_bytes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 11, 13)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 33, 44) + b"\0" * 9
    got = values(spark, [png, gif, bmp, jpeg, b"nothing", None], fv.raster_info, "x binary")
    assert [tuple(x) if x else None for x in got] == [("png", 640, 480), ("gif", 7, 9), ("bmp", 11, 13), ("jpeg", 44, 33), None, None]
    assert values(spark, [b"RIFF\0\0\0\0WEBPx", b"RIFF"], fv.is_webp, "x binary") == [True, False]
    assert values(spark, [b"\xd0\xcf\x11\xe0", b"PK\x03\x04", b"%PDF", b""], fv.file_magic, "x binary") == ["ole2", "zip", "unknown", "unknown"]
    urls = values(spark, ["data:image/png;base64,iVBO Rw0=", "data:image/svg+xml,%3Csvg+x%3E", "data:image/png;base64,!!", "http://x"], fv.data_url)
    assert [(u.mime, u.data) for u in urls] == [("image/png", bytearray(b"\x89PNG\r")), ("image/svg+xml", bytearray(b"<svg+x>")), ("image/png", None), (None, None)]


def test_styles(spark):
    run = "x struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,color:string,href:string>"
    rows = [("a", True, None, None, None, None, None), ("b", None, None, None, None, None, "http://x"), ("c", None, None, None, None, "#000000", None), ("d", None, True, None, True, "#ff0000", None)]
    assert values(spark, rows, fv.needs_own_style, run) == [False, True, False, True]
    assert values(spark, rows, fv.style_key, run) == ["1000|#000000|", "0010|#0563C1|", "0000|#000000|", "0101|#FF0000|"]


def test_formats(spark):
    from inkflow.functions import formats

    df = spark.createDataFrame([("DOCX", "source"), ("docx", "balanced"), ("docx", "app"), ("md", "source"), ("odt", "source")], "ext string, policy string")
    rows = formats.with_format(df).orderBy("ext", "policy").collect()
    assert [r.styled for r in rows] == [True, True, True, False, False] and rows[-1].advice == formats.OTHER_ADVICE
    given = {"paragraph_spacing": F.lit("relaxed"), "heading_style": F.lit("prominent"), "table_style": F.lit("report"), "link_style": F.lit("url"), "image_width": F.lit(50)}
    got = [tuple(r.o) for r in df.select(formats.style_options(F.col("ext"), F.col("policy"), given).alias("o")).collect()]
    asked = ("relaxed", "prominent", "report", "url", 50)
    assert got == [("compact", "standard", "standard", "blue", 100), ("relaxed", "standard", "standard", "url", 50), asked, asked, asked]
    assert values(spark, [85, 65, 1], formats.metric_class, "x int") == ["high", "mid", "low"]
    day = spark.sql("SELECT date'2026-03-09' AS d").select(formats.date_stamp(F.col("d")).alias("a"), formats.long_date(F.col("d")).alias("b")).first()
    assert tuple(day) == ("20260309", "2026년 3월 9일")
