"""Documents as packages of the word processor: a ZIP of XML parts, its checks, and archives of several packages.

A package is built from one document's parsed struct, so nothing is shuffled. Character styles beyond the fixed ones are numbered in order of
first appearance; tables are placed on a grid in which every place is covered once.
"""

from __future__ import annotations

import io
import re
import zipfile
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import LEAST_COLUMN, LEAST_WIDTH, MARGINS_MM, PAPERS, UNITS_PER_MM

# Names and namespaces of the format.
MIMETYPE = "application/hwp+zip"
BASE = "http://www.hancom.co.kr/hwpml/2011/"
SPACES = " ".join(f'xmlns:{k}="{BASE}{v}"' for k, v in (("hs", "section"), ("hp", "paragraph"), ("hh", "head"), ("hc", "core")))
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
PARTS = {
    "version.xml": f'<hv:HCFVersion xmlns:hv="{BASE}version" tagetApplication="WORDPROCESSOR" major="5" minor="0" micro="5" buildNumber="0" os="1" application="Hancom Office Hangul"/>',
    "settings.xml": f'<ha:HWPApplicationSetting xmlns:ha="{BASE}app"/>',
    "META-INF/container.xml": '<ocf:container xmlns:ocf="urn:oasis:names:tc:opendocument:xmlns:container"><ocf:rootfiles><ocf:rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></ocf:rootfiles></ocf:container>',
    "META-INF/container.rdf": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"></rdf:RDF>',
}
REQUIRED = ("mimetype", "META-INF/container.xml", "META-INF/container.rdf", "META-INF/manifest.xml", "Contents/content.hpf", "Contents/header.xml", "Contents/section0.xml", "Preview/PrvText.txt")
#: Character properties: id to (height, bold, italic, colour); paragraph properties: id to (alignment, left margin, space before, after).
CHARS = {0: (1200, 0, 0, None), 1: (1800, 1, 0, None), 2: (1600, 1, 0, None), 3: (1400, 1, 0, None), 4: (1300, 1, 0, None), 5: (1200, 1, 0, None), 6: (1200, 0, 1, None), 7: (1200, 1, 1, None), 8: (1100, 0, 0, None), 9: (1200, 1, 0, None), 10: (1200, 1, 0, None), 11: (1100, 1, 0, None), 12: (900, 0, 0, "#666666")}
PARAS = {0: ("JUSTIFY", 0, 0, 850), 1: ("LEFT", 0, 850, 567), 2: ("LEFT", 0, 850, 567), 3: ("LEFT", 0, 850, 567), 4: ("LEFT", 0, 850, 567), 5: ("LEFT", 800, 0, 100), 6: ("LEFT", 1600, 0, 100), 7: ("LEFT", 2400, 0, 100), 8: ("LEFT", 400, 0, 0), 9: ("LEFT", 1200, 0, 283), 10: ("CENTER", 0, 0, 0), 11: ("LEFT", 0, 0, 0), 12: ("RIGHT", 0, 0, 0), 13: ("CENTER", 0, 0, 850), 14: ("RIGHT", 0, 0, 850), 15: ("LEFT", 0, 850, 567), 16: ("LEFT", 0, 850, 567)}
FIRST_STYLE, FIRST_FILL = 13, 20
_BAD = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def half_up(x: float) -> int:
    return int((x + 0.5) // 1)


def units(mm: float) -> int:
    return half_up(mm * UNITS_PER_MM)


def margins(mm: dict[str, float] | None = None) -> dict[str, int]:
    return {k: units((mm or {}).get(k, v)) for k, v in MARGINS_MM.items()}


def page_width(paper: str = "A4", landscape: bool = False, mm: dict[str, float] | None = None) -> int:
    w, h = PAPERS.get(paper, PAPERS["A4"])
    m = margins(mm)
    return max(LEAST_WIDTH, (h if landscape else w) - m["left"] - m["right"])


class Writer:
    def __init__(self, doc: dict, paper: str = "A4", landscape: bool = False, mm: dict[str, float] | None = None) -> None:
        self.doc, self.paper, self.landscape, self.margins = doc, paper, landscape, margins(mm)
        self.width = page_width(paper, landscape, mm)
        self.styles: dict[tuple, int] = {}
        self.fills: dict[tuple[str, str], int] = {}
        self.links = self.notes = self.ids = 0
        self.images: list[dict] = []
        self.items = self._by_block("items")
        self.cells = self._by_block("cells")
        self.assets = {a["block_id"]: a for a in doc.get("assets") or [] if a.get("data")}

    def _by_block(self, part: str) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for x in self.doc.get(part) or []:
            out.setdefault(x["block_id"], []).append(x)
        return out

    def _next(self) -> int:
        self.ids += 1
        return self.ids - 1

    def style(self, r: dict, height: int = 1200) -> int:
        link = bool(r.get("href")) and bool(re.match(r"(?i)(https?:|mailto:)", r["href"]))
        colour = (r.get("color") or ("#0563C1" if link else "#000000")).upper()
        if not re.fullmatch("#[0-9A-F]{6}", colour):
            colour = "#000000"
        lined = link or bool(r.get("underline"))
        if not lined and not r.get("strike") and colour == "#000000" and height == 1200:
            return 7 if r.get("bold") and r.get("italic") else 5 if r.get("bold") else 6 if r.get("italic") else 8 if r.get("code") else 0
        key = (bool(r.get("bold")), bool(r.get("italic")), lined, bool(r.get("strike")), colour, height)
        return self.styles.setdefault(key, FIRST_STYLE + len(self.styles))

    def fill(self, colour: str, side: str) -> int:
        if (colour, side) not in self.fills:
            for s in ("full", "left", "right", "both"):
                self.fills[colour, s] = FIRST_FILL + len(self.fills)
        return self.fills[colour, side]

    def text(self, s: str | None) -> str:
        s = _BAD.sub("", s or "")
        s = re.sub("[\U00010000-\U0010ffff☀-⭕]", "□", s)
        return escape(re.sub("[︀-️‍]", "", s)).replace("\n", "<hp:lineBreak/>")

    def run(self, r: dict, char: int | None = None) -> str:
        c = self.style(r) if char is None else char
        body = f'<hp:run charPrIDRef="{c}"><hp:t>{self.text(r.get("text"))}</hp:t></hp:run>' if r.get("text") else ""
        if re.match(r"(?i)(https?:|mailto:)", r.get("href") or ""):
            self.links += 1
            command = re.sub(r"([\\:?])", r"\\\1", r["href"]) + ";1;0;1;"
            begin = f'<hp:run charPrIDRef="{c}"><hp:ctrl><hp:fieldBegin id="{self.links}" fieldid="{self.links}" type="HYPERLINK" name="" editable="0" dirty="0"><hp:parameters cnt="1"><hp:stringParam name="Command">{self.text(command)}</hp:stringParam></hp:parameters></hp:fieldBegin></hp:ctrl></hp:run>'
            end = f'<hp:run charPrIDRef="{c}"><hp:ctrl><hp:fieldEnd beginIDRef="{self.links}" fieldid="{self.links}"/></hp:ctrl></hp:run>'
            body = begin + body + end
        if r.get("footnote"):
            self.notes += 1
            body += f'<hp:run charPrIDRef="0"><hp:ctrl><hp:footNote number="{self.notes}"><hp:subList>{self.para([{"text": r["footnote"]}], 0, 12)}</hp:subList></hp:footNote></hp:ctrl></hp:run>'
        return body

    def para(self, runs: list[dict], para: int = 0, char: int | None = None, lead: str = "") -> str:
        body = "".join(self.run(r, char) for r in runs) or f'<hp:run charPrIDRef="{char or 0}"><hp:t></hp:t></hp:run>'
        return f'<hp:p id="{self._next()}" paraPrIDRef="{para}" styleIDRef="0">{lead}{body}</hp:p>'

    def first(self) -> str:
        w, h = PAPERS.get(self.paper, PAPERS["A4"])
        m = " ".join(f'{k}="{v}"' for k, v in self.margins.items())
        turn = "NARROWLY" if self.landscape else "WIDELY"
        section = f'<hp:run charPrIDRef="0"><hp:secPr id="" textDirection="HORIZONTAL" spaceColumns="1134" tabStop="8000"><hp:pagePr landscape="{turn}" width="{w}" height="{h}" gutterType="LEFT_ONLY"><hp:margin {m} gutter="0"/></hp:pagePr></hp:secPr></hp:run>'
        line = f'<hp:linesegarray><hp:lineseg textpos="0" vertpos="0" vertsize="1200" textheight="1200" baseline="1020" spacing="720" horzpos="0" horzsize="{self.width}" flags="393216"/></hp:linesegarray>'
        return f'<hp:p id="{self._next()}" paraPrIDRef="0" styleIDRef="0">{section}<hp:run charPrIDRef="0"><hp:t></hp:t></hp:run>{line}</hp:p>'

    def table(self, cells: list[dict]) -> str:
        n_rows = max(c["row"] for c in cells) + 1
        by_row: dict[int, list[dict]] = {}
        for c in cells:
            by_row.setdefault(c["row"], []).append(c)
        n_cols = max(sum(max(1, c["col_span"] or 1) for c in row) for row in by_row.values())
        taken = [[False] * n_cols for _ in range(n_rows)]
        placed: dict[int, list[tuple]] = {r: [] for r in range(n_rows)}
        for r in range(n_rows):
            for c in sorted(by_row.get(r, []), key=lambda x: x["ord"]):
                at = next((i for i in range(n_cols) if not taken[r][i]), None)
                if at is None:
                    break
                across = 1
                while across < (c["col_span"] or 1) and at + across < n_cols and not taken[r][at + across]:
                    across += 1
                deep = 1
                while deep < (c["row_span"] or 1) and r + deep < n_rows and not any(taken[r + deep][at : at + across]):
                    deep += 1
                for x in range(r, r + deep):
                    taken[x][at : at + across] = [True] * across
                placed[r].append((at, across, deep, c))
        for r in range(n_rows):
            placed[r] += [(i, 1, 1, {"text": "", "is_header": False}) for i in range(n_cols) if not taken[r][i]]
            placed[r].sort(key=lambda x: x[0])
        longest = [1] * n_cols
        for row in placed.values():
            for at, across, _, c in row:
                if across == 1:
                    size = sum(2 if "ᄀ" <= ch <= "퟿" or "　" <= ch <= "〿" else 1 for ch in c.get("text") or "")
                    longest[at] = max(longest[at], min(40, size))
        usable = self.width - LEAST_COLUMN * n_cols
        widths = [self.width] if n_cols == 1 else [self.width // n_cols] * n_cols if usable <= 0 else [half_up(LEAST_COLUMN + x / sum(longest) * usable) for x in longest]
        if n_cols > 1 and usable > 0:
            widths[-1] += self.width - sum(widths)
        out = []
        for r in range(n_rows):
            row = []
            for at, across, deep, c in placed[r]:
                header = bool(c.get("is_header"))
                side = "both" if n_cols == 1 else "left" if at == 0 else "right" if at + across >= n_cols else "full"
                colour = (c.get("bg") or "").upper()
                border = self.fill(colour, side) if re.fullmatch("#[0-9A-F]{6}", colour) else 3 if header else 4
                text = (c.get("text") or "").strip()
                numeric = re.fullmatch(r"[-+]?[\d,]+(\.\d+)?%?|[₩$€¥]\s?[-+]?[\d,]+(\.\d+)?", text)
                para = self.para(list(c.get("runs") if c.get("runs") is not None and len(c["runs"]) else [{"text": c.get("text") or ""}]), 10 if header else 12 if numeric else 11, 9 if header else None)
                row.append(f'<hp:tc name="" header="{int(header)}" borderFillIDRef="{border}"><hp:subList vertAlign="CENTER">{para}</hp:subList><hp:cellAddr colAddr="{at}" rowAddr="{r}"/><hp:cellSpan colSpan="{across}" rowSpan="{deep}"/><hp:cellSz width="{sum(widths[at : at + across])}" height="1500"/></hp:tc>')
            out.append(f"<hp:tr>{''.join(row)}</hp:tr>")
        return self._wrap(f'<hp:tbl id="{self._next()}" rowCnt="{n_rows}" colCnt="{n_cols}" borderFillIDRef="4"><hp:sz width="{self.width}" height="{1500 * n_rows}"/>{"".join(out)}</hp:tbl>')

    def _wrap(self, control: str, para: int = 0) -> str:
        return f'<hp:p id="{self._next()}" paraPrIDRef="{para}" styleIDRef="0"><hp:run charPrIDRef="0">{control}<hp:t></hp:t></hp:run></hp:p>'

    def image(self, a: dict) -> str:
        number = len(self.images) + 1
        suffix = (a.get("bin_name") or "image.png").rsplit(".", 1)[-1].lower()
        w, h = a.get("width") or 40000, a.get("height") or 30000
        if w > self.width:
            w, h = self.width, half_up(h * self.width / w)
        self.images.append({"id": f"image{number}", "file": f"image{number}.{suffix}", "data": bytes(a["data"]), "mime": "image/" + ("jpg" if suffix == "jpeg" else suffix)})
        return self._wrap(f'<hp:pic id="{self._next()}"><hp:sz width="{w}" height="{h}"/><hc:img binaryItemIDRef="image{number}" bright="0" contrast="0" effect="REAL_PIC" alpha="0"/></hp:pic>', {"center": 13, "right": 14}.get(a.get("align"), 0))

    def block(self, b: dict) -> str:
        kind = b["type"]
        runs = list(b["runs"]) if b.get("runs") is not None and len(b["runs"]) else [{"text": b.get("text") or ""}]
        if kind == "heading":
            level = min(6, max(1, b.get("level") or 1))
            char, para = (level, level) if level <= 4 else (10, 15) if level == 5 else (11, 16)
            return self.para(runs, para, self.style({"bold": True, "color": b["color"]}, CHARS[char][0]) if b.get("color") else char)
        if kind == "blank":
            return self.para([])
        if kind == "hr":
            return self._wrap(f'<hp:line id="{self._next()}"><hp:sz width="{self.width}" height="100"/></hp:line>')
        if kind == "code":
            return "".join(self.para([{"text": x}], 8, 8) for x in (b.get("text") or "").split("\n"))
        if kind == "list":
            out = []
            counts: dict[int, int] = {}
            for i in self.items.get(b["block_id"], []):
                level = min(2, max(0, i.get("level") or 0))
                if i.get("ordered"):
                    counts[level] = counts.get(level, 0) + 1
                    mark = f"{i['marker'] if i.get('marker') is not None else counts[level]}. "
                else:
                    mark = ("■ " if i.get("checked") else "□ ") if i.get("task") else "· "
                own = list(i["runs"]) if i.get("runs") is not None and len(i["runs"]) else [{"text": i.get("text") or ""}]
                out.append(self.para([{"text": mark}, *own], 5 + level))
            return "".join(out)
        if kind == "table":
            cells = self.cells.get(b["block_id"])
            return self.table(cells) if cells else ""
        if kind == "image" or kind == "image-source":
            a = self.assets.get(b["block_id"])
            return self.image(a) if a else ""
        if kind == "quote":
            return ""
        return self.para(runs, 9 if b.get("depth") else {"center": 13, "right": 14}.get(b.get("align"), 0))

    def section(self) -> str:
        body = [self.first()]
        if self.doc.get("title"):
            body.append(self.para([{"text": self.doc["title"]}], 1, 1))
        body += [self.block(b) for b in self.doc.get("blocks") or []]
        return f"{DECLARATION}<hs:sec {SPACES}>{''.join(body)}</hs:sec>"

    def header(self) -> str:
        def char(i: int, height: int, bold: Any, italic: Any, colour: str | None, under: bool = False, strike: bool = False) -> str:
            inner = "<hh:bold/>" * bool(bold) + "<hh:italic/>" * bool(italic) + '<hh:underline type="BOTTOM" shape="SOLID"/>' * under + '<hh:strikeout shape="SOLID"/>' * strike
            return f'<hh:charPr id="{i}" height="{height}" textColor="{colour or "#000000"}" shadeColor="none" borderFillIDRef="2"><hh:fontRef hangul="0" latin="0"/>{inner}</hh:charPr>'

        def para(i: int, align: str, left: int, before: int, after: int) -> str:
            return f'<hh:paraPr id="{i}"><hh:align horizontal="{align}" vertical="BASELINE"/><hh:margin><hc:left value="{left}" unit="HWPUNIT"/><hc:prev value="{before}" unit="HWPUNIT"/><hc:next value="{after}" unit="HWPUNIT"/></hh:margin><hh:lineSpacing type="PERCENT" value="160"/><hh:border borderFillIDRef="2"/></hh:paraPr>'

        def fill(i: int, colour: str | None, edges: str) -> str:
            sides = "".join(f'<hh:{s}Border type="{"SOLID" if s in edges else "NONE"}" width="0.12 mm" color="#000000"/>' for s in ("left", "right", "top", "bottom"))
            return f'<hh:borderFill id="{i}">{sides}' + (f'<hc:fillBrush><hc:winBrush faceColor="{colour}" hatchColor="none" alpha="0"/></hc:fillBrush>' if colour else "") + "</hh:borderFill>"

        chars = [char(i, *v) for i, v in CHARS.items()] + [char(i, k[5], k[0], k[1], k[4], k[2], k[3]) for k, i in self.styles.items()]
        paras = [para(i, *v) for i, v in PARAS.items()]
        edges = {"full": "left right top bottom", "left": "right top bottom", "right": "left top bottom", "both": "top bottom"}
        fills = [fill(1, None, ""), fill(2, None, ""), fill(3, "#E7E6E6", edges["full"]), fill(4, None, edges["full"])] + [fill(i, c, edges[s]) for (c, s), i in self.fills.items()]
        fonts = "".join(f'<hh:fontface lang="{x}" fontCnt="1"><hh:font id="0" face="함초롬바탕" type="TTF" isEmbedded="0"/></hh:fontface>' for x in ("HANGUL", "LATIN"))
        return (
            f'{DECLARATION}<hh:head {SPACES} version="1.4" secCnt="1"><hh:beginNum page="1" footnote="1" endnote="1" pic="1" tbl="1" equation="1"/><hh:refList><hh:fontfaces itemCnt="2">{fonts}</hh:fontfaces>'
            f'<hh:borderFills itemCnt="{len(fills)}">{"".join(fills)}</hh:borderFills><hh:charProperties itemCnt="{len(chars)}">{"".join(chars)}</hh:charProperties><hh:paraProperties itemCnt="{len(paras)}">{"".join(paras)}</hh:paraProperties></hh:refList></hh:head>'
        )

    def build(self) -> bytes:
        section = self.section()
        header = self.header()
        pictures = "".join(f'<opf:item id="{i["id"]}" href="BinData/{i["file"]}" media-type="{i["mime"]}" isEmbeded="1"/>' for i in self.images)
        content = f'{DECLARATION}<opf:package xmlns:opf="http://www.idpf.org/2007/opf/" version="" unique-identifier="" id=""><opf:metadata><opf:title>{escape(_BAD.sub("", self.doc.get("title") or ""))}</opf:title></opf:metadata><opf:manifest><opf:item id="header" href="Contents/header.xml" media-type="application/xml"/>{pictures}<opf:item id="section0" href="Contents/section0.xml" media-type="application/xml"/></opf:manifest><opf:spine><opf:itemref idref="section0" linear="yes"/></opf:spine></opf:package>'
        entries = [("/", MIMETYPE), ("Contents/header.xml", "application/xml"), ("Contents/section0.xml", "application/xml"), *((f"BinData/{i['file']}", i["mime"]) for i in self.images)]
        manifest = f'{DECLARATION}<odf:manifest xmlns:odf="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" version="1.2">' + "".join(f"<odf:file-entry odf:full-path={quoteattr(p)} odf:media-type={quoteattr(m)}/>" for p, m in entries) + "</odf:manifest>"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            def add(name: str, data: str | bytes, stored: bool = False) -> None:
                info = zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0))  # the same bytes whenever it is built
                info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
                z.writestr(info, data)

            add("mimetype", MIMETYPE, True)
            for name, data in PARTS.items():
                add(name, DECLARATION + data)
            add("META-INF/manifest.xml", manifest)
            add("Contents/content.hpf", content)
            add("Contents/header.xml", header)
            add("Contents/section0.xml", section)
            add("Preview/PrvText.txt", _BAD.sub("", self.doc.get("title") or ""))
            for i in self.images:
                add(f"BinData/{i['file']}", i["data"])
        return out.getvalue()


def packaged(doc: Column, paper: str = "A4", landscape: bool = False, mm: dict[str, float] | None = None) -> Column:
    """The package of a parsed struct, as bytes; null for a document that wasn't parsed."""

    def build(docs: pa.Array) -> pa.Array:
        return pa.array([Writer(d, paper, landscape, mm).build() if d and d["status"] == "done" else None for d in docs.to_pylist()], pa.binary())

    return F.arrow_udf(build, "binary")(doc)


def problems(data: bytes | None, mm: dict[str, float] | None = None) -> list[str]:
    """What is wrong with a package: entries, type, namespaces, page, references, tables, links, pictures, checksums."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data or b""))
        bad = z.testzip()
    except (zipfile.BadZipFile, ValueError, RuntimeError) as e:
        return [f"ZIP 로드 실패: {e}"]
    names = z.namelist()
    out = [f"CRC32 불일치: {bad}"] if bad else []
    if names[:1] != ["mimetype"]:
        out.append("mimetype이 ZIP 첫 항목이 아님")
    out += [f"필수 파일 누락: {x}" for x in REQUIRED if x not in names]
    if "mimetype" in names and z.read("mimetype").decode("utf-8", "replace").strip() != MIMETYPE:
        out.append("mimetype 내용 불일치")
    if not {"Contents/header.xml", "Contents/section0.xml"} <= set(names):
        return out
    text = {n: z.read(f"Contents/{n}.xml").decode("utf-8", "replace") for n in ("header", "section0")}
    try:
        trees = {n: ET.fromstring(t) for n, t in text.items()}
    except ET.ParseError as e:
        return [*out, f"XML 파싱 오류: {e}"]
    out += [f"section0.xml: {x} 네임스페이스 없음" for x in ("section", "paragraph") if BASE + x not in text["section0"]]

    def every(tree: ET.Element, name: str) -> list[ET.Element]:
        return [e for e in tree.iter() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] == name]

    section, header = trees["section0"], trees["header"]
    page, line = every(section, "pagePr"), every(section, "lineseg")
    margin = every(section, "margin")
    if not every(section, "secPr"):
        out.append("section0.xml: hp:secPr 없음")
    if not margin:
        out.append("section0.xml: hp:margin 없음")
    else:
        got = margin[0].attrib
        out += [f"section0.xml: {k} 여백 불일치 ({got.get(k)} ≠ {v})" for k, v in margins(mm).items() if got.get(k) != str(v)]
        if page and line and not out:
            side = page[0].get("height" if page[0].get("landscape") == "NARROWLY" else "width", "0")
            wide = int(side) - int(got["left"]) - int(got["right"])
            if int(line[0].get("horzsize", "0")) != wide:
                out.append(f"section0.xml: 본문 폭 불일치 ({line[0].get('horzsize')} ≠ {wide})")
    for name in ("charPr", "paraPr", "borderFill"):
        ids = {e.get("id") for e in every(header, name)}
        used = {e.get(f"{name}IDRef") for t in (section, header) for e in t.iter() if e.get(f"{name}IDRef")}
        out += [f'{name}IDRef="{x}" 미정의' for x in sorted(used - ids)]
    for group, member in (("charProperties", "charPr"), ("paraProperties", "paraPr"), ("borderFills", "borderFill")):
        out += [f"{group}: itemCnt {e.get('itemCnt')} ≠ {len(every(e, member))}" for e in every(header, group) if e.get("itemCnt") != str(len(every(e, member)))]
    for t in every(section, "tbl"):
        seen: dict[tuple[int, int], int] = {}
        for c in every(t, "tc"):
            at, span = next(iter(every(c, "cellAddr"))), next(iter(every(c, "cellSpan")))
            for r in range(int(at.get("rowAddr")), int(at.get("rowAddr")) + int(span.get("rowSpan"))):
                for k in range(int(at.get("colAddr")), int(at.get("colAddr")) + int(span.get("colSpan"))):
                    seen[r, k] = seen.get((r, k), 0) + 1
        size = int(t.get("rowCnt")) * int(t.get("colCnt"))
        if len(seen) != size or any(n != 1 for n in seen.values()):
            out.append(f"표 격자 불일치: {t.get('id')}")
    begins = {(e.get("id"), e.get("fieldid")) for e in every(section, "fieldBegin")}
    ends = {(e.get("beginIDRef"), e.get("fieldid")) for e in every(section, "fieldEnd")}
    out += [f"링크 짝 불일치: {x}" for x in sorted(begins ^ ends, key=str)]
    content = z.read("Contents/content.hpf").decode("utf-8", "replace") if "Contents/content.hpf" in names else ""
    manifest = z.read("META-INF/manifest.xml").decode("utf-8", "replace") if "META-INF/manifest.xml" in names else ""
    for e in every(section, "img"):
        ref = e.get("binaryItemIDRef")
        item = re.search(rf'<opf:item id="{re.escape(ref)}" href="([^"]+)"', content)
        if not item:
            out.append(f"그림 {ref}: content.hpf 선언 없음")
        elif item[1] not in names or item[1] not in manifest:
            out.append(f"그림 {ref}: {item[1]} 없음")
    return out


def validated(data: Column, mm: dict[str, float] | None = None) -> Column:
    """struct<pass: boolean, issues: array<string>> of packages."""

    def run(packages: pa.Array) -> pa.Array:
        issues = [problems(d, mm) for d in packages.to_pylist()]
        return pa.array([{"pass": not i, "issues": i} for i in issues], pa.struct([("pass", pa.bool_()), ("issues", pa.list_(pa.string()))]))

    return F.arrow_udf(run, "`pass` boolean, issues array<string>")(data)


def archive(df: DataFrame, name: str, data: str, path: str) -> None:
    """Writes packages into one ZIP, one after the other: what the driver holds is a single package."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for r in df.select(name, data).where(F.col(data).isNotNull()).toLocalIterator():
            z.writestr(zipfile.ZipInfo(r[name], (2020, 1, 1, 0, 0, 0)), bytes(r[data]))
