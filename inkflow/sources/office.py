"""Zipped office formats: word documents, slides, sheets and the word processor's own package.

Parts are read on demand from the archive, and merged cells, numbering and references follow what the formats define.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from .delimited import table_of
from .ir import Block, Document, ParseError, Unsupported, cell, clean, joined_runs, run

#: Uncompressed bytes that an archive may hold.
UNZIPPED_CAP = 50 << 20
UNITS_PER_EMU = 1 / 127


def local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def attribute(e: ET.Element | None, name: str, default: str = "") -> str:
    if e is None:
        return default
    for k, v in e.attrib.items():
        if k.rsplit("}", 1)[-1] == name:
            return v
    return default


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def children(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [c for c in (e if e is not None else []) if local(c) in names]


def descendants(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [c for c in (e.iter() if e is not None else []) if local(c) in names]


class Package:
    def __init__(self, data: bytes, name: str) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError) as e:
            raise ParseError(f"{name} ZIP 열기 실패: {e}") from None
        if sum(i.file_size for i in self.zip.infolist()) > UNZIPPED_CAP:
            raise ParseError(f"{name} 압축 해제 크기 초과 (50MB)")
        self.names = self.zip.namelist()

    def xml(self, path: str) -> ET.Element | None:
        if path not in self.names:
            return None
        try:
            return ET.fromstring(self.zip.read(path))
        except ET.ParseError as e:
            raise ParseError(f"{path} XML 파싱 오류: {e}") from None

    def bytes(self, path: str) -> bytes | None:
        return self.zip.read(path) if path in self.names else None

    def relations(self, path: str) -> dict[str, tuple[str, str]]:
        """Id to target and type; targets from the archive's root, links as they are."""
        folder, name = posixpath.split(path)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in children(root, "Relationship"):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (target, r.get("Type", ""))
        return out


def hexcolour(value: str) -> str | None:
    return "#" + value.upper() if re.fullmatch(r"[0-9a-fA-F]{6}", value or "") else None


def safe(url: str) -> str | None:
    return url if re.match(r"(?i)^(https?:|mailto:)", url or "") else None


class Word:
    def __init__(self, data: bytes) -> None:
        self.package = p = Package(data, "DOCX")
        self.main = "word/document.xml"
        self.root = p.xml(self.main)
        if self.root is None:
            raise ParseError("DOCX 파싱 오류: word/document.xml 없음")
        self.relation = p.relations(self.main)
        self.styles = {attribute(s, "styleId"): attribute(child(s, "name"), "val") for s in children(p.xml("word/styles.xml"), "style")}
        numbering = p.xml("word/numbering.xml")
        levels = {}
        for a in children(numbering, "abstractNum"):
            for lvl in children(a, "lvl"):
                form = attribute(child(lvl, "numFmt"), "val")
                start = attribute(child(lvl, "start"), "val", "1")
                levels[attribute(a, "abstractNumId"), attribute(lvl, "ilvl")] = (form not in ("bullet", "none", "chicago", ""), int(start) if start.isdigit() else 1)
        self.numbers = {(attribute(n, "numId"), k[1]): v for n in children(numbering, "num") for k, v in levels.items() if k[0] == attribute(child(n, "abstractNumId"), "val")}
        self.notes = {attribute(n, "id"): self._text(n) for n in children(p.xml("word/footnotes.xml"), "footnote") if attribute(n, "id") not in ("-1", "0")}
        self.comments = {attribute(n, "id"): f"[주석] {attribute(n, 'author')}: {self._text(n)}" for n in children(p.xml("word/comments.xml"), "comment")}
        self.images = 0

    @staticmethod
    def _text(e: ET.Element) -> str:
        return " ".join(x for x in ("".join(t.text or "" for t in descendants(q, "t")) for q in descendants(e, "p")) if x).strip()

    def _toggle(self, props: ET.Element | None, name: str) -> bool:
        e = child(props, name)
        return e is not None and attribute(e, "val", "1").lower() not in ("0", "false", "off", "none")

    def runs(self, e: ET.Element, href: str | None = None) -> list[dict]:
        out: list[dict] = []
        for c in e:
            kind = local(c)
            if kind == "r":
                props = child(c, "rPr")
                style = {"bold": self._toggle(props, "b"), "italic": self._toggle(props, "i"), "underline": self._toggle(props, "u"), "strike": self._toggle(props, "strike"), "color": hexcolour(attribute(child(props, "color"), "val")), "href": href}
                for x in c:
                    name = local(x)
                    if name == "t":
                        out.append(run(x.text or "", **style))
                    elif name == "tab":
                        out.append(run("\t", **style))
                    elif name in ("br", "cr"):
                        out.append(run("\n", **style))
                    elif name == "footnoteReference" and attribute(x, "id") in self.notes:
                        out.append(run("", footnote=self.notes[attribute(x, "id")]))
                    elif name == "commentReference" and attribute(x, "id") in self.comments:
                        out.append(run("", footnote=self.comments[attribute(x, "id")]))
            elif kind == "hyperlink":
                target = self.relation.get(attribute(c, "id"), ("", ""))[0]
                out += self.runs(c, safe(target) or href)
            elif kind in ("ins", "sdt", "sdtContent", "smartTag"):
                out += self.runs(c, href)
        return joined_runs(out)

    def _image(self, drawing: ET.Element) -> Block | None:
        blip = next(iter(descendants(drawing, "blip")), None)
        target = self.relation.get(attribute(blip, "embed"), ("", ""))[0]
        data = self.package.bytes(target)
        if data is None:
            return None
        suffix = target.rsplit(".", 1)[-1].lower()
        alt = attribute(next(iter(descendants(drawing, "docPr")), None), "descr")
        if suffix in ("wmf", "emf", "webp"):
            return Block("para", text=f"[이미지: {alt or posixpath.basename(target)}]")
        extent = next(iter(descendants(drawing, "extent")), None)
        w, h = (int(int(attribute(extent, k, "0") or 0) * UNITS_PER_EMU) for k in ("cx", "cy"))
        self.images += 1
        return Block("image", image={"bin_name": f"image{self.images}.{suffix}", "mime": f"image/{'jpeg' if suffix == 'jpg' else suffix}", "data": data, "width": w, "height": h, "alt": alt, "source_format": "docx"})

    def paragraph(self, p: ET.Element) -> list[tuple[Block, tuple | None]]:
        """Blocks; of a list item also (number id, level)."""
        images = [b for d in descendants(p, "drawing") if (b := self._image(d))]
        out: list[tuple[Block, tuple | None]] = [(b, None) for b in images]
        runs = self.runs(p)
        text = "".join(r["text"] for r in runs).strip()
        props = child(p, "pPr")
        style = attribute(child(props, "pStyle"), "val")
        name = self.styles.get(style, style)
        number = child(props, "numPr")
        align = {"center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "justify"}.get(attribute(child(props, "jc"), "val"))
        outline = attribute(child(props, "outlineLvl"), "val")
        if not text and not any(r.get("footnote") for r in runs):
            return out or [(Block("blank"), None)]
        colours = {r.get("color") for r in runs if r["text"].strip()}
        colour = colours.pop() if len(colours) == 1 else None
        title = bool(re.search(r"(?i)^title$|^제목$", name))
        if number is not None and attribute(child(number, "numId"), "val") not in ("", "0"):
            key = (attribute(child(number, "numId"), "val"), attribute(child(number, "ilvl"), "val", "0"))
            out.append((Block("para", runs=runs), key))
        elif re.search(r"(?i)heading|제목|title", name):
            digit = re.search(r"(\d)", name)
            block = Block("heading", text=text, level=min(6, max(1, int(digit[1]))) if digit else 1, color=colour)
            block.inline = True if title and not digit else None  # a document title
            out.append((block, None))
        elif outline.isdigit() and int(outline) <= 8:
            out.append((Block("heading", text=text, level=min(6, int(outline) + 1), color=colour), None))
        elif all(r.get("bold") for r in runs if r["text"].strip()) and not any(r.get("color") or r.get("underline") or r.get("strike") for r in runs):
            out.append((Block("heading", text=text, level=3), None))
        else:
            out.append((Block("para", runs=runs, align=align), None))
        return out

    def table(self, t: ET.Element) -> Block | None:
        grid: list[list[dict]] = []
        open_at: dict[int, dict] = {}  # column to the cell that is merged down
        for tr in children(t, "tr"):
            row, column, still = [], 0, {}
            for tc in children(tr, "tc"):
                props = child(tc, "tcPr")
                span = max(1, int(attribute(child(props, "gridSpan"), "val", "1") or 1))
                merge = child(props, "vMerge")
                going = merge is not None and attribute(merge, "val", "continue") == "continue"
                if going and column in open_at:
                    open_at[column]["row_span"] += 1
                    still[column] = open_at[column]
                else:
                    runs = joined_runs([r for q in children(tc, "p") for r in self.runs(q)])
                    text = "\n".join("".join(r["text"] for r in self.runs(q)) for q in children(tc, "p")).strip()
                    own = cell(text, runs=runs if any(len(r) > 1 for r in runs) else None, col_span=span, bg=hexcolour(attribute(child(props, "shd"), "fill"))) | {"row_span": 1}
                    row.append(own)
                    if merge is not None:
                        still[column] = own
                column += span
            open_at = still
            grid.append(row)
        return Block("table", rows=grid, has_header=bool(grid)) if any(grid) else None

    def parse(self) -> Document:
        doc = Document("제목 없음", "docx")
        for kind in ("header", "footer"):
            target = next((t for t, k in self.relation.values() if k.endswith("/" + kind)), None)
            part = self.package.xml(target) if target else None
            if part is not None:
                setattr(doc, kind, self._text(part) or None)
        found: list[tuple[Block, tuple | None]] = []
        for e in child(self.root, "body") if child(self.root, "body") is not None else []:
            if local(e) == "p":
                found += self.paragraph(e)
            elif local(e) == "tbl" and (t := self.table(e)):
                found.append((t, None))
            elif local(e) == "sdt":
                for q in children(child(e, "sdtContent"), "p"):
                    found += self.paragraph(q)
        doc.blocks = grouped(found, self.numbers)
        for i, b in enumerate(doc.blocks):
            if b.type == "heading" and b.inline:
                doc.title = b.text or doc.title
                del doc.blocks[i]
                break
        for b in doc.blocks:
            if b.type == "heading":
                b.inline = None
        return doc


def grouped(found: list[tuple[Block, tuple | None]], numbers: dict[tuple, tuple[bool, int]]) -> list[Block]:
    """Neighbouring list items as one list, numbered level by level from each level's start.

    An ordered item ends the counts of deeper levels, an unordered one its own level's.
    """
    out: list[Block] = []
    counts: dict[int, int] = {}
    for block, key in found:
        if key is None:
            out.append(block)
            counts = {}
            continue
        ordered, start = numbers.get(key, (False, 1))
        level = int(key[1]) if key[1].isdigit() else 0
        if not out or out[-1].type != "list" or not out[-1].items or out[-1].inline is not None:
            out.append(Block("list", ordered=ordered))
        if ordered:
            counts = {k: v for k, v in counts.items() if k <= level}
            counts[level] = counts.get(level, start - 1) + 1
        else:
            counts.pop(level, None)
        out[-1].items.append({"text": block.plain(), "runs": block.runs if any(len(r) > 1 for r in block.runs or []) else None, "level": level, "ordered": ordered, "marker": counts.get(level) if ordered else None})
    return out


def parse_docx(data: bytes) -> Document:
    return Word(data).parse()


class Slides:
    def __init__(self, data: bytes) -> None:
        self.package = Package(data, "PPTX")
        self.images = 0

    def order(self) -> list[str]:
        main = "ppt/presentation.xml"
        relation = self.package.relations(main)
        ids = [next((v for k, v in s.attrib.items() if k.endswith("}id")), "") for s in descendants(self.package.xml(main), "sldId")]
        listed = [relation[i][0] for i in ids if i in relation]
        listed = [x for x in listed if x in self.package.names]
        return listed or sorted((n for n in self.package.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))

    @staticmethod
    def text(e: ET.Element | None) -> str:
        return "".join(t.text or "" for t in descendants(e, "t"))

    def shapes(self, tree: ET.Element, path: str, relation: dict, out: list) -> None:
        """('title' | 'item' | 'para', text, level, ordered) or ('block', block)."""
        for e in tree:
            kind = local(e)
            if kind == "grpSp":
                self.shapes(e, path, relation, out)
            elif kind == "sp":
                place = attribute(next(iter(descendants(child(e, "nvSpPr"), "ph")), None), "type")
                for p in children(child(e, "txBody"), "p"):
                    text = clean(self.text(p)).strip()
                    if not text:
                        continue
                    props = child(p, "pPr")
                    bullet = (child(props, "buChar") is not None or child(props, "buAutoNum") is not None) and child(props, "buNone") is None
                    level = min(2, max(0, int(attribute(props, "lvl", "0") or 0)))
                    if place in ("title", "ctrTitle"):
                        out.append(("title", text, 0, False))
                    elif bullet:
                        out.append(("item", text, level, child(props, "buAutoNum") is not None))
                    else:
                        out.append(("para", text, 0, False))
            elif kind == "graphicFrame":
                for t in descendants(e, "tbl")[:1]:
                    if b := self.table(t):
                        out.append(("block", b))
            elif kind == "pic":
                target = relation.get(attribute(next(iter(descendants(e, "blip")), None), "embed"), ("", ""))[0]
                data = self.package.bytes(target)
                if data is None:
                    continue
                extent = next(iter(descendants(e, "ext")), None)
                w, h = (int(int(attribute(extent, k, "0") or 0) * UNITS_PER_EMU) for k in ("cx", "cy"))
                suffix = target.rsplit(".", 1)[-1].lower()
                alt = attribute(child(e, "nvPicPr", "cNvPr"), "descr")
                if suffix in ("wmf", "emf", "webp"):
                    out.append(("para", f"[이미지: {alt or posixpath.basename(target)}]", 0, False))
                    continue
                self.images += 1
                out.append(("block", Block("image", image={"bin_name": f"image{self.images}.{suffix}", "mime": f"image/{'jpeg' if suffix == 'jpg' else suffix}", "data": data, "width": w or 40000, "height": h or 30000, "alt": alt, "source_format": "pptx"})))

    def table(self, t: ET.Element) -> Block | None:
        rows: list[list[dict]] = []
        owner: dict[tuple[int, int], dict] = {}
        for r, tr in enumerate(children(t, "tr")):
            row = []
            for c, tc in enumerate(children(tr, "tc")):
                right, down = (attribute(tc, k) in ("1", "true") for k in ("hMerge", "vMerge"))
                above = owner.get((r - 1, c))
                if right and c and not down:
                    own = owner.get((r, c - 1))
                    if own is not None:
                        own["col_span"] += own["at"] == (r, own["at"][1])
                elif down and above is not None:
                    own = above
                    if own["at"][1] == c:
                        own["row_span"] += 1
                elif right and above is not None:
                    own = above
                else:
                    own = cell(clean("\n".join(self.text(p) for p in descendants(tc, "p"))).strip(), bg=hexcolour(attribute(child(tc, "tcPr", "solidFill", "srgbClr"), "val"))) | {"col_span": 1, "row_span": 1, "at": (r, c)}
                    row.append(own)
                if own is not None:
                    owner[r, c] = own
            rows.append(row)
        for row in rows:
            for own in row:
                own.pop("at", None)
        return Block("table", rows=rows, has_header=True) if any(rows) else None

    def parse(self) -> Document:
        doc = Document("", "pptx")
        slides = self.order()
        if not slides:
            raise ParseError("PPTX 파싱 오류: 슬라이드 없음")
        for n, path in enumerate(slides, 1):
            root, relation = self.package.xml(path), self.package.relations(path)
            found: list = []
            tree = next(iter(descendants(root, "spTree")), None)
            if tree is not None:
                self.shapes(tree, path, relation, found)
            notes = next((t for t, k in relation.values() if k.endswith("/notesSlide")), None)
            said = "\n".join(x for sp in descendants(self.package.xml(notes) if notes else None, "sp") if attribute(next(iter(descendants(sp, "ph")), None), "type") not in ("sldNum", "dt", "hdr", "ftr") for p in descendants(sp, "p") if (x := self.text(p).strip()))
            if not found and not said:
                continue
            doc.blocks.append(Block("heading", text=f"슬라이드 {n}", level=2))
            items: list[dict] = []
            for kind, what, *more in [*found, ("end", None)]:
                if kind == "item":
                    items.append({"text": what, "level": more[0], "ordered": more[1], "marker": None})
                    continue
                if items:
                    doc.blocks.append(Block("list", ordered=items[0]["ordered"], items=items))
                    items = []
                if kind == "title":
                    doc.blocks.append(Block("heading", text=what, level=3))
                elif kind == "para":
                    doc.blocks.append(Block("para", text=what))
                elif kind == "block":
                    doc.blocks.append(what)
            if said:
                doc.blocks.append(Block("para", text=f"[발표자 노트] {said}"))
        return doc


def parse_pptx(data: bytes) -> Document:
    return Slides(data).parse()


def parse_xlsx(data: bytes) -> Document:
    """The first sheet alone, with the values that formulas had when it was saved."""
    if data[:4] == b"\xd0\xcf\x11\xe0":
        raise Unsupported("XLS 파싱 오류: 옛 바이너리 형식은 지원하지 않는 포맷입니다")
    p = Package(data, "XLSX")
    book = p.xml("xl/workbook.xml")
    sheet = next(iter(descendants(book, "sheet")), None)
    if sheet is None:
        raise ParseError("XLSX 파싱 오류: 시트 없음")
    relation = p.relations("xl/workbook.xml")
    rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), "")
    root = p.xml(relation.get(rid, ("xl/worksheets/sheet1.xml", ""))[0])
    shared = ["".join(t.text or "" for t in descendants(s, "t")) for s in children(p.xml("xl/sharedStrings.xml"), "si")]
    rows: list[list[str]] = []
    for r in descendants(root, "row"):
        row: list[str] = []
        for c in children(r, "c"):
            at = 0
            for letter in re.match(r"[A-Z]*", c.get("r", "")).group():
                at = at * 26 + ord(letter) - 64
            row += [""] * (max(at - 1, 0) - len(row))
            kind, value = c.get("t", "n"), child(c, "v")
            raw = value.text or "" if value is not None else ""
            if kind == "s":
                raw = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
            elif kind == "inlineStr":
                raw = "".join(t.text or "" for t in descendants(c, "t"))
            elif kind == "b":
                raw = "TRUE" if raw == "1" else "FALSE"
            row.append(raw)
        if any(x.strip() for x in row):
            rows.append(row)
    block = table_of(rows)
    return Document(sheet.get("name") or "스프레드시트", "xlsx", [block] if block else [])


_SECTIONS = [re.compile(x, re.I) for x in (r"^Contents/section\d+\.xml$", r"^BodyText/Section\d+$", r"^Section\d+\.xml$")]


def _package_table(t: ET.Element) -> Block | None:
    rows, header = [], False
    for r, tr in enumerate(children(t, "tr")):
        row = []
        for c, tc in enumerate(children(tr, "tc")):
            if r == c == 0:
                header = tc.get("header") == "1"
            span = child(tc, "cellSpan")
            text = "\n".join("".join(x.text or "" for x in descendants(q, "t")) for q in descendants(tc, "p")).strip()
            row.append(cell(text, col_span=int(attribute(span, "colSpan", "1") or 1), row_span=int(attribute(span, "rowSpan", "1") or 1)))
        if row:
            rows.append(row)
    return Block("table", rows=rows, has_header=header and len(rows) > 1) if rows else None


def parse_hwp(data: bytes) -> Document:
    if data[:4] == b"\xd0\xcf\x11\xe0":
        if len(data) < 512:
            raise ParseError("HWP5 바이너리 파일이 손상되었습니다")
        raise Unsupported("HWP5 바이너리를 열지 못했습니다: 지원하지 않는 포맷")
    if data[:2] != b"PK":
        raise ParseError("알 수 없는 HWP 파일 구조입니다")
    p = Package(data, "HWPX")
    doc = Document("", "hwpx")
    for path in sorted(n for n in p.names if any(s.match(n) for s in _SECTIONS)):
        root = p.xml(path)
        section = root if local(root) == "sec" else next(iter(descendants(root, "sec")), root)
        for e in children(section, "p"):
            tables = descendants(e, "tbl")
            if tables:
                if b := _package_table(tables[0]):
                    doc.blocks.append(b)
                continue
            text = clean("".join("".join(t.itertext()) for t in descendants(e, "t"))).strip()
            level = e.get("paraPrIDRef", "0")
            if not text:
                doc.blocks.append(Block("blank"))
            elif level in ("1", "2", "3", "4"):
                if not doc.title:
                    doc.title = text
                else:
                    doc.blocks.append(Block("heading", text=text, level=int(level)))
            else:
                doc.blocks.append(Block("para", text=text))
    if not doc.title and not any(b.type != "blank" for b in doc.blocks):
        raise ParseError("HWPX에서 변환 가능한 본문 텍스트를 추출하지 못했습니다")
    doc.title = doc.title or "HWP 문서"
    return doc

