"""Smallest office files that hold given paragraphs, rows or slides: inputs for round trips."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = f'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="{_R}"'
_S = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_R}"'
_P = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{_R}"'
_RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def docx(lines: list[str]) -> bytes:
    """The first line as a heading, the others as numbered items on two levels in turn, and all as a table of one column that is merged down."""
    numbered = "".join(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{i % 2}"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{escape(x)}</w:t></w:r></w:p>' for i, x in enumerate(lines[1:]))
    rows = "".join(f'<w:tr><w:tc><w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge{" w:val=" + chr(34) + "restart" + chr(34) if not i else ""}/></w:tcPr><w:p/></w:tc></w:tr>' for i, x in enumerate(lines))
    levels = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl>' for i in (0, 1))
    return _zip({
        "word/document.xml": f'<w:document {_W}><w:body><w:p><w:pPr><w:outlineLvl w:val="1"/></w:pPr><w:r><w:t>{escape(lines[0])}</w:t></w:r></w:p>{numbered}<w:tbl>{rows}</w:tbl></w:body></w:document>',
        "word/numbering.xml": f'<w:numbering {_W}><w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    })


def xlsx(lines: list[str]) -> bytes:
    """A row a line: its number, the line as a shared string, and its length as a formula's value."""
    strings = "".join(f"<si><t>{escape(x)}</t></si>" for x in lines)
    rows = "".join(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{i}</v></c><c r="B{i + 1}" t="s"><v>{i}</v></c><c r="D{i + 1}"><f>LEN(B{i + 1})</f><v>{len(x)}</v></c></row>' for i, x in enumerate(lines))
    return _zip({
        "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="Lines" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _RELATIONS.format('<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {_S}>{strings}</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{rows}</sheetData></worksheet>",
    })


def pptx(lines: list[str]) -> bytes:
    """A slide a line, in reverse order of their files, with the line as title and its words as bullets."""
    n = len(lines)
    parts = {
        "ppt/presentation.xml": f'<p:presentation {_P}><p:sldIdLst>{"".join(f"<p:sldId id={chr(34)}{300 + i}{chr(34)} r:id={chr(34)}s{n - i}{chr(34)}/>" for i in range(n))}</p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _RELATIONS.format("".join(f'<Relationship Id="s{i}" Type="slide" Target="slides/slide{i}.xml"/>' for i in range(1, n + 1))),
    }
    for i, line in enumerate(lines):
        bullets = "".join(f'<a:p><a:pPr><a:buChar char="-"/></a:pPr><a:r><a:t>{escape(w)}</a:t></a:r></a:p>' for w in line.split())
        title = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p></p:txBody></p:sp>'
        parts[f"ppt/slides/slide{n - i}.xml"] = f"<p:sld {_P}><p:cSld><p:spTree>{title}<p:sp><p:txBody>{bullets}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    return _zip(parts)


def built(kind: Callable[[list[str]], bytes], lines: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([kind([str(x) for x in own]) for own in batch], dtype=object)

    return F.pandas_udf(run, "binary")(lines)
