"""The common form of a parsed document, and its flat tables.

A parser returns a Document of nested blocks. Flat tables have no recursion: a block inside a quote or a list item is named by its
path ("3.0" is the first block in the fourth), its parent's path and its depth.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

_CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")

RUN = "struct<text:string,bold:boolean,italic:boolean,code:boolean,underline:boolean,strike:boolean,color:string,href:string,title:string,footnote:string>"
BLOCK = f"struct<block_id:string,parent_id:string,depth:int,pos:int,type:string,level:int,text:string,lang:string,inline:boolean,align:string,color:string,ordered:boolean,runs:array<{RUN}>>"
ITEM = f"struct<block_id:string,pos:int,level:int,ordered:boolean,marker:int,task:boolean,checked:boolean,text:string,runs:array<{RUN}>>"
CELL = f"struct<block_id:string,row:int,ord:int,is_header:boolean,text:string,runs:array<{RUN}>,col_span:int,row_span:int,bg:string,color:string>"
ASSET = "struct<block_id:string,bin_name:string,mime:string,data:binary,source:string,width_px:int,height_px:int,width:int,height:int,alt:string,title:string,align:string,source_format:string>"
PARSED = f"struct<title:string,doc_type:string,header:string,footer:string,status:string,error:string,blocks:array<{BLOCK}>,items:array<{ITEM}>,cells:array<{CELL}>,assets:array<{ASSET}>>"

RUN_FIELDS = ("text", "bold", "italic", "code", "underline", "strike", "color", "href", "title", "footnote")


class ParseError(ValueError):
    """What makes a document an error row."""


class Unsupported(ParseError):
    """A format that can't be read here."""


def clean(s: Any) -> str:
    return _CONTROL.sub("", s if isinstance(s, str) else "" if s is None else str(s))


@dataclass
class Block:
    type: str
    text: str | None = None
    level: int | None = None
    lang: str | None = None
    inline: bool | None = None
    align: str | None = None
    color: str | None = None
    ordered: bool | None = None
    runs: list[dict] | None = None
    items: list[dict] = field(default_factory=list)
    rows: list[list[dict]] = field(default_factory=list)  # of a table, the header first
    has_header: bool = False
    blocks: list[Block] = field(default_factory=list)
    image: dict | None = None

    def plain(self) -> str:
        return self.text if self.text is not None else "".join(r.get("text") or "" for r in self.runs or [])


@dataclass
class Document:
    title: str
    doc_type: str = ""
    blocks: list[Block] = field(default_factory=list)
    header: str | None = None
    footer: str | None = None


def run(text: str, **style: Any) -> dict:
    return {"text": text} | {k: v for k, v in style.items() if v}


def cell(text: str, **more: Any) -> dict:
    return {"text": text} | {k: v for k, v in more.items() if v}


def joined_runs(runs: list[dict]) -> list[dict]:
    """Neighbours of one style as one run."""
    out: list[dict] = []
    for r in runs:
        if out and not r.get("footnote") and not out[-1].get("footnote") and {k: v for k, v in r.items() if k != "text"} == {k: v for k, v in out[-1].items() if k != "text"}:
            out[-1] = out[-1] | {"text": out[-1]["text"] + r["text"]}
        elif r.get("text") or r.get("footnote"):
            out.append(r)
    return out


def promote_title(doc: Document) -> None:
    """The first top-level heading of level 1 becomes the title and leaves the body."""
    for i, b in enumerate(doc.blocks):
        if b.type == "heading" and b.level == 1 and b.plain().strip():
            doc.title = b.plain().strip()
            del doc.blocks[i]
            return


def _runs(runs: list[dict] | None) -> list[dict] | None:
    if runs is None:
        return None
    return [{k: (clean(r[k]) if k in ("text", "color", "href", "title", "footnote") else bool(r[k])) if r.get(k) is not None else (False if k in ("bold", "italic", "code", "underline", "strike") else None) for k in RUN_FIELDS} for r in runs]


def flatten(doc: Document) -> dict:
    """The fields of PARSED."""
    out: dict = {"title": clean(doc.title), "doc_type": doc.doc_type, "header": doc.header, "footer": doc.footer, "status": "done", "error": None, "blocks": [], "items": [], "cells": [], "assets": []}

    def walk(blocks: list[Block], parent: str | None, depth: int) -> None:
        for pos, b in enumerate(blocks):
            name = str(pos) if parent is None else f"{parent}.{pos}"
            out["blocks"].append({"block_id": name, "parent_id": parent, "depth": depth, "pos": pos, "type": b.type, "level": b.level, "text": None if b.text is None else clean(b.text), "lang": b.lang, "inline": b.inline, "align": b.align, "color": b.color, "ordered": b.ordered, "runs": _runs(b.runs)})
            inner = list(b.blocks)
            for i, it in enumerate(b.items):
                out["items"].append({"block_id": name, "pos": i, "level": it.get("level", 0), "ordered": bool(it.get("ordered", b.ordered)), "marker": it.get("marker"), "task": bool(it.get("task")), "checked": bool(it.get("checked")), "text": clean(it.get("text")), "runs": _runs(it.get("runs"))})
                inner += it.get("blocks", [])
            for r, row in enumerate(b.rows):
                for c, x in enumerate(row):
                    out["cells"].append({"block_id": name, "row": r, "ord": c, "is_header": b.has_header and r == 0, "text": clean(x.get("text")), "runs": _runs(x.get("runs")), "col_span": x.get("col_span") or 1, "row_span": x.get("row_span") or 1, "bg": x.get("bg"), "color": x.get("color")})
            if b.image is not None:
                keys = ("bin_name", "mime", "data", "source", "width_px", "height_px", "width", "height", "alt", "title", "align", "source_format")
                out["assets"].append({"block_id": name} | {k: b.image.get(k) for k in keys})
            walk(inner, name, depth + 1)

    walk(doc.blocks, None, 0)
    return out


def failed(status: str, error: str, doc_type: str = "") -> dict:
    return {"title": None, "doc_type": doc_type, "header": None, "footer": None, "status": status, "error": error, "blocks": [], "items": [], "cells": [], "assets": []}
