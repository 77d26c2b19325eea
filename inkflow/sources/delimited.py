"""Comma- and tab-separated text to a table, and JSON values to blocks."""

from __future__ import annotations

import json
import math
from decimal import Decimal
from typing import Any

from .ir import Block, Document, ParseError, cell, clean


def _unquoted(text: str, records: int) -> tuple[int, int]:
    """Commas and tabs outside quotes in the first records."""
    commas = tabs = seen = 0
    quoted = False
    for c in text:
        if c == '"':
            quoted = not quoted
        elif not quoted:
            commas += c == ","
            tabs += c == "\t"
            if c == "\n":
                seen += 1
                if seen >= records:
                    break
    return commas, tabs


def delimiter(text: str) -> str:
    commas, tabs = _unquoted(text, 20)
    return "\t" if tabs > commas else ","


def csv_rows(text: str, separator: str) -> list[list[str]]:
    """Records of cells; a quote anywhere opens a quoted stretch, in which separators and newlines are text and two quotes are one."""
    rows: list[list[str]] = []
    row: list[str] = []
    part: list[str] = []
    at, n = 0, len(text)

    def end_row() -> None:
        row.append("".join(part))
        if any(c.strip() for c in row):
            rows.append(list(row))
        row.clear()
        part.clear()

    while at < n:
        stops = [i for i in (text.find(m, at) for m in ('"', separator, "\n", "\r")) if i >= 0]
        stop = min(stops, default=n)
        part.append(text[at:stop])
        if stop == n:
            at = n
            break
        mark = text[stop]
        at = stop + 1
        if mark == '"':
            while True:
                end = text.find('"', at)
                if end < 0:
                    raise ParseError("CSV 파싱 오류: 닫히지 않은 따옴표")
                part.append(text[at:end])
                at = end + 1
                if text[at : at + 1] != '"':
                    break
                part.append('"')
                at += 1
        elif mark == separator:
            row.append("".join(part))
            part.clear()
        else:
            if mark == "\r" and text[at : at + 1] == "\n":
                at += 1
            end_row()
    if row or part:
        end_row()
    return rows


def table_of(rows: list[list[str]]) -> Block | None:
    """Rows padded to the widest, the first as header; a single row is a list."""
    if not rows:
        return None
    width = max(map(len, rows))
    padded = [[clean(c) for c in r] + [""] * (width - len(r)) for r in rows]
    if len(padded) == 1:
        return Block("list", ordered=False, items=[{"text": c} for c in padded[0] if c])
    return Block("table", rows=[[cell(c) for c in r] for r in padded], has_header=True)


def parse_csv(text: str) -> Document:
    block = table_of(csv_rows(text, delimiter(text)))
    return Document("스프레드시트", "csv", [block] if block else [])


def number_text(x: float | int) -> str:
    """A number as a script engine prints it: the shortest digits that give it back, plain from 1e-6 to below 1e21, else with an exponent."""
    try:
        x = float(x)
    except OverflowError:
        return "Infinity" if x > 0 else "-Infinity"
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if not x:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    shown = "".join(map(str, digits))
    point = len(shown) + exponent  # digits before the point
    if 0 < point <= 21:
        out = shown.ljust(point, "0") if len(shown) <= point else f"{shown[:point]}.{shown[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + shown
    else:
        out = shown[0] + ("." + shown[1:] if len(shown) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + out


def scalar_text(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(v)
    return v


def _value_text(v: Any) -> str:
    if v is None:
        return ""
    return compact(v) if isinstance(v, (dict, list)) else scalar_text(v)


def compact(v: Any) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{compact(v[k])}" for k in key_order(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(compact, v)) + "]"
    return json.dumps(v, ensure_ascii=False) if isinstance(v, str) else scalar_text(v)


def key_order(v: dict) -> list[str]:
    """Keys that are array indices come first, by number; the others as written."""
    index = [k for k in v if k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1]
    return sorted(index, key=int) + [k for k in v if k not in set(index)]


def _is_scalar(v: Any) -> bool:
    return not isinstance(v, (dict, list))


def json_blocks(v: Any, blocks: list[Block], depth: int = 0) -> None:
    level = min(depth + 2, 6)
    if isinstance(v, list):
        if all(map(_is_scalar, v)):
            blocks.append(Block("list", ordered=False, items=[{"text": scalar_text(x)} for x in v]))
        elif all(isinstance(x, dict) for x in v):
            keys = list(dict.fromkeys(k for x in v for k in key_order(x)))
            blocks.append(Block("table", rows=[[cell(k) for k in keys]] + [[cell(_value_text(x.get(k))) for k in keys] for x in v], has_header=True))
        else:
            for i, x in enumerate(v):
                blocks.append(Block("heading", text=f"[{i}]", level=level))
                json_blocks(x, blocks, depth + 1)
    elif isinstance(v, dict):
        keys = key_order(v)
        flat = [k for k in keys if _is_scalar(v[k])]
        if flat:
            blocks.append(Block("table", rows=[[cell("키"), cell("값")]] + [[cell(k), cell(_value_text(v[k]))] for k in flat], has_header=True))
        for k in keys:
            if not _is_scalar(v[k]):
                blocks.append(Block("heading", text=k, level=level))
                json_blocks(v[k], blocks, depth + 1)
    else:
        blocks.append(Block("para", text=scalar_text(v)))


def _given_runs(runs: Any) -> list[dict] | None:
    if not isinstance(runs, list):
        return None
    keys = ("bold", "italic", "code", "underline", "strike", "color", "href", "title", "footnote")
    return [{"text": clean(r.get("text"))} | {k: r[k] for k in keys if r.get(k)} if isinstance(r, dict) else {"text": clean(r)} for r in runs]


def _given_cell(c: Any) -> dict:
    if isinstance(c, dict):
        return cell(clean(c.get("text")), runs=_given_runs(c.get("runs")), col_span=c.get("colSpan"), row_span=c.get("rowSpan"), bg=c.get("bg"), color=c.get("color"))
    return cell("" if c is None else scalar_text(c) if _is_scalar(c) else compact(c))


def given_blocks(values: list[Any]) -> list[Block]:
    """Blocks that a JSON document spells out."""
    out = []
    for v in values:
        if not isinstance(v, dict):
            out.append(Block("para", text="" if v is None else scalar_text(v) if _is_scalar(v) else compact(v)))
            continue
        b = Block(str(v.get("type") or "para"), text=v["text"] if isinstance(v.get("text"), str) else None, level=v.get("level") if isinstance(v.get("level"), int) else None, lang=v.get("lang"), align=v.get("align"), color=v.get("color"), ordered=v.get("ordered"), runs=_given_runs(v.get("runs")))
        if isinstance(v.get("items"), list):
            b.items = [{"text": clean(x.get("text")), "runs": _given_runs(x.get("runs")), "level": x.get("level") or 0, "marker": x.get("marker"), "task": x.get("task"), "checked": x.get("checked")} | ({"ordered": x["ordered"]} if "ordered" in x else {}) if isinstance(x, dict) else {"text": scalar_text(x)} for x in v["items"]]
        if isinstance(v.get("rows"), list):
            b.has_header = bool(v.get("header"))
            b.rows = [[_given_cell(c) for c in r] for r in ([v["header"]] if v.get("header") else []) + v["rows"] if isinstance(r, list)]
        if isinstance(v.get("blocks"), list):
            b.blocks = given_blocks(v["blocks"])
        out.append(b)
    return out


def parse_json(text: str) -> Document:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise ParseError(f"JSON 파싱 오류: {e}") from None
    if isinstance(value, dict) and isinstance(value.get("blocks"), list):
        return Document(clean(value.get("title")) or "제목 없음", str(value.get("doc_type") or "json"), given_blocks(value["blocks"]))
    doc = Document("JSON 문서", "json")
    if isinstance(value, dict) and isinstance(value.get("title"), str):
        doc.title = value.pop("title")
    json_blocks(value, doc.blocks)
    return doc
