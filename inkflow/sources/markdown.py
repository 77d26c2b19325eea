"""Markdown to blocks: a block tokenizer (headings, fences, lists, quotes, tables, rules, paragraphs, raw HTML) and an inline one
(code, emphasis, strike, links, images, autolinks, escapes, hard breaks, footnote marks). Corners of CommonMark that it leaves out: link
reference definitions, HTML blocks that start inside a paragraph, and lazy continuation of quotes after lists.
"""

from __future__ import annotations

import re

from .html import Tree, walk
from .ir import Block, Document, cell, joined_runs, promote_title, run

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)[^`]*$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"^( {0,3}|\t)?([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*))?$")
_TASK = re.compile(r"^\[([ xX])\][ \t]+(.*)$", re.S)
_DIVIDER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_NOTE = re.compile(r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_HTML = re.compile(r"^ {0,3}<(/?[a-zA-Z][\w-]*|!--)")
_SAFE = re.compile(r"^(https?:|mailto:|#)", re.I)
_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<tick>`+)(?P<code>.+?)(?<!`)(?P=tick)(?!`)|(?P<image>!\[(?P<alt>[^\]]*)\]\((?P<src><[^>]*>|(?:[^\s()]|\([^\s()]*\))*)(?:\s+[\"'](?P<ititle>[^\"']*)[\"'])?\s*\))"
    r"|(?P<note>\[\^(?P<nid>[^\]\s]+)\])|(?P<link>\[(?P<label>(?:[^\[\]]|\[[^\[\]]*\])*)\]\((?P<href><[^>]*>|(?:[^\s()]|\([^\s()]*\))*)(?:\s+[\"'](?P<ltitle>[^\"']*)[\"'])?\s*\))"
    r"|(?P<auto><(?P<url>(?:https?://|mailto:)[^\s<>]+)>)|(?P<br><br\s*/?>|(?: {2,}|\\)\n)|(?P<tag></?[a-zA-Z][^<>]*>)"
    r"|(?P<both>\*\*\*(?=\S)(?P<both_t>.+?)(?<=\S)\*\*\*)|(?P<bold>\*\*(?=\S)(?P<bold_t>.+?)(?<=\S)\*\*(?!\*)|__(?=\S)(?P<bold_u>.+?)(?<=\S)__(?!\w))"
    r"|(?P<em>\*(?=[^\s*])(?P<em_t>(?:[^*]|\*\*[^*]+\*\*)+?)(?<=\S)\*(?!\*)|(?<!\w)_(?=\S)(?P<em_u>[^_]+?)(?<=\S)_(?!\w))|(?P<strike>~~(?=\S)(?P<strike_t>.+?)(?<=\S)~~)"
    r"|(?P<bare>https?://[^\s<>\"')\]]+[^\s<>\"')\].,;:!?])",
    re.S,
)
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _decoded(s: str) -> str:
    for name, mark in _ENTITIES:
        s = s.replace(name, mark)
    return s


def inline(text: str, notes: dict[str, str], style: dict | None = None) -> list[dict]:
    """Runs; an image is a run with the key image."""
    style = style or {}
    out: list[dict] = []
    at = 0

    def plain(s: str) -> None:
        if s:
            out.append(run(_decoded(re.sub(r" *\n *", " ", s)), **style))

    for m in _INLINE.finditer(text):
        plain(text[at : m.start()])
        at = m.end()
        if m["escape"]:
            out.append(run(m["escape"][1], **style))
        elif m["tick"]:
            code = m["code"].replace("\n", " ")
            out.append(run(code[1:-1] if code[:1] == code[-1:] == " " and code.strip() else code, **style | {"code": True}))
        elif m["image"]:
            out.append({"text": "", "image": {"source": m["src"].strip("<>"), "alt": m["alt"], "title": m["ititle"]}})
        elif m["note"]:
            if m["nid"] in notes:
                out.append(run("", **style | {"footnote": notes[m["nid"]]}))
            else:
                plain(m["note"])
        elif m["link"]:
            href = _decoded(m["href"].strip("<>"))
            own = style | ({"href": href, "title": m["ltitle"]} if _SAFE.match(href) else {})
            out += inline(m["label"], notes, own)
        elif m["auto"] or m["bare"]:
            url = m["url"] or m["bare"]
            out.append(run(url, **style | {"href": url}))
        elif m["br"]:
            out.append(run("\n", **style))
        elif m["both"]:
            out += inline(m["both_t"], notes, style | {"bold": True, "italic": True})
        elif m["bold"]:
            out += inline(m["bold_t"] or m["bold_u"], notes, style | {"bold": True})
        elif m["em"]:
            out += inline(m["em_t"] or m["em_u"], notes, style | {"italic": True})
        elif m["strike"]:
            out += inline(m["strike_t"], notes, style | {"strike": True})
    plain(text[at:])
    return joined_runs([r for r in out if "image" not in r]) if not any("image" in r for r in out) else out


def emphasis(text: str) -> list[dict]:
    """Runs of a text with bold, italic and strike marks alone."""
    out, at = [], 0
    for m in re.finditer(r"\*\*(.+?)\*\*|\*(.+?)\*|~~(.+?)~~", text):
        if m.start() > at:
            out.append(run(text[at : m.start()]))
        out.append(run(m[1], bold=True) if m[1] else run(m[2], italic=True) if m[2] else run(m[3], strike=True))
        at = m.end()
    return out + ([run(text[at:])] if at < len(text) else [])


def _styled(runs: list[dict]) -> bool:
    return any(k != "text" for r in runs for k in r)


def _text(runs: list[dict]) -> str:
    return "".join(r["text"] for r in runs)


def _paragraph(text: str, notes: dict[str, str]) -> list[Block]:
    out: list[Block] = []
    part: list[dict] = []

    def close() -> None:
        runs = joined_runs(part)
        part.clear()
        if not _text(runs).strip() and not any(r.get("footnote") for r in runs):
            return
        if len(runs) == 1 and runs[0].get("code"):
            out.append(Block("code", text=runs[0]["text"], inline=True))
        else:
            out.append(Block("para", runs=runs))

    for r in inline(text.strip(), notes):
        if "image" in r:
            close()
            out.append(Block("image-source", image=r["image"] | {"source_format": "md"}))
        else:
            part.append(r)
    close()
    return out


def _split_row(line: str) -> list[str]:
    line = line.strip().strip("|") if not line.strip().endswith(r"\|") else line.strip().lstrip("|")
    return [c.strip().replace(r"\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def _cell(text: str, notes: dict[str, str]) -> dict:
    runs = [r for r in inline(text, notes) if "image" not in r]
    return cell(_text(runs), runs=runs if _styled(runs) else None)


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())


def _list(lines: list[str], at: int, notes: dict[str, str], level: int = 0) -> tuple[list[dict], int]:
    """Items of one list (and of lists inside) from line at, and the line after it."""
    first = _ITEM.match(lines[at])
    ordered = first[2][-1] in ".)"
    kind = first[2][-1]
    number = int(first[2][:-1]) if ordered else None
    items: list[dict] = []
    while at < len(lines):
        m = _ITEM.match(lines[at])
        if not m or m[2][-1] != kind or _RULE.match(lines[at]):
            break
        width = _indent(lines[at]) + len(m[2]) + min(len(m[3] or " "), 4)
        body, at = [m[4] or ""], at + 1
        while at < len(lines):
            line = lines[at]
            if not line.strip():
                if at + 1 < len(lines) and lines[at + 1].strip() and _indent(lines[at + 1]) >= width:
                    body.append("")
                    at += 1
                    continue
                break
            if _indent(line) >= min(width, _indent(line) if body[-1] == "" else width):
                body.append(line.expandtabs(4)[width:] if _indent(line) >= width else line.strip())
            elif _ITEM.match(line) or _HEADING.match(line) or _FENCE.match(line) or _RULE.match(line) or body[-1] == "":
                break
            else:
                body.append(line.strip())
            at += 1
        task = _TASK.match(body[0])
        if task:
            body[0] = task[2]
        lead = 0
        while lead < len(body) and body[lead].strip() and not _ITEM.match(body[lead]) and not _FENCE.match(body[lead]):
            lead += 1
        runs = [r for r in inline("\n".join(body[:lead]).strip(), notes) if "image" not in r]
        inner = tokens(body[lead:], notes)
        nested = [x for b in inner if b.type == "list" for x in b.items]
        own = {"text": _text(runs), "runs": runs if _styled(runs) else None, "level": level, "ordered": ordered, "marker": number, "task": bool(task), "checked": bool(task and task[1] in "xX"), "blocks": [b for b in inner if b.type == "code"]}
        own["text"] += "".join(" " + b.plain() for b in inner if b.type == "para")
        if own["text"] or own["blocks"]:
            items.append(own)
        items += [x | {"level": x["level"] + 1} for x in nested]
        number = number + 1 if ordered else None
        while at < len(lines) and not lines[at].strip() and at + 1 < len(lines) and _ITEM.match(lines[at + 1]):
            at += 1
    return items, at


def tokens(lines: list[str], notes: dict[str, str]) -> list[Block]:
    out: list[Block] = []
    at = 0
    blanks = 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            blanks += 1
            at += 1
            continue
        if blanks >= 2 and out:
            out.append(Block("blank"))
        blanks = 0
        if m := _FENCE.match(line):
            body, at = [], at + 1
            while at < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[at]):
                body.append(lines[at])
                at += 1
            at += 1
            out.append(Block("code", text="\n".join(body), lang=m[2] or None))
        elif m := _HEADING.match(line):
            runs = inline(m[2] or "", notes)
            text = _text(runs) + "".join(f" ({r['footnote']})" for r in runs if r.get("footnote"))
            if text.strip():
                out.append(Block("heading", text=text.strip(), level=len(m[1])))
            at += 1
        elif _RULE.match(line):
            out.append(Block("hr"))
            at += 1
        elif line.lstrip().startswith(">") and _indent(line) < 4:
            body = []
            while at < len(lines) and lines[at].strip() and (lines[at].lstrip().startswith(">") or not (_HEADING.match(lines[at]) or _ITEM.match(lines[at]) or _FENCE.match(lines[at]))):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[at]))
                at += 1
            out.append(Block("quote", blocks=tokens(body, notes)))
        elif _ITEM.match(line):
            ordered = _ITEM.match(line)[2][-1] in ".)"
            items, at = _list(lines, at, notes)
            if items:
                out.append(Block("list", ordered=ordered, items=items))
        elif "|" in line and at + 1 < len(lines) and _DIVIDER.match(lines[at + 1]) and len(_split_row(line)) == len(_split_row(lines[at + 1])):
            head = _split_row(line)
            rows, at = [head], at + 2
            while at < len(lines) and lines[at].strip() and "|" in lines[at]:
                rows.append((_split_row(lines[at]) + [""] * len(head))[: len(head)])
                at += 1
            out.append(Block("table", rows=[[_cell(c, notes) for c in r] for r in rows], has_header=True))
        elif _HTML.match(line):
            body = []
            while at < len(lines) and lines[at].strip():
                body.append(lines[at])
                at += 1


            walk(Tree("\n".join(body)).root, out)
        elif _indent(line) >= 4:
            body = []
            while at < len(lines) and (not lines[at].strip() or _indent(lines[at]) >= 4):
                body.append(lines[at].expandtabs(4)[4:])
                at += 1
            out.append(Block("code", text="\n".join(body).strip("\n")))
        else:
            body = []
            level = 0
            while at < len(lines) and lines[at].strip():
                if body and (under := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[at])):
                    level = 1 if under[1][0] == "=" else 2
                    at += 1
                    break
                if body and (_HEADING.match(lines[at]) or _FENCE.match(lines[at]) or _RULE.match(lines[at]) or lines[at].lstrip().startswith(">") or re.match(r"^ {0,3}([-*+]|1[.)])[ \t]+\S", lines[at])):
                    break
                body.append(lines[at])
                at += 1
            if level:
                out.append(Block("heading", text=_text(inline(" ".join(b.strip() for b in body), notes)), level=level))
            else:
                out += _paragraph("\n".join(b.lstrip() for b in body), notes)
    return out


def front(text: str) -> tuple[dict[str, str], str]:
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return {}, text
    fields = {}
    for line in m[1].split("\n"):
        if pair := re.match(r"^\s*([^:\s][^:]*):(.*)$", line):
            value = pair[2].strip()
            fields[pair[1].strip().lower()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return fields, text[m.end() :]


def parse_markdown(text: str) -> Document:
    fields, body = front(text.replace("\r\n", "\n").replace("\r", "\n"))
    notes: dict[str, str] = {}
    lines, fence = [], None
    for line in body.split("\n"):
        m = _FENCE.match(line)
        if fence is None and m:
            fence = m[1][0]
        elif fence is not None and re.match(rf"^ {{0,3}}{re.escape(fence)}{{3,}}\s*$", line):
            fence = None
        elif fence is None and (note := _NOTE.match(line)):
            notes[note[1]] = note[2].strip()
            continue
        lines.append(line)
    doc = Document("", "md", tokens(lines, notes))
    promote_title(doc)
    doc.title = doc.title or fields.get("title", "") or "제목 없음"
    return doc


