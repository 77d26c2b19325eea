"""HTML to blocks with html.parser: a small tree with implied end tags, then a walk over it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from .ir import Block, Document, cell, joined_runs, promote_title, run

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(("script", "style", "head", "nav", "footer", "aside"))
HEADINGS = {f"h{i}": i for i in range(1, 7)}
STYLES = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "code": "code", "u": "underline", "ins": "underline", "s": "strike", "del": "strike", "strike": "strike"}
#: Formatting that is opened again in the next block when a block's end cuts it off.
REOPENED = frozenset(("b", "strong", "i", "em", "u", "s", "strike", "code", "font", "big", "small", "tt"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
COLOURS = {"red": "#FF0000", "blue": "#0000FF", "green": "#008000", "black": "#000000", "white": "#FFFFFF", "gray": "#808080", "grey": "#808080", "orange": "#FFA500", "purple": "#800080", "yellow": "#FFFF00", "navy": "#000080", "teal": "#008080"}


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, *tags: str) -> list[Node]:
        """Descendants, in order."""
        out = []
        for c in self.children:
            if isinstance(c, Node):
                out += [c] * (c.tag in tags) + c.find(*tags)
        return out


class Tree(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.pending: list[tuple[str, dict[str, str]]] = []  # formatting to open again
        self.feed(html)
        self.close()

    def _push(self, tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        self.open.append(node)

    def _pop_to(self, tags: set[str] | frozenset[str], stops: set[str] | frozenset[str] = frozenset()) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                cut = [(n.tag, n.attributes) for n in self.open[i + 1 :] if n.tag in REOPENED]
                self.pending = self.pending + cut
                del self.open[i:]
                return True
            if self.open[i].tag in stops:
                return False
        return False

    def _reopen(self) -> None:
        pending, self.pending = self.pending, []
        for tag, attributes in pending:
            self._push(tag, attributes)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._pop_to({"p"}, {"table", "td", "th"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop_to(set(HEADINGS))
        if tag in IMPLIED:
            self._pop_to(*IMPLIED[tag])
            if tag in ("td", "th", "tr"):
                self.pending = []
        attributes = {k: v or "" for k, v in attrs}
        if tag in VOID:
            self.open[-1].children.append(Node(tag, attributes))
            return
        if tag not in CLOSES_P and tag not in IMPLIED and tag not in ("html", "body", "head", "title", "script", "style", "tbody", "thead"):
            self._reopen()
        self._push(tag, attributes)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in REOPENED:
            for i, (name, _) in enumerate(reversed(self.pending), 1):
                if name == tag:
                    del self.pending[-i]
                    return
        self._pop_to({tag}, {"td", "th"} if tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html") else frozenset())

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._reopen()
        self.open[-1].children.append(data)


def colour(node: Node) -> str | None:
    m = re.search(r"(?:^|;)\s*color\s*:\s*([^;]+)", node.attributes.get("style", ""), re.I)
    for raw in (m and m[1], node.attributes.get("color")):
        raw = (raw or "").strip()
        if re.fullmatch(r"#[0-9a-fA-F]{6}", raw):
            return raw.upper()
        if re.fullmatch(r"#[0-9a-fA-F]{3}", raw):
            return "#" + "".join(2 * c for c in raw[1:]).upper()
        if rgb := re.fullmatch(r"rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)", raw, re.I):
            return "#" + "".join(f"{min(255, int(x)):02X}" for x in rgb.groups())
        if raw.lower() in COLOURS:
            return COLOURS[raw.lower()]
    return None


def inline_runs(node: Node, style: dict | None = None) -> list[dict]:
    out: list[dict] = []
    style = style or {}
    for c in node.children:
        if isinstance(c, str):
            out.append(run(c, **style))
            continue
        own = dict(style)
        if c.tag in STYLES:
            own[STYLES[c.tag]] = True
        if c.tag in ("span", "font") and (k := colour(c)):
            own["color"] = k
        out += inline_runs(c, own)
    return joined_runs(out)


def _list(node: Node, level: int = 0) -> list[dict]:
    ordered, items = node.tag == "ol", []
    start = node.attributes.get("start", "")
    number = int(start) if re.fullmatch(r"-?\d+", start) else 1
    for li in node.children:
        if not isinstance(li, Node) or li.tag != "li":
            continue
        own = "".join(c if isinstance(c, str) else c.text() for c in li.children if isinstance(c, str) or c.tag not in ("ul", "ol")).strip()
        if own:
            items.append({"text": re.sub(r"\s+", " ", own), "level": level, "ordered": ordered, "marker": number if ordered else None})
        number += 1
        for sub in li.children:
            if isinstance(sub, Node) and sub.tag in ("ul", "ol"):
                items += _list(sub, level + 1)
    return items


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "")
    return max(1, int(value)) if re.fullmatch(r"\d+", value) else 1


def _rows(table: Node) -> list[list[dict]]:
    rows = []
    for tr in table.find("tr"):
        rows.append([cell(c.text().strip(), runs=inline_runs(c) if c.find(*STYLES, "span", "font") else None, col_span=_span(c, "colspan"), row_span=_span(c, "rowspan")) for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")])
    return [r for r in rows if r]


def walk(node: Node, blocks: list[Block]) -> None:
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                blocks.append(Block("para", text=c.strip()))
            continue
        tag = c.tag
        if tag in HEADINGS:
            if c.text().strip():
                blocks.append(Block("heading", text=c.text().strip(), level=HEADINGS[tag], color=colour(c)))
        elif tag == "p":
            runs = inline_runs(c)
            blocks.append(Block("para", runs=runs) if "".join(r["text"] for r in runs).strip() else Block("blank"))
        elif tag in ("ul", "ol"):
            if items := _list(c):
                blocks.append(Block("list", ordered=tag == "ol", items=items))
        elif tag == "table":
            if rows := _rows(c):
                blocks.append(Block("table", rows=rows, has_header=True))
        elif tag == "pre":
            blocks.append(Block("code", text=c.text().strip()))
        elif tag == "code":
            if c.text().strip():
                blocks.append(Block("para", text=f"`{c.text().strip()}`"))
        elif tag == "blockquote":
            inner: list[Block] = []
            walk(c, inner)
            if not inner and c.text().strip():
                inner.append(Block("para", text=c.text().strip()))
            if inner:
                blocks.append(Block("quote", blocks=inner))
        elif tag == "hr":
            blocks.append(Block("hr"))
        elif tag not in SKIPPED and tag not in VOID and tag != "title":
            walk(c, blocks)


def parse_html(html: str) -> Document:
    tree = Tree(html).root
    doc = Document("", "html")
    titles = [t.text().strip() for t in tree.find("title") if t.text().strip()]
    bodies = tree.find("body")
    walk(bodies[0] if bodies else tree, doc.blocks)
    if titles:
        doc.title = titles[0]
    else:
        promote_title(doc)
    doc.title = doc.title or "제목 없음"
    return doc
