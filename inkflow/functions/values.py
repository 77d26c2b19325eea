"""Colours, links, data URLs, images' bytes, cells and errors."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

# Named colours; patterns of numeric cells; kinds of errors in the order they are tried.
COLOURS = {"red": "#FF0000", "blue": "#0000FF", "green": "#008000", "black": "#000000", "white": "#FFFFFF", "gray": "#808080", "grey": "#808080", "orange": "#FFA500", "purple": "#800080", "yellow": "#FFFF00", "navy": "#000080", "teal": "#008080"}
NUMERIC = (r"^[-+]?[\d,]+(\.\d+)?%?$", r"^[-+]?\d{1,3}(,\d{3})+(\.\d+)?$", r"^[₩$€¥]\s?[-+]?[\d,]+(\.\d+)?$")
ERRORS = (
    ("지원하지 않는 포맷", r"(?i)지원하지 않는|unsupported|확장자|format"),
    ("파일 크기", r"(?i)크기 초과|too large|50MB|100MB|용량|size"),
    ("파싱 오류", r"(?i)파싱|parse|JSON|ZIP|로드 실패|손상|압축"),
    ("지원하지 않는 구조", r"(?i)HWP5|바이너리|구조|검증|미지원|unsupported structure"),
    ("브라우저 다운로드 차단", r"(?i)download|다운로드|차단|blocked|not allowed"),
)
OTHER_ERROR = "변환 처리"
LINK_COLOUR = "#0563C1"


def is_numeric_cell(c: Column) -> Column:
    c = trim_space(F.coalesce(c, F.lit("")))
    return (c != "") & (c.rlike(NUMERIC[0]) | c.rlike(NUMERIC[1]) | c.rlike(NUMERIC[2]))


def hex_colour(c: Column) -> Column:
    """#RRGGBB of #rgb, #rrggbb, rgb(r, g, b) or a name; else null."""
    c = trim_space(c)
    rgb = r"(?i)^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"
    part = [F.lpad(F.hex(F.least(F.lit(255), F.regexp_extract(c, rgb, i).try_cast("int"))), 2, "0") for i in (1, 2, 3)]
    names = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    return F.when(c.rlike(r"^#[0-9a-fA-F]{6}$"), F.upper(c)).when(c.rlike(r"^#[0-9a-fA-F]{3}$"), F.upper(F.regexp_replace(c, r"([0-9a-fA-F])", "$1$1"))).when(c.rlike(rgb), F.concat(F.lit("#"), *part)).otherwise(F.try_element_at(names, F.lower(c)))


def node_colour(style: Column, attribute: Column) -> Column:
    """The text colour of a style attribute, else of a colour attribute."""
    return F.coalesce(hex_colour(F.regexp_extract(style, r"(?i)(?:^|;)\s*color\s*:\s*([^;]+)", 1)), hex_colour(attribute))


def has_safe_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(trim_space(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).isin("http", "https", "mailto")


def _safe_link(url: str | None) -> str:
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        if parts.scheme == "mailto":
            return "mailto:" + url.split(":", 1)[1]
        if parts.scheme not in ("http", "https") or not parts.hostname:
            return ""
        port = parts.port
    except ValueError:
        return ""
    host = parts.hostname if port in (None, {"http": 80, "https": 443}[parts.scheme]) else f"{parts.hostname}:{port}"
    if "@" in parts.netloc:
        host = parts.netloc.rsplit("@", 1)[0] + "@" + host
    keep = "%/:=&?~#+!$,;'@()*[]|"
    out = f"{parts.scheme}://{host}{quote(parts.path or '/', safe=keep)}"
    return out + (f"?{quote(parts.query, safe=keep)}" if parts.query else "") + (f"#{quote(parts.fragment, safe=keep)}" if parts.fragment else "")


def safe_link(url: Column) -> Column:
    """The normal form of an http, https or mailto link; else empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_safe_link)

    return F.when(has_safe_scheme(url), F.pandas_udf(run, "string")(url)).otherwise("")


def image_source(c: Column) -> Column:
    """The address inside [text](address) or <address>."""
    c = trim_space(c)
    link, angle = r"^\[[^\]]*\]\(([^)]+)\)$", r"^<(.+)>$"
    return F.when(c.rlike(link), trim_space(F.regexp_extract(c, link, 1))).when(c.rlike(angle), trim_space(F.regexp_extract(c, angle, 1))).otherwise(c)


def data_url(c: Column) -> Column:
    """mime and bytes of a data URL for an image; null fields for anything else, null bytes where the encoding is broken."""
    pattern = r"(?is)^data:(image/[a-z0-9.+-]+)((?:;[^,;]*)*?)(;base64)?,(.*)$"
    body = F.regexp_extract(c, pattern, 4)
    packed = F.regexp_replace(body, r"\s+", "")
    coded = F.when(packed.rlike(r"^[A-Za-z0-9+/]*={0,2}$"), F.try_to_binary(packed, F.lit("base64")))
    plain = F.encode(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), "ISO-8859-1")
    data = F.when(F.regexp_extract(c, pattern, 3) != "", coded).otherwise(plain)
    return F.struct(F.when(c.rlike(pattern), F.lower(F.regexp_extract(c, pattern, 1))).alias("mime"), F.when(c.rlike(pattern), data).alias("data"))


def _number(data: Column, at: int, size: int, little: bool = False) -> Column:
    digits = F.hex(F.substring(data, at + 1, size))
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.conv(digits, 16, 10).try_cast("long")


def is_webp(data: Column) -> Column:
    return (F.hex(F.substring(data, 1, 4)) == "52494646") & (F.hex(F.substring(data, 9, 4)) == "57454250")


def _jpeg_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height of the first frame header."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        if marker == 0xFF:
            at += 1
        elif 0xD0 <= marker <= 0xD9 or marker == 1:
            at += 2
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def raster_info(data: Column) -> Column:
    """kind (png, gif, bmp, jpeg), width and height by a file's first bytes; null for others."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [_jpeg_size(d) or (None, None) for d in batch]
            yield pd.DataFrame({"width": pd.array([s[0] for s in sizes], "Int64"), "height": pd.array([s[1] for s in sizes], "Int64")})

    head = F.hex(F.substring(data, 1, 8))
    jpeg = F.pandas_udf(run, "width long, height long")(F.when(head.startswith("FFD8"), data))

    def made(kind: str, width: Column, height: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), width.alias("width"), height.alias("height"))

    return F.when(head == "89504E470D0A1A0A", made("png", _number(data, 16, 4), _number(data, 20, 4))).when(head.startswith("47494638"), made("gif", _number(data, 6, 2, True), _number(data, 8, 2, True))).when(head.startswith("424D"), made("bmp", _number(data, 18, 4, True), _number(data, 22, 4, True))).when(head.startswith("FFD8"), made("jpeg", jpeg["width"], jpeg["height"]))


def run_colour(run: Column) -> Column:
    return F.when(run["href"].isNotNull() & (run["href"] != "") & run["color"].isNull(), LINK_COLOUR).otherwise(run["color"])


def needs_own_style(run: Column) -> Column:
    """Whether a run needs a character style beyond bold and italic."""
    colour = run_colour(run)
    linked = F.coalesce(run["href"], F.lit("")) != ""
    coloured = F.coalesce(colour.rlike(r"^#[0-9A-Fa-f]{6}$") & (F.upper(colour) != "#000000"), F.lit(False))
    return linked | F.coalesce(run["underline"], F.lit(False)) | F.coalesce(run["strike"], F.lit(False)) | coloured


def style_key(run: Column, height: Column | None = None) -> Column:
    """Equal for runs that look alike."""

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int").cast("string")

    colour = run_colour(run)
    linked = F.coalesce(run["href"], F.lit("")) != ""
    shown = F.when(colour.rlike(r"^#[0-9A-Fa-f]{6}$"), F.upper(colour)).otherwise("#000000")
    return F.concat(flag(run["bold"]), flag(run["italic"]), flag(linked | F.coalesce(run["underline"], F.lit(False))), flag(run["strike"]), F.lit("|"), shown, F.lit("|"), F.coalesce(height.cast("string") if height is not None else F.lit(""), F.lit("")))


def border_key(colour: Column, side: Column) -> Column:
    return F.concat_ws(":", colour, side)


def error_category(message: Column) -> Column:
    """The first kind of error whose pattern the message has."""
    out = None
    for name, pattern in ERRORS:
        test = F.coalesce(message, F.lit("")).rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(OTHER_ERROR)


def file_magic(data: Column) -> Column:
    """ole2, zip or unknown."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head == "D0CF11E0", "ole2").when(head.startswith("504B"), "zip").otherwise("unknown")


def resolve_path(base: Column, target: Column) -> Column:
    """A relative target from the folder base, with .. and . taken out."""
    parts = F.filter(F.split(F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat_ws("/", base, target)), "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, start, lambda stack, p: F.when(p == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.array_append(stack, p))), "/")
