"""String functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that say nothing about a document.
GENERIC_TITLES = ("문서구성", "목차", "차례", "개요", "본문", "내용", "소개", "서론", "tableofcontents", "contents", "outline", "overview", "introduction")

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
WIDE = r"[\x{1100}-\x{D7FF}\x{3000}-\x{303F}]"


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def trim_space(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def sanitize(c: Column) -> Column:
    """Without control characters, null as empty; tab, newline and carriage return stay."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, "")


def decode_entities(c: Column) -> Column:
    """The five XML entities; the ampersand last, so nothing is decoded twice."""
    return _replaced(c, ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def closed_references(c: Column) -> Column:
    """HTML in which only character references with their semicolon count: the ampersand of any other is escaped, so that its letters stay text."""
    return F.regexp_replace(c, r"&(?=#?[0-9A-Za-z])(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][0-9A-Za-z]*);)", "&amp;")


def xml_escape(c: Column) -> Column:
    return _replaced(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def html_escape(c: Column) -> Column:
    return _replaced(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def text_escape(c: Column) -> Column:
    return _replaced(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def replace_emoji(c: Column) -> Column:
    """Pictographs become a white square; what only varies or joins them goes."""
    c = F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", "\u25a1")
    c = F.regexp_replace(c, r"[\x{2600}-\x{2B55}]", "\u25a1")
    return F.regexp_replace(c, r"[\x{FE00}-\x{FE0F}\x{200D}]", "")


def display_width(c: Column, cap: int = 40) -> Column:
    """Characters, Hangul and CJK ones twice, at most cap."""
    return F.least(F.lit(cap), F.length(c) + F.length(F.regexp_replace(c, WIDE.replace("[", "[^"), "")))


def title_candidate(c: Column) -> Column:
    return trim_space(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def is_generic_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(title_candidate(c)), r"(?U)[\s:\x{FF1A}\-\x{2013}\x{2014}_()\[\]{}]+", "").isin(*GENERIC_TITLES)


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole name without a dot."""
    return F.lower(trim_space(F.element_at(F.split(name, r"\."), -1)))


def extension_or_empty(name: Column) -> Column:
    return F.when(name.contains("."), extension(name)).otherwise("")


def base_name(name: Column) -> Column:
    return trim_space(F.regexp_replace(name, r"\.[^.]+$", ""))


def safe_base_name(c: Column) -> Column:
    """A file name without characters that paths forbid and without a known extension, at most 100 long."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]', "")
    c = F.regexp_replace(c, r"(?i)\.(hwpx|md|html?|txt|csv|json|ipynb|docx|xlsx?|hwp)$", "")
    return F.substring(trim_space(c), 1, 100)


def package_name(c: Column) -> Column:
    """The name with the package extension, whatever it had."""
    c = trim_space(F.coalesce(c, F.lit("")))
    c = F.when(c == "", "document.hwpx").otherwise(c)
    return F.when(F.lower(c).endswith(".hwpx"), c).otherwise(F.concat(F.regexp_replace(c, r"\.[^.]+$", ""), F.lit(".hwpx")))


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / (1024 * 1024)))


def hyperlink_command(url: Column) -> Column:
    return F.concat(F.regexp_replace(url, r"([\\:?])", r"\\$1"), F.lit(";1;0;1;"))


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")


def block_text(text: Column, runs: Column) -> Column:
    """A block's title text: its text, or else that of its runs."""
    return title_candidate(F.coalesce(text, runs_text(runs), F.lit("")))


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n", -1))


def strong_spans(c: Column) -> Column:
    """The texts between double asterisks."""
    return F.regexp_extract_all(c, F.lit(r"\*\*(.+?)\*\*"), F.lit(1))


def frontmatter(c: Column) -> Column:
    """The leading block between --- lines as a map with lower-case keys; values lose outer quotes; of equal keys the last counts; empty without one."""
    body = F.regexp_extract(c, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    pairs = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*[^:\s][^:]*:"))
    keyed = F.transform(pairs, lambda x: F.struct(F.lower(trim_space(F.regexp_extract(x, r"^([^:]*):", 1))).alias("key"), F.regexp_replace(trim_space(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2").alias("value")))
    last = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, i + 2, F.greatest(F.size(keyed) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)
