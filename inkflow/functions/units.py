"""Numbers: page units, option values, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units to a millimetre, paper sizes, margins in millimetres, options.
UNITS_PER_MM = 283.465
PAPERS = {"A4": (59528, 84188), "A3": (84189, 119055), "B5": (51430, 72817), "Letter": (61920, 80136)}
MARGINS_MM = {"top": 10, "bottom": 10, "left": 20, "right": 20, "header": 10, "footer": 10}
LINE_SPACINGS = (130, 150, 160, 180, 200)
SPACINGS = {"compact": (0, 283, 567, 283, 57), "normal": (0, 850, 850, 567, 100), "relaxed": (0, 1134, 1134, 850, 283)}
SPACING_FIELDS = ("body_prev", "body_next", "heading_prev", "heading_next", "list_next")
HEADING_OFFSETS = {"compact": (4, 3, 1, 0, 0, -1), "standard": (6, 4, 2, 1, 0, -1), "prominent": (8, 6, 3, 2, 0, -1)}
LEAST_COLUMN, LEAST_WIDTH = 3000, 12000
UNITS_PER_PIXEL, WIDEST_IMAGE = 75, 40000


def round_half_up(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def mm_to_units(mm: Column) -> Column:
    return round_half_up(mm * UNITS_PER_MM)


def units_to_mm(n: Column) -> Column:
    return F.round(n / UNITS_PER_MM, 1)


def margin_mm(raw: Column, side: str) -> Column:
    """A margin given as text: the default of its side where that isn't a number."""
    value = F.try_cast(raw, "double") if hasattr(F, "try_cast") else raw.try_cast("double")
    return F.when(F.isnan(value) | value.isNull(), F.lit(float(MARGINS_MM[side]))).otherwise(value)


def line_spacing(raw: Column) -> Column:
    n = F.regexp_extract(raw.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.when(n.isin(*LINE_SPACINGS), n).otherwise(160)


def paragraph_spacing(preset: Column) -> Column:
    """A struct of SPACING_FIELDS."""

    def fields(name: str) -> Column:
        return F.struct(*(F.lit(v).alias(k) for k, v in zip(SPACING_FIELDS, SPACINGS[name])))

    return F.when(preset == "compact", fields("compact")).when(preset == "relaxed", fields("relaxed")).otherwise(fields("normal"))


def heading_sizes(base_pt: Column, style: Column) -> Column:
    """Hundredths of a point: body, h1 ... h6, table head, code; small headings and code have a least size."""
    n = F.coalesce(F.regexp_extract(base_pt.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(12))
    n = F.when(n == 0, 12).otherwise(n)
    base = F.greatest(F.lit(6), F.least(F.lit(36), n))

    def offset(i: int) -> Column:
        return F.when(style == "compact", HEADING_OFFSETS["compact"][i]).when(style == "prominent", HEADING_OFFSETS["prominent"][i]).otherwise(HEADING_OFFSETS["standard"][i])

    def size(i: int) -> Column:
        s = (base + offset(i)) * 100
        return F.greatest(s, F.lit(800)) if i in (3, 5) else s

    return F.struct((base * 100).alias("body"), *(size(i).alias(f"h{i + 1}") for i in range(6)), (base * 100).alias("table_head"), F.greatest((base - 1) * 100, F.lit(800)).alias("code"))


def one_of(c: Column, options: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*options), c).otherwise(default)


def table_style(c: Column) -> Column:
    return one_of(c, ("standard", "plain", "report"), "standard")


def link_style(c: Column) -> Column:
    return one_of(c, ("blue", "plain", "url"), "blue")


def image_options(width: Column, align: Column) -> Column:
    n = F.regexp_extract(width.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.struct(F.when(n.isin(50, 75, 100), n).otherwise(100).alias("max_width"), one_of(align, ("left", "center", "right"), "center").alias("align"))


def image_size(width_px: Column, height_px: Column, widest: Column | int = WIDEST_IMAGE) -> Column:
    """Units of an image, no wider than widest, in its own proportions."""
    w, h = width_px * UNITS_PER_PIXEL, height_px * UNITS_PER_PIXEL
    most = F.lit(widest) if isinstance(widest, int) else widest
    return F.struct(F.least(w, most).cast("long").alias("width"), F.when(w > most, round_half_up(h * most / w)).otherwise(h).cast("long").alias("height"))


def content_width(paper: Column, landscape: Column, left: Column, right: Column) -> Column:
    """Units between the margins of a paper; unknown papers count as A4."""

    def side(i: int) -> Column:
        out = None
        for name, sizes in PAPERS.items():
            out = F.when(paper == name, sizes[i]) if out is None else out.when(paper == name, sizes[i])
        return out.otherwise(PAPERS["A4"][i])

    return F.greatest(F.lit(LEAST_WIDTH), F.when(landscape, side(1)).otherwise(side(0)) - left - right)


def heading_ids(level: Column) -> Column:
    n = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1))))
    return F.struct(F.when(n <= 4, n).when(n == 5, 10).otherwise(11).cast("string").alias("char_id"), F.when(n <= 4, n).when(n == 5, 15).otherwise(16).cast("string").alias("para_id"))


def clamp_percent(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def size_bucket(n: Column) -> Column:
    return F.when(n < 100_000, "xs").when(n < 1_000_000, "sm").otherwise("lg")


def duration_bucket(ms: Column) -> Column:
    return round_half_up(ms / 1000)


def next_version(version: Column, same_day: Column) -> Column:
    """Another patch on the same day, else another minor version."""
    part = F.split(version, r"\.")
    major, minor, patch = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    return F.when(same_day, F.concat_ws(".", major, minor, patch + 1)).otherwise(F.concat_ws(".", major, minor + 1, F.lit(0)))


def table_side(n_columns: Column, column: Column, span: Column) -> Column:
    """Which outer borders a cell has."""
    return F.when(n_columns == 1, "both").when(column == 0, "left").when(column + span >= n_columns, "right").otherwise("full")
