"""Batch conversion: files or pasted texts to results with a status, errors among them as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, extension_or_empty, package_name
from ..functions.values import error_category
from ..operators.order import first_n, unique_names
from ..sinks.package import packaged, validated
from ..sources.registry import FORMATS, parsed


@dataclass(frozen=True)
class Options:
    paper: str = "A4"
    landscape: bool = False
    margins_mm: tuple[tuple[str, float], ...] = ()

    def margins(self) -> dict[str, float] | None:
        return dict(self.margins_mm) or None


def queue(files: DataFrame, batch: str, order: str, cap: int = 20) -> DataFrame:
    """The first cap files of supported formats of each batch, and overflow: how many more there are. files has name."""
    known = files.withColumn("ext", extension_or_empty(F.col("name"))).where(F.col("ext").isin(*FORMATS))
    return first_n(known, [batch], [order], cap)


def pasted(df: DataFrame, text: Column, ext: Column) -> DataFrame:
    """Pasted text as a file's name, extension and content."""
    return df.withColumns({"ext": F.lower(ext), "name": F.concat(F.lit("paste."), F.lower(ext)), "content": F.encode(text, "UTF-8")})


def converted(files: DataFrame, options: Options = Options()) -> DataFrame:
    """files (name, ext, content, more; with length, those over the cap are errors) with doc, package, status (done, warn, error, unsupported), error, error_category, issues and file_name."""
    doc = files.withColumn("doc", parsed(F.col("ext"), F.col("content"), F.col("length") if "length" in files.columns else None))
    built = doc.withColumn("package", packaged(F.col("doc"), options.paper, options.landscape, options.margins()))
    checked = built.withColumn("_check", F.when(F.col("package").isNotNull(), validated(F.col("package"), options.margins())))
    status = F.when(F.col("doc.status") != "done", F.col("doc.status")).when(F.col("_check.pass"), "done").otherwise("warn")
    return checked.withColumns(
        {
            "status": status,
            "error": F.col("doc.error"),
            "error_category": F.when(F.col("doc.error").isNotNull(), error_category(F.col("doc.error"))),
            "issues": F.coalesce("_check.issues", F.array().cast("array<string>")),
            "file_name": package_name(F.concat(base_name(F.col("name")), F.lit(".hwpx"))),
        }
    ).drop("_check")


def archive_names(results: DataFrame, batch: str, order: str) -> DataFrame:
    """Results that have a package, with names that are unique within a batch."""
    return unique_names(results.where(F.col("status").isin("done", "warn")), [batch], [order], "file_name")
