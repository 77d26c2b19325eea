"""Formats by extension, and parsing of files and pasted text into one struct column.

Errors are data: a file that can't be parsed is a row with status 'error' (or 'unsupported') and the message.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..batches import small_batches
from ..functions.text import extension_or_empty
from .delimited import parse_csv, parse_json, scalar_text
from .html import parse_html
from .ir import PARSED, Block, Document, ParseError, Unsupported, clean, failed, flatten, promote_title
from .markdown import parse_markdown
from .office import parse_docx, parse_hwp, parse_pptx, parse_xlsx

TEXT_CAP, BINARY_CAP = 100 << 20, 50 << 20
#: Parsed documents that are Python objects at a time, before they are Arrow's.
PARSED_AT_ONCE = 64


def decode_text(data: bytes) -> str:
    """UTF-16 by its mark, UTF-8 (without its mark), else EUC-KR; newlines as \\n."""
    if data[:2] == b"\xff\xfe":
        text = data[2:].decode("utf-16-le", "replace")
    elif data[:2] == b"\xfe\xff":
        text = data[2:].decode("utf-16-be", "replace")
    else:
        for name in ("utf-8-sig", "euc-kr"):
            try:
                text = data.decode(name)
                break
            except UnicodeDecodeError:
                continue
        else:
            raise ParseError("텍스트 인코딩 파싱 오류: UTF-8 또는 EUC-KR이 아닙니다")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def parse_text(text: str) -> Document:
    """Paragraphs between blank lines: a single heading line, a list of lines, fenced code, or a paragraph."""
    doc = Document("텍스트 문서", "txt")
    for raw in re.split(r"\n{2,}", text):
        part = clean(raw.strip()).strip()
        if not part:
            continue
        lines = [x for x in part.split("\n") if x.strip()]
        if m := re.fullmatch(r"(#{1,6})\s+([^\n]+)", part):
            doc.blocks.append(Block("heading", text=m[2].strip(), level=len(m[1])))
        elif all(re.match(r"\s*(?:[-*+]\s|\d+\.\s)", x) for x in lines):
            ordered = bool(re.match(r"\s*\d", lines[0]))
            doc.blocks.append(Block("list", ordered=ordered, items=[{"text": re.sub(r"^\s*(?:[-*+]|\d+\.)\s+", "", x)} for x in lines]))
        elif part.startswith("```"):
            doc.blocks.append(Block("code", text=re.sub(r"^```[^\n]*\n?|\n?```\s*$", "", part).strip()))
        else:
            doc.blocks.append(Block("para", text=part))
    promote_title(doc)
    return doc


def _joined(v: Any) -> str:
    return "".join(x if isinstance(x, str) else scalar_text(x) for x in v) if isinstance(v, list) else v if isinstance(v, str) else ""


def parse_notebook(text: str) -> Document:
    try:
        book = json.loads(text)
    except ValueError as e:
        raise ParseError(f"IPYNB 파싱 오류: {e}") from None
    cells = book.get("cells") if isinstance(book, dict) else None
    if cells is None and isinstance(book, dict) and isinstance(book.get("worksheets"), list) and book["worksheets"]:
        cells = book["worksheets"][0].get("cells")
    if not isinstance(cells, list):
        raise ParseError("IPYNB 파싱 오류: 셀 없음")
    doc = Document("", "ipynb")
    images = 0
    for c in cells:
        source = _joined(c.get("source", c.get("input")))
        kind = c.get("cell_type")
        if kind == "markdown":
            part = parse_markdown(source)
            if part.title != "제목 없음":
                if doc.title:
                    part.blocks.insert(0, Block("heading", text=part.title, level=1))
                else:
                    doc.title = part.title
            doc.blocks += part.blocks
        elif kind == "code":
            if source.strip():
                doc.blocks.append(Block("code", text=source.rstrip(), lang=c.get("language") or "python"))
            for out in c.get("outputs") or []:
                if out.get("output_type") not in ("stream", "execute_result", "display_data", "pyout"):
                    continue
                data = out.get("data") if isinstance(out.get("data"), dict) else out
                said = _joined(out.get("text")) or _joined(data.get("text/plain"))
                if said.strip():
                    doc.blocks.append(Block("para", text=f"[출력] {said.strip()}"))
                for mime in ("image/png", "image/jpeg"):
                    if _joined(data.get(mime)).strip():
                        images += 1
                        suffix = mime[6:].replace("jpeg", "jpg")
                        doc.blocks.append(Block("image-source", image={"bin_name": f"ipynb-out{images}.{suffix}", "source": f"data:{mime};base64,{''.join(_joined(data[mime]).split())}", "mime": mime, "alt": "", "source_format": "ipynb"}))
                        break
        elif kind == "raw" and source.strip():
            doc.blocks.append(Block("para", text=source.strip()))
    doc.title = doc.title or "제목 없음"
    return doc


# The formats.
TEXT_FORMATS: dict[str, Callable[[str], Document]] = {"md": parse_markdown, "markdown": parse_markdown, "html": parse_html, "htm": parse_html, "txt": parse_text, "text": parse_text, "csv": parse_csv, "json": parse_json, "ipynb": parse_notebook}
BINARY_FORMATS: dict[str, Callable[[bytes], Document]] = {"xlsx": parse_xlsx, "xls": parse_xlsx, "docx": parse_docx, "pptx": parse_pptx, "hwp": parse_hwp, "hwpx": parse_hwp}
FORMATS = (*TEXT_FORMATS, *BINARY_FORMATS)


def register_format(ext: str, parser: Callable[[Any], Document], binary: bool = False) -> None:
    """Adds a format; on a cluster the module that calls this must be imported on the executors as well."""
    (BINARY_FORMATS if binary else TEXT_FORMATS)[ext] = parser


def parse_one(ext: str | None, data: bytes | str | None, size: int | None = None) -> dict:
    """The fields of ir.PARSED; size is that of a file whose content was left out for it."""
    ext = (ext or "").lower()
    size = max(len(data) if data is not None else 0, size or 0)
    try:
        if ext in TEXT_FORMATS:
            if size > TEXT_CAP:
                raise ParseError("파일 크기 초과 (100MB)")
            text = data.replace("\r\n", "\n").replace("\r", "\n") if isinstance(data, str) else decode_text(bytes(data or b""))
            return flatten(TEXT_FORMATS[ext](text))
        if ext in BINARY_FORMATS:
            if size > BINARY_CAP:
                raise ParseError("파일 크기 초과 (50MB)")
            return flatten(BINARY_FORMATS[ext](data.encode() if isinstance(data, str) else bytes(data or b"")))
        raise Unsupported(f"지원하지 않는 확장자: {ext}")
    except Unsupported as e:
        return failed("unsupported", str(e), ext)
    except ParseError as e:
        return failed("error", str(e), ext)
    except (ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError, OverflowError) as e:
        return failed("error", f"{ext.upper()} 파싱 오류: {e}", ext)


def parsed(ext: Column, data: Column, size: Column | None = None) -> Column:
    """The struct of ir.PARSED for a file's extension and its bytes, or text in place of bytes; with size, a file over the cap is an error whether its bytes are there or not."""

    kind = to_arrow_type(_parse_datatype_string(PARSED))

    def parse(exts: pa.Array, contents: pa.Array, sizes: pa.Array) -> pa.Array:
        some = (range(i, min(i + PARSED_AT_ONCE, len(exts))) for i in range(0, len(exts), PARSED_AT_ONCE))
        parts = [pa.array([parse_one(exts[i].as_py(), contents[i].as_py(), sizes[i].as_py()) for i in rows], kind) for rows in some]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(parse, PARSED)(ext, data, F.lit(None).cast("long") if size is None else size)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, ext, length, content of files; content is read only where it is selected, and is null for files over their format's cap, which are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    ext = extension_or_empty(F.element_at(F.split("path", "/"), -1))
    cap = F.when(ext.isin(*BINARY_FORMATS), BINARY_CAP).otherwise(TEXT_CAP)
    # the reader itself leaves files unread by a plain bound on length
    some = files.select("path", ext.alias("ext"), "length", "content").where((F.col("length") <= max(BINARY_CAP, TEXT_CAP)) & (F.col("length") <= cap))
    large = files.select("path", ext.alias("ext"), "length").where(F.col("length") > cap)
    return some.unionByName(large.withColumn("content", F.lit(None).cast("binary")))


def parse(df: DataFrame, key: str, ext: Column, data: Column, size: Column | None = None) -> DataFrame:
    """df's key and one column doc, the parsed struct."""
    small_batches(df.sparkSession)
    return df.select(F.col(key), parsed(ext, data, size).alias("doc"))


def docs_table(parsed_df: DataFrame, key: str) -> DataFrame:
    return parsed_df.select(key, "doc.title", "doc.doc_type", "doc.header", "doc.footer", "doc.status", "doc.error")


def block_items(doc: Column, separator: str) -> Column:
    """Of a parsed struct: block_id and the texts of its items, in order, as one, for each block that has items; within the row, since a block's items stand together."""
    items = doc["items"]
    first = F.filter(F.transform(items, lambda x, i: i), lambda i: (i == 0) | (F.get(items, i)["block_id"] != F.get(items, i - 1)["block_id"]))
    runs = F.transform(first, lambda i, k: F.struct(i.alias("i"), (F.coalesce(F.get(first, k + 1), F.size(items)) - i).alias("n")))
    return F.transform(runs, lambda r: F.struct(F.get(items, r["i"])["block_id"].alias("block_id"), F.array_join(F.transform(F.slice(items, r["i"] + 1, r["n"]), lambda x: x["text"]), separator).alias("text")))


def part_table(parsed_df: DataFrame, key: str, part: str) -> DataFrame:
    """blocks, items, cells or assets as a table."""
    return parsed_df.select(key, F.explode(f"doc.{part}").alias("x")).select(key, "x.*")


