"""Word-processor documents as ordered blocks.

Each file is one row of Spark's binary source and is parsed where it lies; the
place of a block in its document becomes the column ``ord``. Only direct
children of the body count; empty paragraphs and tables are dropped, and so
are empty cells and rows. A file that is no such document raises ValueError.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "word/document.xml"
_NAMES = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_UNFIT = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_SPACE = re.compile(r"\s+")
_BULLET = re.compile("[·•]+")
SCHEMA = "path string, ord long, block_type string, text string, cell_rows array<array<string>>"


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _text(paragraph: ElementTree.Element) -> str:
    stand_in = {"tab": "\t", "br": "\n", "cr": "\n"}
    raw = "".join((n.text or "") if _name(n) == "t" else stand_in.get(_name(n), "") for n in paragraph.iter())
    return _SPACE.sub(" ", _BULLET.sub(" ", raw)).strip()


def _children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in node if _name(c) == name]


def _cells(table: ElementTree.Element) -> list[list[str]]:
    rows = ([" | ".join(filter(None, map(_text, _children(cell, "p")))) for cell in _children(row, "tc")] for row in _children(table, "tr"))
    return [kept for row in rows if (kept := [c for c in row if c])]


def blocks_of(content: bytes, path: str = "") -> list[tuple[int, str, str, list[list[str]]]]:
    """(ord, block_type, text, rows) of one document."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(PART))
    except KeyError:
        raise ValueError(f"{path}: no {PART} in it") from None
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise ValueError(f"{path}: not a document: {e}") from None
    body = _children(root, "body")
    if not body:
        raise ValueError(f"{path}: no body in it")
    out: list[tuple[int, str, str, list[list[str]]]] = []
    for node in body[0]:
        if _name(node) == "p" and (text := _text(node)):
            out.append((len(out) + 1, "paragraph", text, []))
        elif _name(node) == "tbl" and (rows := _cells(node)):
            out.append((len(out) + 1, "table", "\n".join(" | ".join(r) for r in rows), rows))
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield pd.DataFrame([(path, *b) for b in blocks_of(content, path)], columns=["path", "ord", "block_type", "text", "cell_rows"])


def document_of(blocks: list[tuple[str, str | None, list[list[str | None]] | None]]) -> bytes:
    """A document of (block_type, text, rows); what XML can't hold becomes a space."""

    def para(text: str | None) -> str:
        return f"<w:p><w:r><w:t>{escape(_UNFIT.sub(' ', text or ''))}</w:t></w:r></w:p>"

    def table(rows: list[list[str | None]] | None) -> str:
        return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows or []) + "</w:tbl>"

    body = "".join(table(rows) if kind == "table" else para(text) for kind, text, rows in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(PART, f'<w:document xmlns:w="{_NAMES}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def written(blocks: DataFrame, key: str) -> DataFrame:
    """(path, content): each block (key, block_type, text, cell_rows) as a document of its own, named by its key."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [document_of([(b, t, None if r is None else [list(c) if c is not None else [] for c in r])]) for b, t, r in zip(pdf["block_type"], pdf["text"], pdf["cell_rows"])]
            yield pd.DataFrame({"path": pdf["k"].astype(str), "content": made})

    return blocks.select(F.col(key).alias("k"), "block_type", "text", "cell_rows").mapInPandas(write, "path string, content binary")


def parsed(documents: DataFrame) -> DataFrame:
    """Blocks of documents (path, content)."""
    return documents.select("path", "content").mapInPandas(_parse, SCHEMA)


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Blocks of every document that the path or paths (files, folders or patterns) name."""
    return parsed(spark.read.format("binaryFile").load(path))


def as_blocks(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Parsed blocks with the source they belong to; ``sources`` has (source_id, source_file)."""
    named = sources.select("source_id", F.regexp_extract("source_file", "([^/]+)$", 1).alias("_f"))
    joined = parsed.withColumn("_f", F.regexp_extract("path", "([^/]+)$", 1)).join(named, "_f")
    return joined.select(F.xxhash64("path", "ord").alias("block_id"), "source_id", "ord", "block_type", "text", "cell_rows")
