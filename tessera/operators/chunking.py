"""Pages and delimited files as numbered chunks.

Packing is a fold over paragraphs and lines. Texts up to ``FOLD_CHARS`` are
folded by Catalyst's ``aggregate``; it copies its result at each step, so that
longer ones go through Arrow. The rules are the same character by character:
white space between paragraphs is that of ASCII, what is stripped off either
end is Java's, which knows no no-break spaces.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters a chunk aims at, and from which a paragraph is cut into lines.
TARGET, MAXIMUM = 1200, 2400
#: Longest text folded inside the JVM.
FOLD_CHARS = 20_000
_SPACE = "\\p{javaWhitespace}"
#: Java's white space: separators but for the no-break ones, and some controls.
_STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
_BETWEEN = re.compile(r"\n\s*\n", re.ASCII)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def _pack(parts: Column, glue: str) -> Column:
    """Greedy: a part goes on where the chunk so far and it stay within TARGET."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, part: Column) -> Column:
        flush = (acc["open"] != "") & (F.length(acc["open"]) + F.length(part) > TARGET)
        return F.struct(
            F.when(flush | (acc["open"] == ""), part).otherwise(F.concat(acc["open"], F.lit(glue), part)).alias("open"),
            F.when(flush, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def fold_blocks(text: Column) -> Column:
    """The chunks of one page as an array, inside the JVM."""
    paragraphs = F.filter(F.transform(F.split(_strip(text), r"\n[ \t\n\x0B\f\r]*\n"), _strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > MAXIMUM, _pack(F.split(p, "\n"), "\n")).otherwise(F.array(p))))
    return _pack(pieces, "\n\n")


def pack(parts: list[str], glue: str) -> list[str]:
    """``_pack`` on the Python side."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for part in parts:
        if size and size + len(part) > TARGET:
            out.append(glue.join(held))
            held, size = [], 0
        if size:
            size += len(glue)
        else:
            held = []  # an empty chunk so far is replaced, not joined
        held.append(part)
        size += len(part)
    return [*out, glue.join(held)] if size else out


def page_blocks(text: str | None) -> list[str]:
    """``fold_blocks`` for one text on the Python side."""
    pieces: list[str] = []
    for paragraph in _BETWEEN.split((text or "").strip(_STRIPPED)):
        if own := paragraph.strip(_STRIPPED):
            pieces += pack(own.split("\n"), "\n") if len(own) > MAXIMUM else [own]
    return pack(pieces, "\n\n")


@F.pandas_udf(ArrayType(StringType()))
def _blocks(texts: pd.Series) -> pd.Series:
    return texts.map(page_blocks)


def delimited_blocks(text: str | None) -> list[str]:
    """Chunks of a delimited file, each with its header line. Blank lines are
    dropped; a file of one line is chunked as text."""
    lines = [x for x in (text or "").splitlines() if x.strip()]
    if len(lines) < 2:
        return page_blocks(text)
    header, out, held, size = lines[0], [], [], len(lines[0])
    for line in lines[1:]:
        if held and size + len(line) + 1 > TARGET:
            out.append("\n".join([header, *held]))
            held, size = [], len(header)
        held.append(line)
        size += len(line) + 1
    return [*out, "\n".join([header, *held])]


@F.pandas_udf(ArrayType(StringType()))
def _delimited(texts: pd.Series) -> pd.Series:
    return texts.map(delimited_blocks)


def chunk_pages(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks of ``pages`` (key, page, text): key, chunk_index (from 1 and on
    over the pages), page, text. A chunk never spans pages; blank and null pages
    give none and don't shift page numbers; other columns are ignored."""
    rows = pages.select(key, "page", "text").filter(F.length("text") > 0)
    short = rows.filter(F.length("text") <= FOLD_CHARS).select(key, "page", F.posexplode(fold_blocks(F.col("text"))).alias("place", "text"))
    long = rows.filter(F.length("text") > FOLD_CHARS).select(key, "page", F.posexplode(_blocks("text")).alias("place", "text"))
    return _numbered(short.unionByName(long), key)


def chunk_delimited(files: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks of delimited files (key, text); the page is always 1."""
    rows = files.select(key, "text").filter(F.length("text") > 0)
    return _numbered(rows.select(key, F.lit(1).alias("page"), F.posexplode(_delimited("text")).alias("place", "text")), key)


def _numbered(blocks: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("page", "place")
    return blocks.select(key, F.row_number().over(order).alias("chunk_index"), "page", "text")


def chunk_context(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """The chunks of a document as one addressable text."""
    part = F.struct("chunk_index", F.format_string("[chunk %d | page %d]\n%s", "chunk_index", "page", "text").alias("shown"))
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda c: c["shown"]), "\n\n").alias("context"))
