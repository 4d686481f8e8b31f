"""Oversized chunks in pieces under a limit (problem 5).

Method: a recursive hierarchy of separators. A text too long is split into
sections; a section too long into paragraphs, those into lines, sentences,
words and, where nothing else is left, characters. The parts are packed
greedily up to the limit, and each piece begins with the end of the one before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.functions.arrow import pieces
from tessera.session import once

#: Characters a piece may have, and how many of the piece before it repeats.
LIMIT, OVERLAP = 2400, 200
#: Separators from strong to weak; a part ends with its separator.
SEPARATORS = tuple(
    re.compile(p)
    for p in (r"\n[^\S\n]*(?:\n[^\S\n]*){2,}|\f", r"\n[^\S\n]*\n", r"\n", r"[.!?…][\"'”’»)\]]*\s+", r"\s+")
)
_JOINERS = "\u200d\ufe0e\ufe0f"


def _attached(char: str) -> bool:
    """Whether a character belongs to the one before it."""
    return unicodedata.combining(char) != 0 or char in _JOINERS


def _parts(text: str, begin: int, end: int, level: int, room: int, closing: int) -> Iterator[tuple[int, int]]:
    """Ends of the parts of text[begin:end], none longer than ``room``, each
    with the level of the separator that closes it."""
    if end - begin <= room:
        yield end, closing
        return
    at = begin
    if level == len(SEPARATORS):
        while end - at > room:
            cut = at + room
            back = cut
            while back > at and (_attached(text[back]) or text[back - 1] == "\u200d"):
                back -= 1
            at = back if back > at else cut
            yield at, level
        yield end, closing
        return
    for found in SEPARATORS[level].finditer(text, begin, end):
        if found.end() < end:
            yield from _parts(text, at, found.end(), level + 1, room, level)
            at = found.end()
    yield from _parts(text, at, end, level + 1, room, closing)


def _resume(text: str, end: int, overlap: int) -> int:
    """Where the next piece begins: the last ``overlap`` characters, or fewer
    to begin with a word."""
    first = max(0, end - overlap)
    if first == 0 or text[first - 1].isspace() and not text[first].isspace():
        return first
    word = re.compile(r"(?<=\s)\S").search(text, first, end)
    return word.start() if word else first


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of a text as (begin, end). A text up to the limit is one piece;
    null and empty texts have none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    parts = list(_parts(text, 0, len(text), 0, limit - overlap, 0))
    pieces: list[tuple[int, int]] = []
    begin, first = 0, 0
    while parts[-1][0] - begin > limit:
        last = first
        while parts[last + 1][0] - begin <= limit:
            last += 1
        # as much as fits, but back to a stronger boundary in the second half
        best = min(range(first, last + 1), key=lambda k: (parts[k][0] - begin <= limit // 2, parts[k][1], -parts[k][0]))
        end = parts[best if parts[best][0] - begin > limit // 2 else last][0]
        pieces.append((begin, end))
        first = next(k for k in range(first, len(parts)) if parts[k][0] > end)
        begin = _resume(text, end, overlap) if overlap else end
    pieces.append((begin, len(text)))
    return pieces


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = True) -> DataFrame:
    """Pieces of the chunks: chunk_id, document_id, page, chunk_index, piece_no
    (from 1), begin_char, end_char, text.

    By default only chunks of more than ``limit`` characters are cut; with
    ``oversized_only`` false the others come as one piece. Null and empty texts
    give no piece, repeated rows count once, chunks without an id each for
    itself, a null page stays null and other columns are ignored.
    """
    keys = ["chunk_id", "document_id", "page", "chunk_index"]
    rows = once(chunks.select(*keys, "text").filter(F.length("text") > (limit if oversized_only else 0)), "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owners, numbers, begins, ends, texts = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for number, (a, b) in enumerate(split_text(text, limit, overlap), 1):
                    owners.append(k)
                    numbers.append(number)
                    begins.append(a)
                    ends.append(b)
                    texts.append(text[a:b])
            take = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in keys]
                + [pa.array(x, pa.int32()) for x in (numbers, begins, ends)]
                + [pa.array(texts, pa.string())],
                names=[*keys, "piece_no", "begin_char", "end_char", "text"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.mapInArrow(run, f"{kinds}, piece_no int, begin_char int, end_char int, text string")
