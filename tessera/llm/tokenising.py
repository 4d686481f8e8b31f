"""The whole corpus as ids of a public tokenizer (problem 7).

Method: the ``tokenizers`` library over Arrow batches. Encoding is byte-level
BPE; offsets map tokens to characters, also where a character's bytes are
spread over several tokens, and decoding reverses the byte table.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter everywhere below.
TOKENIZER_DIR = "/opt/tokenizers"
#: Rows encoded at a time: bounds what a task holds besides its Arrow batch.
ROWS_AT_ONCE = 256
#: Pieces of text a process remembers the ids of, and their longest length.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
#: Where a text can be cut without changing its ids by a tokenizer that splits
#: as byte-level BPE does: between a character that isn't white space and a space
#: or line feed. No piece of its own splitting crosses such a place, and it never
#: looks back. By other tokenizers texts are encoded whole.
_CUTS = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def load_tokenizer(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The tokenizer, once per process. Strings that look like special tokens
    are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def reversible(tokenizer) -> bool:
    """Whether a tokenizer splits texts as plain byte-level BPE and changes no
    character before: then texts may be cut, and ids have offsets and a text."""
    made = json.loads(tokenizer.to_str())
    split = made.get("pre_tokenizer") or {}
    return made.get("normalizer") is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space")


def _batches(column: pa.Array, size: int) -> Iterator[list[str]]:
    for at in range(0, len(column), size):
        yield [t or "" for t in column.slice(at, size).to_pylist()]


class Encoder:
    """The library's encoding, with the ids of common pieces remembered."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.cuts = tokenizer, reversible(tokenizer)
        self.known: dict[str, list[int]] = {}

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if not self.cuts:
            return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        pieces = [_CUTS.split(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        missing = list(set(chain.from_iterable(pieces)).difference(known))
        fresh = {p: e.ids for p, e in zip(missing, self.tokenizer.encode_batch(missing, add_special_tokens=False))}
        known.update(fresh)
        out = [list(chain.from_iterable(map(known.__getitem__, own))) for own in pieces]
        for p in missing:
            if len(p) > REMEMBERED_CHARS:
                del known[p]
        return out


@lru_cache(maxsize=4)
def load_encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Encoder:
    return Encoder(load_tokenizer(name, folder))


def encode_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``documents``: its id and ``ids``, without special
    tokens. Empty and null texts have an empty list, never null; a null id
    stays; repeated rows stay repeated; other columns are ignored."""
    rows = documents.select(id_column, text_column)
    id_type = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(name, folder)
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(1), ROWS_AT_ONCE):
                lists = encode(texts)
                ends = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=[id_column, "ids"],
                )
                at += len(texts)

    return rows.mapInArrow(run, f"{id_column} {id_type}, ids array<int>")


def byte_table() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary,
    reversed: printable bytes stand for themselves, the others for the
    characters from U+0100 on in their order."""
    plain = [b for span in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(span[0], span[1] + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def _token_bytes(name: str, folder: str) -> list[bytes]:
    tokenizer, table = load_tokenizer(name, folder), byte_table()
    if not reversible(tokenizer):
        raise ValueError(f"{name} changes texts before it splits them; its ids can't be traced back")
    out = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i)
        out.append(bytes(table[c] for c in token) if token is not None and all(c in table for c in token) else (token or "").encode())
    return out


@lru_cache(maxsize=4)
def _token_sizes(name: str, folder: str) -> np.ndarray:
    return np.array([len(b) for b in _token_bytes(name, folder)], np.int64)


def spans_of(text: str, ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of a text, in code points: from the
    bytes of the tokens, and the character each byte belongs to. Tokens that
    hold part of a character's bytes cover the whole character."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    owner = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(_token_sizes(name, folder)[np.asarray(ids, np.int64)])
    return owner[np.concatenate(([0], ends[:-1]))], owner[ends - 1] + 1


def token_offsets(text: str | None, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> list[tuple[int, int, int]]:
    """(id, first character, end) of each token."""
    if not text:
        return []
    ids = load_encoder(name, folder)([text])[0]
    begins, ends = spans_of(text, ids, name, folder)
    return list(zip(ids, begins.tolist(), ends.tolist()))


def encode_with_offsets(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per token: the document's id, token_no (from 1), token_id,
    begin_char and end_char. Empty and null texts have no tokens."""
    rows = documents.select(id_column, text_column)
    id_type = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(name, folder)
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(1), ROWS_AT_ONCE):
                lists = encode(texts)
                sizes = [len(x) for x in lists]
                places = [spans_of(t, x, name, folder) for t, x in zip(texts, lists) if x]
                owners = np.repeat(np.arange(at, at + len(texts)), sizes)
                flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
                numbers = flat([np.arange(1, n + 1) for n in sizes if n])
                tokens = np.fromiter(chain.from_iterable(lists), np.int32, count=sum(sizes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(x, pa.int32()) for x in (numbers, tokens, flat([b for b, _ in places]), flat([e for _, e in places])))],
                    names=[id_column, "token_no", "token_id", "begin_char", "end_char"],
                )
                at += len(texts)

    return rows.mapInArrow(run, f"{id_column} {id_type}, token_no int, token_id int, begin_char int, end_char int")


def decode_ids(ids, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    """The text of a list of ids. Bytes are joined before they are read, so a
    character split over tokens comes back whole; one cut off by the end of the
    list becomes the replacement character. Ids outside the vocabulary raise."""
    table = _token_bytes(name, folder)
    if any(not 0 <= i < len(table) for i in (ids if ids is not None else ())):
        raise ValueError("an id outside the vocabulary")
    return b"".join(table[i] for i in (ids if ids is not None else ())).decode("utf-8", "replace")


def decode_corpus(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, id_column: str = "doc_id") -> DataFrame:
    """The texts of ``ids``: id and text; an empty or null list is an empty text."""
    rows = encoded.select(id_column, "ids")
    id_type = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids, name, folder) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return rows.mapInArrow(run, f"{id_column} {id_type}, text string")


def token_lengths(encoded: DataFrame) -> DataFrame:
    """Tokens per document, from ``encode_corpus``."""
    from pyspark.sql import functions as F

    return encoded.select("doc_id", F.size("ids").alias("n_tokens"))
