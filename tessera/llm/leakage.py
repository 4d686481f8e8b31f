"""Evaluation passages in training text (problem 8).

Method: a BM25 inverted index of the items with block-max WAND. Its terms are
pairs of adjacent words. Every document is cut into passages, maximal stretches
of word pairs the items know; each passage is a query, and every item that
scores at least its threshold is retrieved and verified. An item's threshold is the least score that a common stretch of
``min_words`` words can have with it, so that retrieval loses nothing. The
verification compares words: the longest common stretch with the item's text,
and whether its question and answer turn up as well.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.functions.arrow import pieces
from tessera.llm.words import words

#: Consecutive words that make a leak.
MIN_WORDS = 12
#: BM25's saturation and length weights.
K1, B = 1.2, 0.75
#: Postings in a block of the index.
BLOCK = 32
#: Characters of items that one broadcast index may hold; measured, a built index
#: takes some INDEX_FACTOR bytes a character, so about 200 MB. More items are
#: taken in blocks of this size, each against all documents.
INDEX_CHARS, INDEX_FACTOR = 4_000_000, 50
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Item:
    item_id: int
    words: list[str]
    prompt: str | None
    answer: str | None


class Index:
    """Items by word pair, with each pair's weight in them, block by block."""

    def __init__(self, items: list[Item], min_words: int = MIN_WORDS) -> None:
        if min_words < 2:
            raise ValueError("a leak takes at least two words")
        self.min_words = min_words
        self.items = items = [i for i in items if len(i.words) >= min_words]
        self.vocabulary: dict[str, int] = {}
        self.rows = [array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in i.words]) for i in items]
        self.sizes = [len(row) for row in self.rows]
        #: word pairs, packed into one number, by their running number
        self.pairs: dict[int, int] = {}
        pairs = [array("i", [self.pairs.setdefault(p, len(self.pairs)) for p in _packed(row)]) for row in self.rows]
        seen = Counter(t for row in pairs for t in set(row))
        mean = sum(map(len, pairs)) / len(pairs) if pairs else 1.0
        idf = [math.log(1 + (len(pairs) - seen[t] + 0.5) / (seen[t] + 0.5)) for t in range(len(self.pairs))]
        self.thresholds = array("d")
        # postings of pair t stand at starts[t] to starts[t + 1]
        self.starts = array("q", [0])
        for t in range(len(self.pairs)):
            self.starts.append(self.starts[-1] + seen[t])
        fill = self.starts[:-1]
        self.posted, self.weights = array("i", bytes(4 * self.starts[-1])), array("d", bytes(8 * self.starts[-1]))
        for at, row in enumerate(pairs):
            weights = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(row) / mean)) for t, n in Counter(row).items()}
            for t, w in weights.items():
                self.posted[fill[t]], self.weights[fill[t]] = at, w
                fill[t] += 1
            size = min_words - 1
            least = min(sum(weights[t] for t in set(row[k : k + size])) for k in range(len(row) - size + 1))
            self.thresholds.append(least * (1 - 1e-9))
        self.floor = min(self.thresholds, default=math.inf)
        #: hashes of each item's stretches of min_words words, in order, and their places
        self.grams = []
        for row in self.rows:
            grams = _gram_hashes(row, min_words)
            order = np.argsort(grams, kind="stable").astype(np.int32)
            self.grams.append((grams[order], order))

    def _list(self, t: int) -> tuple:
        """The postings of a pair: items, weights, the largest weight, and the
        last item and largest weight of each block."""
        items, weights = self.posted[self.starts[t] : self.starts[t + 1]], self.weights[self.starts[t] : self.starts[t + 1]]
        blocks = range(0, len(items), BLOCK)
        return items, weights, max(weights), [items[min(k + BLOCK, len(items)) - 1] for k in blocks], [max(weights[k : k + BLOCK]) for k in blocks]

    def search(self, terms: list[int]) -> list[int]:
        """Items that score at least their threshold for the word pairs given, by
        block-max WAND: items in order, skipping to where the lists' bounds can reach the floor."""
        cursors = [[self._list(t), 0] for t in dict.fromkeys(terms)]
        found = []
        floor = self.floor
        while cursors:
            cursors.sort(key=lambda c: c[0][0][c[1]])
            bound, pivot = 0.0, -1
            for k, (entry, _) in enumerate(cursors):
                bound += entry[2]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][0][cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][1]] == item:
                pivot += 1
            # the blocks the item falls in bound it more tightly
            tight, block_end = 0.0, math.inf
            for (_, _, _, lasts, tops), at in cursors[: pivot + 1]:
                block = at // BLOCK
                while lasts[block] < item:
                    block += 1
                    if block == len(lasts):
                        break
                else:
                    tight += tops[block]
                    block_end = min(block_end, lasts[block])
            if tight >= floor:
                score = 0.0
                for entry, at in cursors[: pivot + 1]:
                    k = _seek(entry[0], at, item)
                    if k < len(entry[0]) and entry[0][k] == item:
                        score += entry[1][k]
                if score >= self.thresholds[item]:
                    found.append(item)
                target = item + 1
            else:
                following = cursors[pivot + 1][0][0][cursors[pivot + 1][1]] if pivot + 1 < len(cursors) else math.inf
                target = max(item + 1, min(block_end + 1, following))
            for c in cursors[: pivot + 1]:
                c[1] = _seek(c[0][0], c[1], target)
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
        return found

    def passages(self, text_words: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Words and pairs of the maximal stretches whose pairs the items know,
        of at least min_words words."""
        size, know = self.min_words, self.vocabulary.get
        run: list[int] = []
        for t in [*map(know, text_words), None]:
            if t is not None:
                run.append(t)
                continue
            if len(run) >= size:
                begin, terms = 0, []
                for k, pair in enumerate([*map(self.pairs.get, _packed(run)), None]):
                    if pair is not None:
                        terms.append(pair)
                        continue
                    if len(terms) >= size - 1:
                        yield run[begin : k + 1], terms
                    begin, terms = k + 1, []
            run = []

    def leaks(self, text_words: list[str]) -> dict[int, int]:
        """Items that leaked into a text, with the longest common stretch."""
        out: dict[int, int] = {}
        size = self.min_words
        for run, terms in self.passages(text_words):
            grams = None
            for item in self.search(terms):
                if grams is None:
                    grams = _gram_hashes(run, size)
                known, places = self.grams[item]
                row, longest = self.rows[item], 0
                first = np.searchsorted(known, grams)
                for k in np.flatnonzero(known[np.minimum(first, known.size - 1)] == grams):
                    at = int(first[k])
                    while at < known.size and known[at] == grams[k]:
                        p, n = int(places[at]), 0
                        while k + n < len(run) and p + n < len(row) and run[k + n] == row[p + n]:
                            n += 1
                        longest = max(longest, n if n >= size else 0)
                        at += 1
                if longest:
                    out[item] = max(out.get(item, 0), longest)
        return out


def _packed(row: list[int]) -> list[int]:
    return [a << 32 | b for a, b in zip(row, row[1:])]


def _gram_hashes(row: list[int], size: int) -> np.ndarray:
    """A hash of each stretch of ``size`` words."""
    ids = np.asarray(row, np.uint64) + np.uint64(1)
    grams = np.zeros(max(0, ids.size - size + 1), np.uint64)
    for k in range(size):
        grams = (grams ^ ids[k : k + grams.size]) * _MULTIPLIER
        grams ^= grams >> np.uint64(29)
    return grams


def _seek(places: list[int], at: int, target: float) -> int:
    """First position from ``at`` on whose item is not below ``target``."""
    step, end = 1, len(places)
    while at < end and places[at] < target:
        if at + step < end and places[at + step] < target:
            at += step
            step *= 2
        else:
            at += 1
            step = 1
    return at


def _holds(whole: list[str], part: list[str]) -> bool:
    return bool(part) and f" {' '.join(part)} " in f" {' '.join(whole)} "


def find_leaks(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, index_chars: int = INDEX_CHARS, report: bool = True) -> DataFrame:
    """Documents with at least ``min_words`` consecutive words in common with an
    item's text: doc_id, item_id and, with ``report``, common_words (the longest
    stretch), item_words, has_prompt, has_answer.

    Texts without words and items of fewer words match nothing. A document or
    item whose row is repeated counts once; null ids are left out, null prompts
    and answers count as not found; other columns are ignored. The documents
    aren't shuffled: each task searches the broadcast index, whose size is
    checked first; items beyond it are taken in blocks.
    """
    spark = documents.sparkSession
    items = benchmark.select("item_id", "text", *([c for c in ("prompt", "answer")] if report else [])).filter("item_id is not null and text is not null").dropDuplicates(["item_id"])
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / index_chars))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    extra = ", common_words int, item_words int, has_prompt boolean, has_answer boolean" if report else ""
    parts = []
    for block in range(n_blocks):
        own = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        index = Index([Item(r["item_id"], words(r["text"]), *((r["prompt"], r["answer"]) if report else (None, None))) for r in own.collect()], min_words)
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            ids = pa.array([i.item_id for i in index.items])
            asked = [(words(i.prompt), words(i.answer)) for i in index.items] if report else []
            for batch in pieces(batches):
                owners, items_found, rest = [], [], []
                for k, text in enumerate(batch.column(1)):
                    own_words = words(text.as_py())
                    found = index.leaks(own_words)
                    if found and report:
                        rest += [(n, index.sizes[i], _holds(own_words, asked[i][0]), _holds(own_words, asked[i][1])) for i, n in found.items()]
                    owners += [k] * len(found)
                    items_found += found
                columns = [batch.column(0).take(pa.array(owners, pa.int64())), ids.take(pa.array(items_found, pa.int64()))]
                names = ["doc_id", "item_id"]
                if report:
                    more = list(zip(*rest)) if rest else [()] * 4
                    columns += [pa.array(more[0], pa.int32()), pa.array(more[1], pa.int32()), pa.array(more[2], pa.bool_()), pa.array(more[3], pa.bool_())]
                    names += ["common_words", "item_words", "has_prompt", "has_answer"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        if index.items:
            parts.append(documents.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(run, f"doc_id {id_type}, item_id {item_type}{extra}"))
    if not parts:
        return spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}{extra}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["doc_id", "item_id"])


def leak_report(leaks: DataFrame) -> DataFrame:
    """Per item: in how many documents it turns up and how fully."""
    return leaks.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.max(F.col("common_words") / F.col("item_words")).alias("most_of_text"),
        F.sum(F.col("has_prompt").cast("int")).alias("with_prompt"),
        F.sum(F.col("has_answer").cast("int")).alias("with_answer"),
    )
