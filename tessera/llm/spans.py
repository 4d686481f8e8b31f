"""Long exact spans shared between documents (problem 9).

Method: a count-min prefilter. A document's windows are picked by their content
(the least hash among neighbours), so that two texts with a stretch of
``min_chars`` in common have a picked window in common. Pass one counts the
windows of each partition in a count-min sketch of saturating counters (none,
one, more); the sketches are merged. It can only overestimate. The sketch has at
least two counters a window, counted from the bytes of all texts. Pass two keeps
the windows estimated repeated and groups those exactly; windows that meet are
extended to the whole common stretch, character by character. No pair is lost.

A window many texts share says little: a standing phrase shorter than the
stretch wanted. Before such texts are paired the window is widened in steps, to
either side, until it nearly has the length wanted; texts meet only where a
widened window agrees.

Where the sketch would outgrow what may be broadcast, windows are grouped
exactly by their hash instead, by one shuffle of hashes; the result is the same.

Documents with the same text are one class: its first document stands for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from tessera.functions.arrow import pieces
from tessera.session import materialise, scratch_dir

#: Characters a shared stretch has at least.
MIN_CHARS = 400
#: Bytes of a window. A stretch of MIN_CHARS has at least as many bytes, so the
#: least hash of MIN_CHARS - WINDOW + 1 neighbouring windows lies within it.
WINDOW = 256
#: Rows of the sketch, and its counters in a row as a power of two: at least two
#: a window, of which a text has about one per so many bytes. The upper bound is
#: 2 x 32 MB, in the driver and in each worker.
SKETCH_ROWS, LEAST_BITS, MOST_BITS = 2, 16, 28
WINDOW_BYTES = 57
#: Windows of a partition counted at a time.
COUNT_ROWS = 4_000_000
#: Texts that may share a window before it is widened, and the widened windows
#: tried for it.
HOT, STEPS = 50, 16
#: A sketch travels in tiles of this many counters.
TILE = 1 << 16
#: Bytes of text hashed at a time.
BLOCK_BYTES = 1 << 20
#: Up to this size a class of equal texts is given as all its pairs, above it
#: as pairs of its first document with each other one.
FULL_CLASS = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if _powers.get(0, (np.empty(0),))[0].size < size:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for base in (_BASE, inverse):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[0] = (tables[0], tables[1])
    return _powers[0][0][:size], _powers[0][1][:size]


def _slide(values: np.ndarray, size: int, best, pad: np.uint64) -> np.ndarray:
    """``best`` (minimum or maximum) of each run of ``size`` values, by prefix
    and suffix within blocks of that size."""
    n = values.size - size + 1
    rows = -(-values.size // size)
    whole = np.full(rows * size, pad, np.uint64)
    whole[: values.size] = values
    whole = whole.reshape(rows, size)
    ahead = best.accumulate(whole, axis=1).ravel()
    behind = best.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[size - 1 : size - 1 + n])


def _picked(data: np.ndarray, ends: np.ndarray, window: int, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the picked windows of a block of texts laid end to
    end; ``ends`` are the texts' ends. Windows over an end are not windows."""
    reach = min_chars - window + 1
    if data.size < min_chars:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _power_tables(data.size)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = _mixed((sums[window:] - sums[:-window]) * down[: data.size - window + 1])
    hashes[hashes == _NONE] = 0
    for end in ends:
        hashes[max(0, end - window + 1) : end] = _NONE
    if hashes.size < reach:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _slide(hashes, reach, np.minimum, _NONE)
    # a window is picked if it is the least of some run that holds it
    padded = np.zeros(least.size + 2 * (reach - 1), np.uint64)
    padded[reach - 1 : reach - 1 + least.size] = least
    most = _slide(padded, reach, np.maximum, np.uint64(0))
    at = np.flatnonzero((most == hashes) & (hashes != _NONE))
    return at, hashes[at]


def _thin(hashes: np.ndarray, places: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the inner windows of periodic stretches: of equal windows less
    than ``reach`` apart the first and the last are kept, with the period (0
    for others). Each lies within a period of its end of the stretch, so that
    the best shift of two stretches is that of two firsts or of two lasts, or a
    period beside it."""
    order = np.lexsort((places, hashes))
    h, p = hashes[order], places[order]
    gap = p[1:] - p[:-1]
    near = (h[1:] == h[:-1]) & (gap < reach)
    period = np.zeros(h.size, np.int64)
    period[1:] = np.where(near, gap, 0)
    period[:-1] = np.where(near, gap, period[:-1])
    inner = np.zeros(h.size, bool)
    inner[1:-1] = near[:-1] & near[1:]
    return h[~inner], p[~inner], period[~inner]


def text_windows(column: pa.Array, window: int = WINDOW, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place (in UTF-8 bytes) and hash of every picked window of an Arrow
    string column. Texts are hashed in blocks; one longer than a block in
    blocks that overlap by what a pick can see."""
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(begin: int, end: int, ends: np.ndarray) -> None:
        at, h = _picked(data[begin:end], ends - begin, window, min_chars)
        if at.size:
            rows = np.searchsorted(offsets, at + begin, side="right") - 1
            out.append((rows, at + begin - offsets[rows], h))

    row, n = 0, len(column)
    while row < n:
        if offsets[row + 1] - offsets[row] > BLOCK_BYTES:
            for at in range(offsets[row], offsets[row + 1], BLOCK_BYTES):
                add(at, min(at + BLOCK_BYTES + min_chars, offsets[row + 1]), offsets[row + 1 : row + 2])
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
        add(int(offsets[row]), int(offsets[last]), offsets[row + 1 : last + 1])
        row = last
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    rows, places, hashes = (np.concatenate(x) for x in zip(*out))
    keep = np.unique(np.stack([rows, places]), axis=1, return_index=True)[1]
    return rows[keep], places[keep], hashes[keep]


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mixed(hashes + np.uint64(0x632BE59BD9B4E019 * (row + 1) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def _distinct_per_row(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each document's distinct windows: one repeated within a document only
    isn't shared."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    first = np.ones(h.size, bool)
    first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return h[first]


def sketch_bits(documents: DataFrame, min_chars: int = MIN_CHARS) -> int:
    """Bits for a sketch of these texts, from the bytes of all of them."""
    total = documents.filter(F.length("text") >= min_chars).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BITS, (2 * total // WINDOW_BYTES).bit_length())


def _saturated(cells: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order with their counts up to two."""
    if not cells.size:
        return cells, np.zeros(0, np.uint8)
    order = np.argsort(cells, kind="stable")
    ordered = cells[order]
    own = np.ones(cells.size, np.int64) if counts is None else counts[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[at], np.minimum(np.add.reduceat(own, at), 2).astype(np.uint8)


def build_sketch(documents: DataFrame, window: int = WINDOW, min_chars: int = MIN_CHARS, bits: int = LEAST_BITS) -> list[bytes]:
    """Pass one: the counters that reached two, as a bit map for each row of the
    sketch. A partition's sketch holds what it counted, tile by tile, as the
    places of its counters; the merged one is bounded by ``bits``."""
    tile_size = min(TILE, 1 << bits)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(SKETCH_ROWS)]
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, parts in enumerate(held):
                cells, counts = _saturated(np.concatenate(parts) if parts else np.zeros(0, np.int64))
                parts.clear()
                tiles = cells // tile_size
                edges = np.searchsorted(tiles, np.unique(tiles), side="left")
                rows = []
                for begin, end in zip(edges, [*edges[1:], cells.size]):
                    inside = (cells[begin:end] % tile_size).astype(np.uint16)
                    more = counts[begin:end] > 1
                    rows.append({"sketch_row": k, "tile": int(tiles[begin]), "one": inside[~more].tobytes(), "more": inside[more].tobytes()})
                for at in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 512], schema=tile_schema)

        for batch in batches:
            rows, _, hashes = text_windows(batch.column(0), window, min_chars)
            once = _distinct_per_row(rows, hashes)
            for k, parts in enumerate(held):
                parts.append(_cells(once, k, bits))
            n += once.size
            if n >= COUNT_ROWS:
                yield from flush()
                n = 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                had = merged.setdefault((r["sketch_row"], r["tile"]), np.zeros(tile_size, np.uint8))
                one = np.frombuffer(r["one"], np.uint16)
                had[one] = np.minimum(had[one] + 1, 2)
                had[np.frombuffer(r["more"], np.uint16)] = 2
        for (k, t), counts in merged.items():
            if (counts > 1).any():
                yield pa.RecordBatch.from_pylist([{"sketch_row": k, "tile": t, "more": np.packbits(counts > 1).tobytes()}], schema=merged_schema)

    tile_schema = pa.schema([("sketch_row", pa.int32()), ("tile", pa.int32()), ("one", pa.binary()), ("more", pa.binary())])
    merged_schema = pa.schema([("sketch_row", pa.int32()), ("tile", pa.int32()), ("more", pa.binary())])
    tiles = documents.select("text").filter(F.length("text") >= min_chars).mapInArrow(local, "sketch_row int, tile int, one binary, more binary")
    merged = tiles.repartition("sketch_row", "tile").mapInArrow(merge, "sketch_row int, tile int, more binary")
    maps = [bytearray((1 << bits) // 8 or 1) for _ in range(SKETCH_ROWS)]
    for r in merged.toLocalIterator():
        at = r["tile"] * tile_size // 8
        maps[r["sketch_row"]][at : at + len(r["more"])] = r["more"]
    return [bytes(m) for m in maps]


def _estimated_repeated(hashes: np.ndarray, sketch: list[bytes], bits: int) -> np.ndarray:
    keep = np.ones(hashes.size, bool)
    for k, row in enumerate(sketch):
        cells = _cells(hashes, k, bits)
        packed = np.frombuffer(row, np.uint8)
        keep &= (packed[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
    return keep


def widened(text: bytes, places: list[int], window: int, min_chars: int, steps: int = STEPS) -> list[tuple[int, int]]:
    """Hashes of the windows at these places (in bytes) widened by whole
    characters in every mix of ``steps`` steps to the left and to the right, as
    (number of the place, hash). Any stretch of ``min_chars`` characters around
    a window holds one of its widened windows."""
    data = np.frombuffer(text, np.uint8)
    starts = np.concatenate((np.flatnonzero((data & 0xC0) != 0x80), [data.size]))
    out = []
    for k, place in enumerate(places):
        # the characters that lie wholly within the window
        first = int(np.searchsorted(starts, place))
        last = int(np.searchsorted(starts, place + window, side="right")) - 1
        size = (min_chars - (last - first)) // steps
        if size < 1:
            out.append((k, xxhash.xxh3_64_intdigest(text[place : place + window]) >> 1))
            continue
        for left in range(steps):
            begin, end = first - left * size, last + (steps - 1 - left) * size
            if begin >= 0 and end < starts.size:
                out.append((k, xxhash.xxh3_64_intdigest(text[int(starts[begin]) : int(starts[end])], seed=left) >> 1))
    return out


def _periods(text: bytes, place: int, window: int, reach: int) -> Iterator[int]:
    """The periods below ``reach`` a window may lie in a repetition of."""
    head = text[place : place + window - reach + 1]
    if len(head) < 8:  # too short to tell, so any
        yield from range(1, reach)
        return
    at = text.find(head, place + 1, place + window)
    while at >= 0:
        yield at - place
        at = text.find(head, at + 1, place + window)


def _run_chars(text: bytes, place: int, period: int) -> int:
    """Characters of the stretch around a window that repeats its period. Two
    such stretches may meet at any of their repeats; where a common stretch goes
    beyond one, it holds its first or last window at the same place in both."""
    data = np.frombuffer(text, np.uint8)
    if period >= data.size:
        return 0
    breaks = np.flatnonzero(data[:-period] != data[period:])
    k = int(np.searchsorted(breaks, place))
    begin = int(breaks[k - 1]) + 1 if k else 0
    end = int(breaks[k]) + period if k < breaks.size else data.size
    return int(((data[begin:end] & 0xC0) != 0x80).sum())


def _stretch(a: bytes, b: bytes, at_a: int, at_b: int) -> tuple[int, int, int]:
    """The common stretch through two places as its begins and length in bytes."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(x.size - at_a, y.size - at_b)
    differ = np.flatnonzero(x[at_a : at_a + n] != y[at_b : at_b + n])
    ahead = int(differ[0]) if differ.size else n
    m = min(at_a, at_b)
    differ = np.flatnonzero(x[at_a - m : at_a] != y[at_b - m : at_b])
    back = m - 1 - int(differ[-1]) if differ.size else m
    return at_a - back, at_b - back, back + ahead


def _characters(a: bytes, begin: int, length: int) -> tuple[int, int]:
    """First character and number of the whole characters in a stretch of bytes."""
    starts = (np.frombuffer(a, np.uint8) & 0xC0) != 0x80
    end = begin + length
    inside = np.flatnonzero(starts[begin:end])
    if not inside.size:
        return 0, 0
    first = int(starts[: begin + inside[0]].sum())
    whole = int(inside.size)
    if end < starts.size and not starts[end]:
        whole -= 1  # the last character is cut
    return first, whole


@dataclass
class SharedSpans:
    """``spans`` between first documents of classes: doc_id_a, doc_id_b,
    begin_a, begin_b, n_chars. ``members``: doc_id, class_id, class_size,
    n_chars of every document whose text another one has, or that shares a span."""

    spans: DataFrame
    members: DataFrame

    def pairs(self, full_class: int = FULL_CLASS) -> DataFrame:
        """doc_id_a, doc_id_b of documents that share a stretch, smaller id
        first. Of classes up to ``full_class`` documents all pairs are given;
        of a larger class its first document with each other one, and its first
        document alone stands for it in the pairs with other texts."""
        shown = self.members.filter((F.col("class_size") <= full_class) | (F.col("doc_id") == F.col("class_id")))
        links = self.spans.select("doc_id_a", "doc_id_b").distinct()
        a = shown.select(F.col("class_id").alias("doc_id_a"), F.col("doc_id").alias("a"))
        b = shown.select(F.col("class_id").alias("doc_id_b"), F.col("doc_id").alias("b"))
        between = links.join(a, "doc_id_a").join(b, "doc_id_b").select("a", "b")
        several = self.members.filter("class_size > 1")
        small, large = several.filter(F.col("class_size") <= full_class), several.filter(F.col("class_size") > full_class)
        within = small.select("class_id", F.col("doc_id").alias("a")).join(small.select("class_id", F.col("doc_id").alias("b")), "class_id").filter("a < b").select("a", "b")
        star = large.filter("doc_id != class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
        every = between.unionByName(within).unionByName(star)
        return every.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()

    def coverage(self) -> DataFrame:
        """Per document with a shared stretch: doc_id, n_chars, shared_chars,
        n_links (other documents it shares with). A text another document has is
        shared as a whole. Of a stretch that only repeats a short period as
        much counts as its first and last occurrences cover."""
        both = self.spans.select(F.col("doc_id_a").alias("class_id"), F.col("doc_id_b").alias("other"), F.col("begin_a").alias("begin"), "n_chars").unionByName(
            self.spans.select(F.col("doc_id_b").alias("class_id"), F.col("doc_id_a").alias("other"), F.col("begin_b").alias("begin"), "n_chars")
        )
        # a union of intervals: what each adds beyond the furthest end before it
        from pyspark.sql import Window

        order = Window.partitionBy("class_id").orderBy("begin", "n_chars", "other")
        end = F.col("begin") + F.col("n_chars")
        reached = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        added = F.greatest(F.lit(0), end - F.greatest(F.col("begin"), reached))
        covered = both.withColumn("added", added).groupBy("class_id").agg(F.sum("added").alias("covered"))
        sizes = self.members.filter("doc_id = class_id").select(F.col("class_id").alias("other"), "class_size")
        linked = both.select("class_id", "other").distinct().join(sizes, "other").groupBy("class_id").agg(F.sum("class_size").alias("linked"))
        return self.members.join(covered, "class_id", "left").join(linked, "class_id", "left").select(
            "doc_id", "n_chars",
            F.when(F.col("class_size") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint").alias("shared_chars"),
            (F.coalesce("linked", F.lit(0)) + F.col("class_size") - 1).cast("bigint").alias("n_links"),
        )

    def classes(self) -> DataFrame:
        """doc_id, class_id (the first document with the same text), class_size
        of every document of a pair: with the pairs of first documents this is
        the whole result, whatever the size of the classes."""
        return self.members.select("doc_id", "class_id", "class_size")


def shared_spans(documents: DataFrame, min_chars: int = MIN_CHARS, window: int = WINDOW, bits: int | None = None) -> SharedSpans:
    """Stretches of at least ``min_chars`` characters that stand in more than
    one document of ``documents`` (doc_id, text). ``bits`` sizes the sketch, by
    default from the texts.

    Null, empty and shorter texts share nothing; null ids are left out; a row
    repeated with the same id counts once; other columns are ignored.
    """
    if not 0 < window <= min_chars:
        raise ValueError("the window must not be longer than the stretch")
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text").filter("doc_id is not null")
    if not isinstance(rows.schema["doc_id"].dataType, LongType):
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = rows.filter(F.length("text") >= min_chars)
    reach = min_chars - window + 1
    bits = sketch_bits(rows, min_chars) if bits is None else bits
    sketch = spark.sparkContext.broadcast(build_sketch(rows, window, min_chars, bits)) if bits <= MOST_BITS else None
    arrays = "hashes array<bigint>, places array<bigint>, periods array<bigint>"

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, hashes = text_windows(batch.column(1), window, min_chars)
            if sketch is not None:
                keep = _estimated_repeated(hashes, sketch.value, bits)
                owner, place, hashes = owner[keep], place[keep], hashes[keep]
            taken, lists, places, periods = [], [], [], []
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                h, p, period = _thin(hashes[bounds[k] : bounds[k + 1]], place[bounds[k] : bounds[k + 1]], reach)
                taken.append(int(k))
                lists.append(h.astype(np.int64))
                places.append(p)
                periods.append(period)
            take = pa.array(taken, pa.int64())
            texts = [batch.column(1).take(take)] if sketch is not None else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), *texts, *(pa.array(x, pa.list_(pa.int64())) for x in (lists, places, periods))],
                names=["doc_id", *["text"] * len(texts), "hashes", "places", "periods"],
            )

    if sketch is not None:
        kept = rows.mapInArrow(second, f"doc_id bigint, text string, {arrays}")
    else:
        every = rows.mapInArrow(second, f"doc_id bigint, {arrays}").select("doc_id", F.explode(F.arrays_zip("hashes", "places", "periods")).alias("w"))
        every = every.select("doc_id", F.col("w.hashes").alias("h"), "w")
        repeated = every.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("h")
        w = F.sort_array(F.collect_set("w"))
        found = every.join(repeated, "h").groupBy("doc_id").agg(w.alias("w")).select("doc_id", *[F.col(f"w.{c}").alias(c) for c in ("hashes", "places", "periods")])
        kept = rows.dropDuplicates(["doc_id"]).join(found, "doc_id").select("doc_id", "text", "hashes", "places", "periods")
    scratch = scratch_dir(spark)
    kept = materialise(kept.withColumn("digest", F.md5("text")), f"{scratch}/kept")
    classes = kept.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("class_size"))
    small = kept.select("doc_id", "digest", F.length("text").alias("n_chars")).distinct().join(classes, "digest")
    heads = kept.join(classes, "digest").filter("doc_id = class_id").dropDuplicates(["doc_id"])
    texts = heads.select("doc_id", "text")
    windows = heads.select("doc_id", F.explode(F.arrays_zip("hashes", "places", "periods")).alias("w")).select("doc_id", F.col("w.hashes").alias("h"), F.col("w.places").alias("place"), F.col("w.periods").alias("period"))
    windows = materialise(windows, f"{scratch}/windows")
    counts = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cold = windows.join(counts.filter(F.col("n") <= HOT).select("h"), "h")
    hot = windows.join(counts.filter(F.col("n") > HOT).select("h"), "h")

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, keys, at, steps = [], [], [], []
            for doc_id, text, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keyed = widened(text, [w["place"] for w in found], window, min_chars)
                for k, w in enumerate(found):
                    if any(_run_chars(text, w["place"], p) >= min_chars for p in _periods(text, w["place"], window, reach)):
                        keyed.append((k, xxhash.xxh3_64_intdigest(text[w["place"] : w["place"] + window], seed=STEPS) >> 1))
                for k, h in keyed:
                    ids.append(doc_id)
                    keys.append(h)
                    at.append(found[k]["place"])
                    steps.append(found[k]["period"])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, keys, at, steps)], names=["doc_id", "h", "place", "period"])

    wide = (
        hot.groupBy("doc_id").agg(F.collect_list(F.struct("place", "period")).alias("found")).join(texts, "doc_id")
        .select("doc_id", F.col("text").cast("binary").alias("text"), "found").mapInArrow(widen, "doc_id bigint, h bigint, place bigint, period bigint")
    )

    def meeting(of: DataFrame) -> DataFrame:
        left = of.select("h", F.col("doc_id").alias("doc_id_a"), F.col("place").alias("place_a"), F.col("period").alias("period_a"))
        right = of.select("h", F.col("doc_id").alias("doc_id_b"), F.col("place").alias("place_b"), F.col("period").alias("period_b"))
        return left.join(right, "h").filter("doc_id_a < doc_id_b")

    meets = (
        meeting(cold).unionByName(meeting(wide))
        .withColumn("period", F.greatest("period_a", "period_b"))
        .withColumn("aside", F.explode(F.expr("if(period > 0, array(0L, -period, period), array(0L))")))
        .withColumn("slack", F.abs("aside"))
        .groupBy("doc_id_a", "doc_id_b", (F.col("place_a") - F.col("place_b") + F.col("aside")).alias("shift"))
        .agg(F.min(F.col("place_a") - F.col("slack")).alias("place_a"), F.max(F.col("place_a") + F.col("slack")).alias("last_a"))
        .groupBy("doc_id_a", "doc_id_b").agg(F.collect_list(F.struct("shift", "place_a", "last_a")).alias("shifts"))
    )
    with_texts = (
        meets.join(texts.select(F.col("doc_id").alias("doc_id_a"), F.col("text").alias("text_a")), "doc_id_a")
        .join(texts.select(F.col("doc_id").alias("doc_id_b"), F.col("text").alias("text_b")), "doc_id_b")
        .select("doc_id_a", "doc_id_b", "shifts", F.col("text_a").cast("binary"), F.col("text_b").cast("binary"))
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owners, begins_a, begins_b, sizes = [], [], [], []
            for k in range(batch.num_rows):
                a, b = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
                for found in batch.column(2)[k].as_py():
                    shift, at, last = found["shift"], found["place_a"], found["last_a"]
                    at = _next_common(a, b, max(at, shift, 0), shift, last, window)
                    while at <= last:
                        x, y, n = _stretch(a, b, at, at - shift)
                        first_a, chars = _characters(a, x, n)
                        if chars >= min_chars:
                            owners.append(k)
                            begins_a.append(first_a)
                            begins_b.append(_characters(b, y, n)[0])
                            sizes.append(chars)
                        # other stretches on the same shift lie beyond the end of this one
                        at = _next_common(a, b, x + max(n, 1), shift, last, window)
            take = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take)] + [pa.array(x, pa.int64()) for x in (begins_a, begins_b, sizes)],
                names=["doc_id_a", "doc_id_b", "begin_a", "begin_b", "n_chars"],
            )

    spans = with_texts.mapInArrow(extend, "doc_id_a bigint, doc_id_b bigint, begin_a bigint, begin_b bigint, n_chars bigint")
    spans = materialise(spans, f"{scratch}/spans")
    touched = spans.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("class_id")).distinct()
    members = small.join(touched.withColumn("touched", F.lit(True)), "class_id", "left").filter("class_size > 1 or touched").select("doc_id", "class_id", "class_size", "n_chars")
    return SharedSpans(spans, members)


def _next_common(a: bytes, b: bytes, at: int, shift: int, last: int, window: int) -> int:
    """The next place from ``at`` on where a window of both texts is equal at
    this shift; beyond ``last`` if there is none."""
    if at > last:
        return last + 1
    end = min(last + window, len(a), len(b) + shift)
    equal = np.frombuffer(a, np.uint8)[at:end] == np.frombuffer(b, np.uint8)[at - shift : end - shift]
    breaks = np.flatnonzero(~equal)
    edges = np.concatenate(([-1], breaks, [equal.size]))
    runs = np.flatnonzero(np.diff(edges) - 1 >= window)
    return at + int(edges[runs[0]]) + 1 if runs.size else last + 1
