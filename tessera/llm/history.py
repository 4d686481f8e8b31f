"""New uploads against everything accepted before (problem 3).

Method: multi-key sorted-neighbourhood runs. An upload enters one order several
times. Each of its text keys reads three words from an anchor in the text and
three from a second one (anchors are the places of least hash, so that
near-copies choose the same); keys are compared word by word, and equal words
lie in the order of the texts' lengths. The neighbourhood of a new upload under
a key is thus one stretch of the order: the same six words, and the lengths
from a tenth shorter to a tenth longer. A content hash is a key of its own.

The keys of accepted uploads are kept as sorted runs, cut into range files with
small pages. A batch is sorted, merged against the ranges its keys fall in and
compared within the windows around them only; what is accepted becomes a new
run, and runs of one tier are merged into one of the next when enough have
gathered. Texts lie sorted by id and only the pages of those to be compared are
read. A manifest names all that counts; the store can be opened again by
another process and takes the next batch from there.

An entry also holds how often words of each of 48 kinds occur in its text. An
edit changes two of these counts by one at most, so that a pair whose counts
differ by more than twice the edits allowed is no match; such pairs, uploads that
only share phrases, are left out within the window, before any text is read.

Texts are compared exactly: word edit distance, bit-parallel. A pair within the
limit shares at least half its shingles even if its changes lie as far apart as
they can; ``BANDS`` keys of two anchors then miss it with a chance of 1 in
4,000, and pairs that differ in every twentieth word with a chance below 1e-8.
Keys depend on no other text and on no sample.

History holds accepted uploads only, so that a group of copies, however large,
is one entry. Within a batch a crowded window is compared with its first
upload only, and what that leaves undecided goes through the loop again,
with a wider notion of crowded each turn. An upload of a crowded window that is
found to be a repeat is named by a last comparison with all accepted ones.

Uploads of a batch are taken by id. Between batches ids say nothing: an upload
is compared with all that was accepted before, whatever its id.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType

from tessera.functions.arrow import pieces
from tessera.llm.normalise import transducer
from tessera.llm.words import words
from tessera.session import remove, scratch_dir

#: A match may change this share of the words of the longer text.
TOLERANCE = 0.1
#: Keys of two anchors each, and the words read at an anchor.
BANDS, SHINGLE = 24, 3
#: Bits that stand for a word in a key: with the number of the key (5 bits), six
#: words and the flag of a hash make 60.
WORD_BITS = 9
#: Kinds of words counted for an entry, each up to 15.
KINDS = 48
#: Uploads of one batch that one of them may repeat by these counts and from which
#: only the first of its key is compared, and by how much that grows with each
#: turn: copies are gone after the first.
CROWD, CROWD_GROWTH = 200, 4
#: Uploads of one key that are held to find its windows.
HELD = 50_000
#: Runs of one tier merged into one of the next.
COMPACT_EVERY = 8
#: Entries in a range file, and in a page of one.
RANGE_ROWS, RUN_PAGE = 4_000_000, 128
#: Texts in a page of the stored records.
RECORD_PAGE = 8
#: Uploads for which a batch is written by one task more.
BATCH_ROWS = 100_000
#: Rows of keys or pairs, some 24 bytes each, up to which they are broadcast,
#: and matches of a batch up to which they are settled on the driver; beyond it
#: the same is done by shuffles.
KEY_ROWS, SMALL_ROWS = 1_000_000, 200_000
#: Intervals a read is narrowed to around the keys or ids looked up, where their
#: pages are less than an eighth of what is stored. It only decides what is skipped.
INTERVALS = 128
#: Keys of a batch, entries of the runs and pairs up to which one task does a
#: step without a shuffle.
TASK_KEYS, TASK_ENTRIES, TASK_PAIRS = 50_000, 1_000_000, 400
#: Ids written into a condition; more are joined.
LISTED = 2000

_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, size=(2, BANDS * 2), dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def digest_of(raw: str | None) -> str | None:
    """A content hash in one spelling: lower-case hex without prefix, spaces or
    separators; a Base64 digest is written as hex. Null for null and blank."""
    if raw is None:
        return None
    text = re.sub(r"^\s*(?:sha|md)-?\d+\s*[:=]\s*", "", raw.strip(), flags=re.IGNORECASE)
    text = re.sub(r"^0x", "", text, flags=re.IGNORECASE)
    plain = re.sub(r"[\s:._-]", "", text).lower()
    if re.fullmatch(r"[0-9a-f]+", plain):
        return plain
    try:
        data = base64.b64decode(text.replace("-", "+").replace("_", "/"), validate=True)
    except (binascii.Error, ValueError):
        data = b""
    return data.hex() if len(data) in (16, 20, 32, 64) else plain or None


def within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether two word lists are at most ``limit`` edits apart."""
    if a.size > b.size:
        a, b = b, a
    if b.size - a.size > limit:
        return False
    # equal ends change nothing
    n = a.size
    differ = np.flatnonzero(a != b[:n])
    head = int(differ[0]) if differ.size else n
    if head == n:
        return True
    differ = np.flatnonzero(a[head:][::-1] != b[b.size - (n - head) :][::-1])
    tail = int(differ[0]) if differ.size else n - head
    a, b = a[head : n - tail], b[head : b.size - tail]
    values, counts = np.unique(b, return_counts=True)
    own, n_own = np.unique(a, return_counts=True)
    at = np.minimum(np.searchsorted(values, own), max(values.size - 1, 0))
    common = int(np.minimum(n_own, np.where(values[at] == own, counts[at], 0)).sum()) if values.size else 0
    if b.size - common > limit:
        return False
    if a.size == 0:
        return b.size <= limit
    return _edits(a.tolist(), b.tolist(), limit) <= limit


def _edits(a: list, b: list, limit: int) -> int:
    """Levenshtein distance of lists by bit vectors as long as ``a``; stops
    once it must exceed ``limit``."""
    m = len(a)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    for left, x in zip(range(len(b) - 1, -1, -1), b):
        equal = where.get(x, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance - left > limit:
            return limit + 1
        up = (up << 1 | 1) & full
        down = down << 1 & full
        equal |= minus
        plus = down | (full & ~(equal | up))
        minus = up & equal
    return distance


def grams_of(tokens: np.ndarray) -> np.ndarray:
    """A hash of the shingle at each place; a shorter text has one as a whole."""
    t = tokens.astype(np.uint64)
    if t.size < SHINGLE:
        return np.array([np.bitwise_xor.reduce((t + np.uint64(7)) * _MIX)], np.uint64)
    grams = np.zeros(t.size - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        grams = (grams + t[k : k + grams.size] + np.uint64(1)) * _MIX
        grams ^= grams >> np.uint64(29)
    return grams


def sort_keys(tokens: np.ndarray) -> list[int]:
    """The text keys: the words at two anchors each, as numbers that stand key by
    key in the order of those words. They are even; keys of hashes are odd."""
    grams, places = np.unique(grams_of(tokens), return_index=True)
    least = np.full(BANDS * 2, np.uint64(0xFFFFFFFFFFFFFFFF))
    anchors = np.zeros(BANDS * 2, np.int64)
    for at in range(0, grams.size, 4096):
        block = grams[at : at + 4096, None] * _SEEDS[0] + _SEEDS[1]
        block ^= block >> np.uint64(31)
        block *= _MIX
        own = block.argmin(axis=0)
        value = block[own, np.arange(BANDS * 2)]
        lower = value < least
        least[lower], anchors[lower] = value[lower], places[at + own[lower]]
    codes = np.zeros(tokens.size + SHINGLE, np.int64)
    codes[: tokens.size] = tokens >> np.uint32(32 - WORD_BITS)
    read = np.zeros(BANDS * 2, np.int64)
    for k in range(SHINGLE):
        read = read << WORD_BITS | codes[anchors + k]
    which = np.arange(BANDS) << 2 * WORD_BITS * SHINGLE
    return ((which | read[0::2] << WORD_BITS * SHINGLE | read[1::2]) << 1).tolist()


def kinds_of(tokens: np.ndarray) -> bytes:
    """How often each kind of word occurs, two counts of up to 15 a byte."""
    counts = np.bincount((tokens.astype(np.uint64) * np.uint64(KINDS) >> np.uint64(32)).astype(np.int64), minlength=KINDS)
    counts = np.minimum(counts, 15).astype(np.uint8)
    return (counts[0::2] | counts[1::2] << 4).tobytes()


def may_match(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether counts (rows of bytes, or one row) allow so many edits."""
    low = np.abs((a & 15).astype(np.int16) - (b & 15)).sum(axis=-1)
    return low + np.abs((a >> 4).astype(np.int16) - (b >> 4)).sum(axis=-1) <= 2 * limit


def _rows_of(column: pa.Array) -> np.ndarray:
    """A column of equally long binaries as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), KINDS // 2)


def _hashed_words(chunks: DataFrame) -> DataFrame:
    """document_id and its words in order as packed 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        even, memo = transducer(), {}
        for batch in pieces(batches):
            packed = []
            for text in batch.column(3).to_pylist():
                own = words(even(text))
                if len(memo) > 500_000:
                    memo.clear()
                for w in set(own).difference(memo):
                    memo[w] = _word_hash(w)
                packed.append(np.array([*map(memo.__getitem__, own)], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + [pa.array(packed, pa.binary())], names=["document_id", "chunk_index", "chunk_id", "words"])

    rows = chunks.select("document_id", "chunk_index", F.col("chunk_id").cast("bigint"), "text").filter("text is not null and document_id is not null")
    hashed = rows.mapInArrow(run, "document_id string, chunk_index int, chunk_id bigint, words binary").filter(F.length("words") > 0)
    return hashed.groupBy("document_id").agg(F.collect_list(F.struct("chunk_index", "chunk_id", "words")).alias("parts"))


def _in_order(parts: list[dict] | None) -> bytes:
    """The words of a document's chunks in order, each chunk once."""
    chunks = {(p["chunk_index"] if p["chunk_index"] is not None else -1, p["chunk_id"] if p["chunk_id"] is not None else -1): p["words"] for p in parts or ()}
    return b"".join(chunks[k] for k in sorted(chunks))


def _word_hash(word: str) -> int:
    data = word.encode("utf-8", "surrogatepass")
    return (crc32(data) * 0x9E3779B1 ^ crc32(data[::-1], len(data))) & 0xFFFFFFFF


@F.pandas_udf(StringType())
def _digests(raw):
    return raw.map(digest_of, na_action="ignore")


RECORDS = "upload_id bigint, digest string, n_words int, words binary, keys array<bigint>, kinds binary"
PREPARED = f"batch_no int, {RECORDS}"


def prepare_uploads(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each upload as it is compared: its digest, its words and its sort keys.
    Repeated rows count once; null ids are left out; uploads without words have
    the key of their hash only; a null batch number counts as the last batch."""
    up = (
        uploads.filter("upload_id is not null").select(F.coalesce(F.col("batch_no"), F.lit((1 << 31) - 1)).alias("batch_no"), F.col("upload_id").cast("bigint").alias("upload_id"), "document_id", _digests("content_hash").alias("digest"))
        .dropDuplicates(["upload_id"])
    )
    joined = up.join(_hashed_words(chunks), "document_id", "left").select("batch_no", "upload_id", "digest", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, keys, texts, kinds = [], [], [], []
            for digest, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = _in_order(parts)
                tokens = np.frombuffer(data, np.uint32)
                own = sort_keys(tokens) if data else []
                kinds.append(kinds_of(tokens))
                if digest:
                    head = digest.encode()
                    own.append((crc32(head) << 31 | crc32(head[::-1]) & 0x7FFFFFFF) << 1 & 0x7FFFFFFFFFFFFFFF | 1)
                sizes.append(len(data) // 4)
                keys.append(own)
                texts.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(3)] + [pa.array(sizes, pa.int32()), pa.array(texts, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(kinds, pa.binary())],
                names=["batch_no", "upload_id", "digest", "n_words", "words", "keys", "kinds"],
            )

    return joined.mapInArrow(run, PREPARED)


RUN = "key bigint, n_words int, upload_id bigint, batch_no int, kinds binary"
PAIRS = "a bigint, b bigint"
#: a with the batch it lies in, null for an upload that has to wait.
CANDIDATES = "a bigint, a_batch int, b bigint"


def intervals(values: list[int], most: int = INTERVALS) -> list[tuple[int, int]]:
    """At most ``most`` intervals that hold all values, open at the widest gaps."""
    at = np.unique(np.asarray(values, np.int64))
    if not at.size:
        return []
    cuts = np.sort(np.argsort(at[1:] - at[:-1], kind="stable")[::-1][: most - 1])
    begins, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [at.size - 1]))
    return [(int(at[a]), int(at[b])) for a, b in zip(begins, ends)]


def _near(column: str, values: list[int]) -> str:
    """A condition the scan can skip pages by: within an interval around the values."""
    return " OR ".join(f"({column} >= {a} AND {column} <= {b})" for a, b in intervals(values)) or "false"


def _pages_of(rows: int) -> dict[str, int]:
    """Parquet's settings for pages of so many rows."""
    return {"parquet.page.row.count.limit": rows, "parquet.page.size.row.check.min": min(rows, 100), "parquet.page.size.row.check.max": max(rows, 100)}


def _few(n_lookups: int, page: int, n_stored: int) -> bool:
    return n_lookups <= 4 * INTERVALS and n_lookups * page * 8 < n_stored


class _Files:
    """Small files of the store through Hadoop's file system API."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def write(self, name: str, text: str) -> None:
        """Written under another name first, so that no reader sees a part."""
        draft = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(draft, self.path(name)):
            raise RuntimeError(f"{name} was written by another process")

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, name: str) -> list[str]:
        if not self.fs.exists(self.path(name)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))


class UploadHistory:
    """Accepted uploads under one folder.

    ``records/batch_no=N`` holds the texts of each batch, sorted by id, ``runs``
    the sorted keys of accepted uploads (key, n_words, upload_id, batch_no),
    ``rejected`` the pairs of the others, ``manifest`` the state after each
    batch. ``stage`` writes the records of new batches, ``ingest`` takes one in.
    A store opened again goes on after the last batch its manifest names; what
    an interrupted batch left behind counts for nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, tolerance: float = TOLERANCE, compact_every: int = COMPACT_EVERY, range_rows: int = RANGE_ROWS) -> None:
        self.spark, self.folder, self.range_rows = spark, folder, range_rows
        self.files = _Files(spark, folder)
        mine = {"tolerance": tolerance, "compact_every": compact_every, "bands": BANDS, "shingle": SHINGLE, "word_bits": WORD_BITS, "kinds": KINDS}
        versions = [n for n in self.files.names("manifest") if n.endswith(".json")]
        self.state = json.loads(self.files.read(f"manifest/{versions[-1]}")) if versions else {"keys": mine, "version": 0, "batches": [], "runs": [], "rejected": [], "steps": 0, "taken": 0}
        if self.state["keys"] != mine:
            raise ValueError(f"this store was made with other parameters: {self.state['keys']}")
        self.tolerance, self.compact_every = tolerance, compact_every

    def _commit(self) -> None:
        self.state["version"] += 1
        self.files.write(f"manifest/{self.state['version']:08d}.json", json.dumps(self.state))

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _records(self, batches: list[int]) -> DataFrame:
        """The records of some batches; only their folders are read."""
        paths = [f"{self.folder}/records/batch_no={b}" for b in sorted(set(batches))]
        if not paths:
            return self.spark.createDataFrame([], PREPARED)
        return self.spark.read.schema(f"{RECORDS}, batch_no int").option("basePath", f"{self.folder}/records").parquet(*paths)

    def rejections(self) -> DataFrame:
        """upload_id_a (accepted, the smallest that b repeats) and upload_id_b."""
        schema = "upload_id_a bigint, upload_id_b bigint"
        paths = self.state["rejected"]
        return self.spark.read.schema(schema).csv(paths) if paths else self.spark.createDataFrame([], schema)

    def accepted(self) -> DataFrame:
        """upload_id of all that was accepted."""
        taken = self._records(self.state["batches"]).select("upload_id").distinct()
        return taken.join(self.rejections().select(F.col("upload_id_b").alias("upload_id")), "upload_id", "left_anti")

    def stage(self, uploads: DataFrame, chunks: DataFrame) -> dict[int, int]:
        """Write the records of these uploads under their batches and give the
        number of uploads in each. A batch staged again replaces the former
        staging; one already taken in is refused."""
        sizes = uploads.filter("upload_id is not null").groupBy(F.coalesce("batch_no", F.lit((1 << 31) - 1)).alias("batch_no")).agg(F.count(F.lit(1)).alias("n")).collect()
        if late := sorted({r["batch_no"] for r in sizes} & set(self.state["batches"])):
            raise ValueError(f"already taken in: {late}")
        if not sizes:
            return {}
        parts = 1 + max(r["n"] for r in sizes) // BATCH_ROWS  # a large batch is written by several tasks
        spread = prepare_uploads(uploads, chunks).repartition("batch_no", F.pmod(F.xxhash64("upload_id"), F.lit(parts)))
        out = spread.sortWithinPartitions("batch_no", "upload_id").write.mode("overwrite").partitionBy("batch_no")
        out.option("partitionOverwriteMode", "dynamic").options(**_pages_of(RECORD_PAGE)).parquet(f"{self.folder}/records")
        return {r["batch_no"]: r["n"] for r in sizes}

    def ingest(self, batch_no: int, n_rows: int | None = None) -> None:
        """Take in one staged batch: compare it with history and itself, add the
        keys of what is accepted as a run and record what is rejected. A batch
        that is already in is left alone. An upload that came in an earlier
        batch as well is neither accepted nor rejected again. ``n_rows`` may be
        more than the batch holds."""
        if batch_no in self.state["batches"]:
            return
        here = f"{self.folder}/work/{batch_no}-{uuid.uuid4().hex[:8]}"
        past = [r["path"] for r in self.state["runs"]]
        pending = self._records([batch_no]).select("upload_id", "batch_no", "n_words", "keys", "kinds")
        n_rows = pending.count() if n_rows is None else n_rows
        self.state["taken"] += n_rows
        own_runs: list[dict] = []
        crowd, nameless, turn = CROWD, [], 0
        while n_rows:
            wait, repeats = self._turn(batch_no, pending, past if turn == 0 else [r["path"] for r in own_runs], n_rows, crowd, f"{here}/{turn}", own_runs)
            nameless += [repeats] if repeats else []
            if wait is None:
                break
            pending = pending.join(self._read([wait], "upload_id bigint"), "upload_id", "left_semi").select(*pending.columns)
            pending.write.parquet(f"{here}/{turn}/later")
            pending = self.spark.read.parquet(f"{here}/{turn}/later")
            remaining = pending.count()
            if remaining >= n_rows and turn:
                raise RuntimeError("no progress")
            n_rows, crowd, turn = remaining, crowd * CROWD_GROWTH, turn + 1
        self.state["runs"] += own_runs
        if nameless:
            self._name(batch_no, past + [r["path"] for r in own_runs], nameless, here)
        self.state["batches"].append(batch_no)
        merged = self.compact()
        self._commit()
        for old in [here, *merged]:
            remove(self.spark, old)

    def _met(self, runs: list[str], keys: DataFrame, n_rows: int) -> DataFrame:
        """Pairs with accepted uploads: the window around a key is the stretch
        of the order with the same words and a length that allows a match;
        lengths say nothing where the key is that of a hash. Where the batch has
        few keys the scan skips the pages they don't fall in."""
        entries = self._read(runs, RUN)
        if _few(n_rows * (BANDS + 1), RUN_PAGE, sum(r["rows"] for r in self.state["runs"])):
            entries = entries.filter(_near("key", [r["key"] for r in keys.select("key").distinct().collect()]))
        hint = F.broadcast if n_rows * (BANDS + 1) <= KEY_ROWS else (lambda df: df)
        edits = F.floor(F.greatest("n_words", "n") * self.tolerance + 1e-9)
        met = entries.join(hint(keys.select("key", "n", "b", F.col("kinds").alias("kinds_b"))), "key")
        met = met.filter((F.col("key").bitwiseAND(1) == 1) | (F.abs(F.col("n_words") - F.col("n")) <= edits))
        # hashes match whatever the words
        edits = F.when(F.col("key").bitwiseAND(1) == 1, 1 << 30).otherwise(edits).cast("bigint")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                likely = may_match(_rows_of(batch.column(3)), _rows_of(batch.column(4)), batch.column(5).to_numpy(zero_copy_only=False))
                yield batch.select([0, 1, 2]).filter(pa.array(likely, pa.bool_()))

        return met.select(F.col("upload_id").alias("a"), F.col("batch_no").alias("a_batch"), "b", "kinds", "kinds_b", edits.alias("edits")).mapInArrow(run, CANDIDATES)

    def _turn(self, batch_no: int, pending: DataFrame, runs: list[str], n_rows: int, crowd: int, here: str, own_runs: list[dict]) -> tuple[str | None, str | None]:
        """One comparison of all that is pending; the paths of what must wait and
        of what is rejected but not yet named."""
        keys = pending.select(F.explode("keys").alias("key"), F.col("n_words").alias("n"), F.col("upload_id").alias("b"), "kinds")
        small = n_rows * (BANDS + 1) <= TASK_KEYS
        sorted_keys = keys.coalesce(1) if small else keys.repartition("key")
        inside = sorted_keys.sortWithinPartitions("key", "b").mapInArrow(_neighbours(self.tolerance, crowd, batch_no), CANDIDATES)
        candidates = inside
        if runs:
            candidates = candidates.unionByName(self._met(runs, keys, n_rows))
        if small and sum(r["rows"] for r in self.state["runs"]) <= TASK_ENTRIES:
            candidates = candidates.coalesce(1)
        seen = Observation()
        candidates.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("a").isNull()).alias("waiting"), F.collect_set("a_batch").alias("batches")).write.parquet(f"{here}/candidates")
        rejected: list[tuple[int, int]] | str = []
        known: list[int] | str = []
        undecided: list[int] | str = []
        nameless: list[int] | str = []
        if n_pairs := seen.get["n"]:
            pairs = self._read([f"{here}/candidates"], CANDIDATES)
            waiting = pairs.filter("a is null").select("b").distinct() if seen.get["waiting"] else None
            matched = self._verify(pairs.filter("a is not null"), [*seen.get["batches"], batch_no], n_pairs)
            if n_pairs <= SMALL_ROWS:
                found = [(r["a"], r["a_batch"], r["b"]) for r in matched.collect()]
                held = {r["b"] for r in waiting.collect()} if waiting is not None else set()
                rejected, known, undecided, nameless = settle_batch(found, held, batch_no)
            else:
                matched.write.parquet(f"{here}/matched")
                rejected, known, undecided, nameless = self._settle_widely(self._read([f"{here}/matched"], CANDIDATES), waiting, batch_no, here)
        keep, listed = pending, []
        for out, column in ((rejected, "upload_id_b"), (known, "upload_id"), (undecided, "upload_id"), (nameless, "upload_id")):
            if isinstance(out, str):
                ids = self.spark.read.schema("upload_id_a bigint, upload_id_b bigint").csv(out) if column == "upload_id_b" else self._read([out], "upload_id bigint")
                keep = keep.join(ids.select(F.col(column).alias("upload_id")).distinct(), "upload_id", "left_anti")
            else:
                listed += [x[1] for x in out] if column == "upload_id_b" else out or []
        if len(listed) <= LISTED:
            keep = keep.filter(f"upload_id NOT IN ({', '.join(map(str, listed))})") if listed else keep
        else:
            keep = keep.join(F.broadcast(self.spark.createDataFrame([(x,) for x in listed], "upload_id bigint")), "upload_id", "left_anti")
        own_runs.append(self._write_run(keep.select(F.explode("keys").alias("key"), "n_words", "upload_id", "batch_no", "kinds"), n_rows * (BANDS + 1), 0))
        if isinstance(rejected, str):
            self.state["rejected"].append(rejected)
        elif rejected:
            name = f"rejected/{self.state['steps']:08d}-{uuid.uuid4().hex[:8]}.csv"
            self.files.write(name, "".join(f"{a},{b}\n" for a, b in rejected))
            self.state["rejected"].append(f"{self.folder}/{name}")
        paths = []
        for out, name in ((undecided, "undecided"), (nameless, "nameless")):
            if not isinstance(out, str) and out:
                self.spark.createDataFrame([(x,) for x in out], "upload_id bigint").coalesce(1).write.parquet(f"{here}/{name}")
                out = f"{here}/{name}"
            paths.append(out or None)
        return paths[0], paths[1]

    def _write_run(self, entries: DataFrame, n_rows: int, tier: int) -> dict:
        """Entries in order, in range files of about ``range_rows``."""
        self.state["steps"] += 1
        path = f"{self.folder}/runs/{self.state['steps']:08d}-{uuid.uuid4().hex[:8]}"
        n_files = -(-n_rows // self.range_rows)
        ranged = entries.coalesce(1) if n_files <= 1 else entries.repartitionByRange(n_files, "key", "n_words")
        seen = Observation()
        ranged.sortWithinPartitions("key", "n_words").observe(seen, F.count(F.lit(1)).alias("n")).write.options(**_pages_of(RUN_PAGE)).parquet(path)
        return {"path": path, "tier": tier, "rows": seen.get["n"]}

    def _name(self, batch_no: int, runs: list[str], nameless: list[str], here: str) -> None:
        """The smallest accepted upload each of these repeats. They have seen
        the first upload of a crowded window only, but all that are accepted
        are in the runs by now, and those that share a key are compared."""
        them = self._read(nameless, "upload_id bigint")
        late = self._records([batch_no]).join(them, "upload_id", "left_semi")
        keys = late.select(F.explode("keys").alias("key"), F.col("n_words").alias("n"), F.col("upload_id").alias("b"), "kinds")
        seen = Observation()
        met = self._met(runs, keys, them.count()).filter((F.col("a_batch") != batch_no) | (F.col("a") < F.col("b"))).distinct()
        met.observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set("a_batch").alias("batches")).write.parquet(f"{here}/all_met")
        matched = self._verify(self._read([f"{here}/all_met"], CANDIDATES), [*seen.get["batches"], batch_no], seen.get["n"])
        path = f"{self.folder}/rejected/{self.state['steps']:08d}-{uuid.uuid4().hex[:8]}-named"
        matched.groupBy("b").agg(F.min("a").alias("a")).select(F.col("a").alias("upload_id_a"), F.col("b").alias("upload_id_b")).write.csv(path)
        self.state["rejected"].append(path)

    def _verify(self, pairs: DataFrame, batches: list[int], n_pairs: int) -> DataFrame:
        """The pairs that do match. Of the batches concerned (the one taken
        in comes last) the pages with the texts of these uploads are read, and both of a pair are brought together
        by one shuffle of them."""
        records = self._records(batches).select("upload_id", "batch_no", "digest", "words")
        hint = F.broadcast if n_pairs <= KEY_ROWS else (lambda df: df)
        if _few(n_pairs, RECORD_PAGE, self.state["taken"]):
            records = records.filter(_near("upload_id", [x for r in pairs.select("a", "b").collect() for x in r]))
        ends = pairs.select("a", "a_batch", "b", F.explode(F.array(F.struct(F.col("a").alias("upload_id"), F.col("a_batch").alias("batch_no"), F.lit(0).alias("side")), F.struct(F.col("b").alias("upload_id"), F.lit(batches[-1]).alias("batch_no"), F.lit(1).alias("side")))).alias("end"))
        joined = records.join(hint(ends.select("a", "a_batch", "b", "end.*")), ["upload_id", "batch_no"])
        tolerance = self.tolerance

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = None
            for batch in batches:
                keep = []
                for a, a_batch, b, digest, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    if half is None or half[:3] != (a, a_batch, b):
                        half = (a, a_batch, b, digest, data)
                        continue
                    if half[3] and half[3] == digest:
                        keep.append((a, a_batch, b))
                    else:
                        x, y = np.frombuffer(half[4], np.uint32), np.frombuffer(data, np.uint32)
                        if x.size and y.size and within(x, y, int(max(x.size, y.size) * tolerance + 1e-9)):
                            keep.append((a, a_batch, b))
                    half = None
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in keep], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["a", "a_batch", "b"])

        joined = joined.select("a", "a_batch", "b", "digest", "words", "side")
        together = joined.coalesce(1) if n_pairs <= TASK_PAIRS else joined.repartition("a", "b")
        return together.sortWithinPartitions("a", "a_batch", "b", "side").select("a", "a_batch", "b", "digest", "words").mapInArrow(run, CANDIDATES)

    def _settle_widely(self, matched: DataFrame, waiting: DataFrame | None, batch_no: int, here: str) -> tuple[str, str | None, str | None, str | None]:
        """``settle_batch`` by joins: what history has is settled at once; of the
        rest again and again those are struck whose least match not yet struck
        is accepted, as it matches nothing open and doesn't wait."""
        old = matched.filter(F.col("a_batch") != batch_no)
        old.filter("a = b").select(F.col("b").alias("upload_id")).distinct().write.parquet(f"{here}/known")
        known = self._read([f"{here}/known"], "upload_id bigint")
        old.join(known.select(F.col("upload_id").alias("b")), "b", "left_anti").groupBy("b").agg(F.min("a").alias("a")).select("a", "b").write.parquet(f"{here}/from_history")
        decided = self._read([f"{here}/from_history"], PAIRS)
        gone = decided.select("b").unionByName(known.select(F.col("upload_id").alias("b"))).distinct()
        waiting = (waiting if waiting is not None else matched.select("b").limit(0)).distinct().join(gone, "b", "left_anti")
        pairs = matched.filter(F.col("a_batch") == batch_no).select("a", "b").join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b")
        verdicts, turn = [], 0
        while True:
            pairs.write.parquet(path := f"{here}/open{turn}")
            pairs = self._read([path], PAIRS)
            least = pairs.groupBy("b").agg(F.min("a").alias("a"))
            sure = least.join(pairs.select(F.col("b").alias("a")), "a", "left_anti").join(waiting.select(F.col("b").alias("a")), "a", "left_anti")
            sure.select("a", "b").write.parquet(path := f"{here}/struck{turn}")
            struck = self._read([path], PAIRS)
            if struck.isEmpty():
                break
            verdicts.append(path)
            off = struck.select("b")
            pairs = pairs.join(off, "b", "left_anti").join(off.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b")
            turn += 1
        struck = self._read(verdicts, PAIRS)
        path = f"{self.folder}/rejected/{self.state['steps']:08d}-{uuid.uuid4().hex[:8]}-wide"
        decided.unionByName(struck.join(waiting, "b", "left_anti").select("a", "b")).select(F.col("a").alias("upload_id_a"), F.col("b").alias("upload_id_b")).write.csv(path)
        struck.join(waiting, "b", "left_semi").select(F.col("b").alias("upload_id")).write.parquet(f"{here}/nameless")
        left = pairs.select("b").unionByName(waiting).distinct().join(struck.select("b"), "b", "left_anti")
        left.select(F.col("b").alias("upload_id")).write.parquet(f"{here}/undecided")
        rest = [None if self._read([p], "upload_id bigint").isEmpty() else p for p in (f"{here}/known", f"{here}/undecided", f"{here}/nameless")]
        return path, rest[0], rest[1], rest[2]

    def compact(self) -> list[str]:
        """Merge the runs of a tier that is full into one of the next tier, in
        order of its key ranges; the paths that no longer count. An entry is
        thus written again once per tier, not once per batch."""
        merged: list[str] = []
        tier = 0
        while any(r["tier"] >= tier for r in self.state["runs"]):
            own = [r for r in self.state["runs"] if r["tier"] == tier]
            if len(own) >= self.compact_every:
                whole = self._write_run(self._read([r["path"] for r in own], RUN), sum(r["rows"] for r in own), tier + 1)
                self.state["runs"] = [r for r in self.state["runs"] if r["tier"] != tier] + [whole]
                merged += [r["path"] for r in own]
            tier += 1
        return merged


def settle_batch(matches: list[tuple[int, int, int]], waiting: set[int], batch_no: int) -> tuple[list[tuple[int, int]], list[int], list[int], list[int]]:
    """(a, b) of the rejected, those known from an earlier batch, those
    undecided and those rejected but not yet named, from the pairs that match
    (a, the batch of a, b). What is in history is accepted: its matches are
    settled at once, under the smallest id. The others are settled within the
    batch; those rejected there while they wait aren't named yet."""
    first: dict[int, int] = {}
    known = {b for a, batch, b in matches if a == b and batch != batch_no}
    for a, batch, b in matches:
        if batch != batch_no and b not in known:
            first[b] = min(a, first.get(b, a))
    gone = known | set(first)
    inside = [(a, b) for a, batch, b in matches if batch == batch_no and a not in gone and b not in gone]
    repeats, undecided = settle(inside, waiting - gone)
    named = [(a, b) for b, a in first.items()] + [(a, b) for a, b in repeats if b not in waiting]
    return sorted(named), sorted(known), undecided, sorted(b for _, b in repeats if b in waiting)


def _neighbours(tolerance: float, crowd: int, batch_no: int):
    """Pairs within the windows of one batch, from its keys in order (key, n, b,
    kinds): equal key, a length and counts that allow a match. Where an upload of
    a key has more than ``crowd`` of these its first upload alone is paired with
    the others, and these come once more with a null: they have to wait. Equal
    pairs come more than once."""
    at_once, held = 100_000, max(HELD, crowd + 2)

    def pairs(key: int, members: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int | None, int]]]:
        if key & 1:  # of a hash: all are copies
            numbers = [b for _, b, _ in members]
            if len(numbers) <= crowd:
                yield [(min(a, b), max(a, b)) for k, b in enumerate(numbers) for a in numbers[:k]]
            else:
                yield [p for b in numbers[1:] for p in ((numbers[0], b), (None, b))]
            return
        by_length = sorted(members)
        lengths, kinds = [n for n, _, _ in by_length], np.frombuffer(b"".join(c for _, _, c in by_length), np.uint8).reshape(-1, KINDS // 2)
        out, begin = [], 0
        for k, (n, b, _) in enumerate(by_length):
            edits = int(n * tolerance + 1e-9)
            while n - lengths[begin] > edits:
                begin += 1
            likely = np.flatnonzero(may_match(kinds[begin:k], kinds[k], edits)) + begin if begin < k else ()
            if len(likely) > crowd:
                first = members[0][1]
                yield [p for _, b, _ in members[1:] for p in ((first, b), (None, b))]
                return
            out.append([(min(a, b), max(a, b)) for a in (by_length[i][1] for i in likely)])
        yield from out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, spilled = None, [], False

        def batch_of(out: list[tuple[int | None, int]]) -> pa.RecordBatch:
            a, b = (pa.array([p[k] for p in out], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([a, pa.array([batch_no] * len(out), pa.int32()), b], names=["a", "a_batch", "b"])

        for batch in batches:
            out: list[tuple[int | None, int]] = []
            for now, n, b, kinds in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if now != key:
                    if len(members) > 1 and not spilled:
                        for more in pairs(key, members):
                            out += more
                            if len(out) >= at_once:
                                yield batch_of(out)
                                out = []
                    key, members, spilled = now, [], False
                if len(members) < held:
                    members.append((n, b, kinds))
                    continue
                if not spilled:  # too many to hold: crowded by any measure
                    out += [p for _, c, _ in members[1:] for p in ((members[0][1], c), (None, c))]
                    spilled = True
                out += ((members[0][1], b), (None, b))
            yield batch_of(out)
        if len(members) > 1 and not spilled:
            out = []
            for more in pairs(key, members):
                out += more
                if len(out) >= at_once:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    return run


def settle(matches: list[tuple[int, int]], waiting: set[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(a, b) of the rejected, and those undecided, from the pairs that match
    and the uploads that wait for more comparisons. An a that is never a b and
    doesn't wait is accepted, be it now or in an earlier batch."""
    by_b: dict[int, list[int]] = {}
    for a, b in matches:
        by_b.setdefault(b, []).append(a)
    rejected: dict[int, int] = {}
    undecided: set[int] = set()
    for b in sorted(set(by_b) | waiting):
        found = [a for a in by_b.get(b, []) if a not in rejected]
        sure = [a for a in found if a not in undecided]
        if sure and min(sure) == min(found):
            rejected[b] = min(sure)
        elif b in waiting or found:
            undecided.add(b)
    return [(a, b) for b, a in rejected.items()], sorted(undecided)


def replay_batches(uploads: DataFrame, chunks: DataFrame, folder: str | None = None) -> UploadHistory:
    """All batches of ``uploads`` in order through the store in ``folder``, by
    default a new one.

    Null and odd hashes match by what they name; uploads without words match by
    hash only; empty tables give an empty history.
    """
    spark = uploads.sparkSession
    history = UploadHistory(spark, folder or scratch_dir(spark))
    sizes = history.stage(uploads, chunks)
    for batch_no in sorted(sizes):
        history.ingest(batch_no, sizes[batch_no])
    return history
