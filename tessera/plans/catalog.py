"""Collections on storage: versioned manifests, data tables, edits, cache.

A collection's state is a chain of manifests ``v000001.json``, ``v000002.json``
…; a writer makes the next one exclusively, and one that comes second reads
again and replays, up to three times. Data tables are Parquet folders that are
only ever appended to; edits are rows of an overlay, the last one wins.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tessera.errors import CollectionNotFound, RowNotFound, SchemaConflict, ValidationError
from tessera.functions.values import sanitize_name, sanitized, table_name
from tessera.model import Column, parse_columns
from tessera.operators.filters import Collection, coerced
from tessera.session import materialise, once, remove, scratch_dir

#: Times a schema change is replayed on the newer version.
ATTEMPTS = 3
#: Answers the cache keeps, and for how long in seconds.
CACHE_ROWS, CACHE_SECONDS = 500, 6 * 3600
#: Edits of a table that are merged into one folder when so many have gathered.
EDITS_MERGED = 16
#: Blocks of documents in which row ids are counted.
ID_BLOCKS = 4096
#: Characters of a document's text that are stored.
RAW_CHARS = 5000
_TYPES = {"number": DoubleType(), "currency": DoubleType(), "boolean": BooleanType()}


@dataclass
class Manifest:
    collection_id: str
    name: str
    columns: list[dict]
    version: int = 1
    documents: int = 0
    rows: int = 0
    dropped: bool = False
    tables: dict[str, list[str]] = field(default_factory=dict)

    def schema(self) -> list[Column]:
        return parse_columns(self.columns)


def column_json(column: Column) -> dict:
    out = {"name": column.name, "type": column.type, "description": column.description, "required": column.required}
    if column.hint:
        out["queryHint"] = column.hint
    if column.has_entity:
        out["entitySchema"] = {"name": sanitized(column.name), "columns": [column_json(c) for c in column.children]}
    return out


def table_schema(columns: list[Column], child: bool) -> StructType:
    """Bookkeeping, then a physical column per scalar column of the schema."""
    fixed = [("_row_id", LongType()), ("_document_id", StringType()), ("_confidence", StringType()), ("_importance", StringType()), ("_confidence_json", StringType()), ("_evidence_json", StringType())]
    if child:
        fixed.insert(1, ("_parent_row_id", LongType()))
    names = [sanitized(c.name) for c in columns if c.type != "entity_array"]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValidationError(f"Columns share a physical name: {', '.join(sorted(twice))}")
    return StructType([StructField(n, t) for n, t in fixed] + [StructField(sanitized(c.name), _TYPES.get(c.type, StringType())) for c in columns if c.type != "entity_array"])


def all_tables(collection_id: str, columns: list[Column], at: str = "") -> dict[str, tuple[list[Column], str | None]]:
    """Physical tables of a schema: name -> (columns, entity path); nested
    entities have tables at any depth."""
    out = {table_name(collection_id): (columns, None)} if not at else {}
    for c in columns:
        if c.type == "entity_array":
            path = f"{at}/{c.name}" if at else c.name
            out[table_name(collection_id, path.replace("/", "_"))] = (c.children, path)
            out |= all_tables(collection_id, c.children, path)
    return out


def merge_columns(known: list[Column], proposed: list[Column]) -> tuple[list[Column], list[str]]:
    """Columns only added, by name without regard to case, and a warning that
    says how many. A proposed entity column without columns of its own is
    turned away."""
    names = {c.name.lower() for c in known}
    added, warnings = [], []
    for c in proposed:
        if c.name.lower() in names:
            continue
        if c.type == "entity_array" and not c.children:
            warnings.append(f"Column {c.name} holds entries but names no columns; left out")
            continue
        names.add(c.name.lower())
        added.append(c)
    if added:
        warnings.append(f"Schema evolved: {len(added)} new column(s) detected")
    return known + added, warnings


def collection_name(filename: str | None, document_type: str) -> str:
    base = (filename or "document").rsplit(".", 1)[0].replace("_", " ").replace("-", " ")
    kind = document_type.replace("_", " ")
    return base if kind.lower() in base.lower() else f"{kind} — {base}"


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _folder(self, collection_id: str) -> str:
        return f"{self.root}/{table_name(collection_id)}"

    def _write(self, manifest: Manifest) -> None:
        """Exclusive: fails if this version is there already."""
        fs, path = self._fs(f"{self._folder(manifest.collection_id)}/manifest/v{manifest.version:06d}.json")
        if fs.exists(path):
            raise FileExistsError(path.toString())
        try:
            out = fs.create(path, False)
        except Exception as error:
            raise FileExistsError(path.toString()) from error
        out.write(json.dumps(asdict(manifest), ensure_ascii=False).encode())
        out.close()

    def read(self, collection_id: str) -> Manifest:
        fs, path = self._fs(f"{self._folder(collection_id)}/manifest")
        files = sorted(s.getPath().toString() for s in fs.listStatus(path)) if fs.exists(path) else []
        files = [f for f in files if f.endswith(".json")]
        if not files:
            raise CollectionNotFound(f"No collection {collection_id}")
        text = "\n".join(r[0] for r in self.spark.read.text(files[-1], wholetext=True).collect())
        manifest = Manifest(**json.loads(text))
        if manifest.dropped:
            raise CollectionNotFound(f"No collection {collection_id}")
        return manifest

    def create(self, collection_id: str, name: str, columns: list[Column]) -> Manifest:
        for own, path in all_tables(collection_id, columns).values():
            table_schema(own, path is not None)
        manifest = Manifest(collection_id, name, [column_json(c) for c in columns])
        try:
            self._write(manifest)
        except FileExistsError:
            raise SchemaConflict(f"Collection {collection_id} exists") from None
        return manifest

    def update(self, collection_id: str, change: Callable[[Manifest], None]) -> Manifest:
        """Compare and swap: ``change`` is replayed on the newest manifest."""
        for _ in range(ATTEMPTS):
            manifest = self.read(collection_id)
            change(manifest)
            manifest.version += 1
            try:
                self._write(manifest)
                return manifest
            except FileExistsError:
                continue
        raise SchemaConflict(f"Collection {collection_id} kept changing")

    def evolve(self, collection_id: str, proposed: list[Column]) -> tuple[Manifest, list[str]]:
        said: list[str] = []

        def change(m: Manifest) -> None:
            merged, warnings = merge_columns(m.schema(), proposed)
            m.columns = [column_json(c) for c in merged]
            said[:] = warnings

        return self.update(collection_id, change), said

    def table(self, collection_id: str, name: str | None = None) -> DataFrame:
        """One data table under the current schema, edits applied. A table never
        written is empty; a name that isn't this collection's is an error."""
        manifest = self.read(collection_id)
        tables = all_tables(collection_id, manifest.schema())
        name = name or table_name(collection_id)
        if name not in tables:
            raise ValidationError(f"Unknown table: {name}")
        columns, path = tables[name]
        schema = table_schema(columns, path is not None)
        paths = manifest.tables.get(name, [])
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        rows = rows.withColumn("_evidence_json", F.coalesce("_evidence_json", F.lit("{}")))
        edits = manifest.tables.get(f"{name}#edits", [])
        return self._edited(rows, edits) if edits else rows

    def _edited(self, rows: DataFrame, paths: list[str]) -> DataFrame:
        edits = self.spark.read.parquet(*paths)
        last = edits.groupBy("row_id", "column_name").agg(F.max_by("value", "edit_no").alias("value"))
        wide = last.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "value"))).alias("_edit"))
        joined = rows.join(wide, rows["_row_id"] == wide["row_id"], "left")
        kinds = dict(rows.dtypes)
        return joined.select(*[
            F.col(c) if c.startswith("_") else F.when(F.coalesce(F.map_contains_key("_edit", F.lit(c)), F.lit(False)), F.try_element_at("_edit", F.lit(c)).cast(kinds[c])).otherwise(F.col(c)).alias(c)
            for c in rows.columns
        ])

    def collection(self, collection_id: str) -> Collection:
        manifest = self.read(collection_id)
        children = {path: self.table(collection_id, name) for name, (_, path) in all_tables(collection_id, manifest.schema()).items() if path and "/" not in path}
        return Collection(manifest.schema(), self.table(collection_id), children)

    def data_tables(self, collection_id: str) -> dict[str, DataFrame]:
        """All data tables by name, children of every depth among them, as the
        SQL gateway takes them."""
        return {name: self.table(collection_id, name) for name in all_tables(collection_id, self.read(collection_id).schema())}

    def append(self, collection_id: str, cells: DataFrame, confidence: DataFrame | None = None) -> int:
        """Insert verified cells (document_id, row_ordinal, row_path,
        column_name, value_text/num/bool and, where known, level, score, page,
        chunk, note, raw_source) as rows of the data tables, parents before
        children, with contiguous row ids; the number of rows inserted. A
        document's level comes from ``confidence`` (document_id, confidence)."""
        manifest = self.read(collection_id)
        for name, kind in (("level", "string"), ("score", "double"), ("page", "int"), ("chunk", "int"), ("note", "string"), ("raw_source", "string")):
            if name not in cells.columns:
                cells = cells.withColumn(name, F.lit(None).cast(kind))
        steps = F.split("row_path", "/")
        places = cells.withColumns({
            "_entity": F.coalesce(F.array_join(F.filter(steps, lambda x, k: k % 2 == 0), "/"), F.lit("")),
            "_path": F.coalesce("row_path", F.lit("")),
        })
        # all tables are made of these: what it takes to verify them is done once
        places = materialise(places, f"{scratch_dir(self.spark)}/cells")
        total, new = 0, {}
        levels: dict[str, DataFrame] = {}
        for name, (columns, path) in all_tables(collection_id, manifest.schema()).items():
            own = places.filter(F.col("_entity") == (path or ""))
            rows = self._rows(own, columns, levels.get(path.rpartition("/")[0] if path else ""), path, self._next_id(manifest, name), confidence)
            target = f"{self._folder(collection_id)}/{name}/v{manifest.version + 1:06d}-{manifest.rows:012d}"
            rows.write.mode("overwrite").parquet(target)
            stored = self.spark.read.schema(rows.schema).parquet(target)
            levels[path or ""] = stored.select(F.col("_document_id").alias("document_id"), "_ordinal", "_path", "_row_id")
            new[name] = target
            total += stored.count()
        n_documents = places.select("document_id").distinct().count()

        def change(m: Manifest) -> None:
            for name, target in new.items():
                m.tables.setdefault(name, []).append(target)
            m.rows += total
            m.documents += n_documents

        self.update(collection_id, change)
        return total

    def _next_id(self, manifest: Manifest, name: str) -> int:
        paths = manifest.tables.get(name, [])
        return (self.spark.read.parquet(*paths).agg(F.max("_row_id")).first()[0] or 0) if paths else 0

    def _rows(self, cells: DataFrame, columns: list[Column], parents: DataFrame | None, path: str | None, last_id: int, confidence: DataFrame | None) -> DataFrame:
        keys = ["document_id", "row_ordinal", "_path"]
        level = F.coalesce("level", F.lit("low"))
        proof = F.struct(level.alias("level"), "score", "page", "chunk", "note", F.col("raw_source").alias("rawSource"))
        scalars = [c for c in columns if c.type != "entity_array"]
        # by exact name, else by physical name
        cells = cells.withColumn("_physical", sanitize_name(F.col("column_name")))
        pick = lambda c, v: F.coalesce(F.max(F.when(F.col("column_name") == c.name, F.col(v))), F.max(F.when(F.col("_physical") == sanitized(c.name), F.col(v))))
        value = {"number": "value_num", "currency": "value_num", "boolean": "value_bool"}
        wide = cells.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct(F.col("_physical").alias("column_name"), level.alias("level"), proof.alias("proof")))).alias("_all"),
            *[pick(c, value.get(c.type, "value_text")).alias(sanitized(c.name)) for c in scalars],
        )
        if confidence is not None:
            wide = wide.join(confidence.select("document_id", F.col("confidence").alias("_confidence")), "document_id", "left")
        else:
            wide = wide.withColumn("_confidence", F.lit(None).cast("string"))
        # contiguous ids: numbers within a document, after those of the documents before it
        within = Window.partitionBy("document_id").orderBy("row_ordinal", "_path")
        # found by blocks of documents, so that no task sees all of them
        counts = wide.groupBy("document_id").count().withColumn("_block", F.pmod(F.xxhash64("document_id"), F.lit(ID_BLOCKS)))
        before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = counts.groupBy("_block").agg(F.sum("count").alias("_in_block")).select("_block", F.coalesce(F.sum("_in_block").over(before), F.lit(0)).alias("_base"))
        inside = Window.partitionBy("_block").orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.join(blocks, "_block").select("document_id", (F.col("_base") + F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("_start"))
        numbered = wide.withColumn("_n", F.row_number().over(within)).join(starts, "document_id")
        out = numbered.withColumn("_row_id", F.col("_start") + F.col("_n") + last_id)
        every = F.transform("_all", lambda c: c["column_name"])
        out = out.withColumn("_all", F.filter("_all", lambda c, k: F.array_position(every, c["column_name"]) == k + 1))
        names = F.transform("_all", lambda c: c["column_name"])
        link = []
        if path:
            steps = F.split("_path", "/")
            out = out.withColumn("_up", F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 2), "/"))
            up = parents.select(F.col("document_id").alias("_d"), F.col("_ordinal").alias("_o"), F.col("_path").alias("_p"), F.col("_row_id").alias("_parent_row_id"))
            out = out.join(up, (F.col("document_id") == F.col("_d")) & (F.col("row_ordinal") == F.col("_o")) & (F.col("_up") == F.col("_p")))
            link = ["_parent_row_id"]
        return out.select(
            "_row_id", *link, F.col("document_id").alias("_document_id"), "_confidence", F.lit("high").alias("_importance"),
            F.to_json(F.map_from_arrays(names, F.transform("_all", lambda c: c["level"]))).alias("_confidence_json"),
            F.to_json(F.map_from_arrays(names, F.transform("_all", lambda c: c["proof"]))).alias("_evidence_json"),
            *[sanitized(c.name) for c in scalars],
            F.col("row_ordinal").alias("_ordinal"), "_path",
        )

    def update_cell(self, collection_id: str, row_id: int, column: str, value: object) -> None:
        """Change one value of the main table; its provenance stays."""
        target = self.collection(collection_id).resolve(column)
        bound = None if value is None else coerced(value, target.type, "eq")
        main = table_name(collection_id)
        if self.table(collection_id).filter(F.col("_row_id") == row_id).isEmpty():
            raise RowNotFound(f"No row {row_id}")

        def change(m: Manifest) -> None:
            path = f"{self._folder(collection_id)}/{main}-edits/v{m.version + 1:06d}"
            text = None if bound is None else str(bound).lower() if isinstance(bound, bool) else str(bound)
            edit = self.spark.createDataFrame([(row_id, sanitized(target.name), text, m.version + 1)], "row_id bigint, column_name string, value string, edit_no bigint")
            edit.coalesce(1).write.mode("overwrite").parquet(path)
            paths = [*m.tables.get(f"{main}#edits", []), path]
            if len(paths) >= EDITS_MERGED:  # the last value of each cell, in one folder
                last = self.spark.read.parquet(*paths).groupBy("row_id", "column_name").agg(F.max_by("value", "edit_no").alias("value"), F.max("edit_no").alias("edit_no"))
                last.write.mode("overwrite").parquet(f"{path}-merged")
                paths = [f"{path}-merged"]
            m.tables[f"{main}#edits"] = paths

        self.update(collection_id, change)

    def drop(self, collection_id: str) -> str:
        """Mark the collection dropped and delete its tables at every depth."""

        def change(m: Manifest) -> None:
            m.dropped = True

        manifest = self.update(collection_id, change)
        for paths in manifest.tables.values():
            for path in paths:
                remove(self.spark, path)
        return manifest.name


def document_records(files: DataFrame) -> DataFrame:
    """Stored documents: the text cut to its first characters, none for images."""
    text = F.substring(F.array_join("pages", "\n\n"), 1, RAW_CHARS)
    return files.withColumn("raw_text", F.when(F.col("is_image"), "").otherwise(text))


def cache_key(content_hash, schema_json=None):
    """Key of an extraction: the content, and the schema it was matched to."""
    return content_hash if schema_json is None else F.sha2(F.concat(content_hash, F.lit("\u0000"), schema_json), 256)


def cache_misses(requests: DataFrame, cache: DataFrame, now, seconds: int = CACHE_SECONDS) -> DataFrame:
    """Requests (key, …) without a fresh answer in the cache (key, cached_at), one per key."""
    fresh = cache.filter(F.col("cached_at") > now - F.make_dt_interval(secs=F.lit(float(seconds)))).select("key")
    return requests.join(fresh, "key", "left_anti").dropDuplicates(["key"])


def trimmed_cache(cache: DataFrame, rows: int = CACHE_ROWS) -> DataFrame:
    """The newest answer of each key, the newest ``rows`` of them."""
    newest = cache.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cached_at")))).filter("_n = 1").drop("_n")
    return newest.orderBy(F.desc("cached_at")).limit(rows)


def list_collections(collections: DataFrame) -> DataFrame:
    """Each collection by its newest version, the last changed first:
    collection_id, version, name, updated_at, place."""
    newest = collections.groupBy("collection_id").agg(F.max("schema_version").alias("version"), F.max_by("name", "schema_version").alias("name"), F.max("updated_at").alias("updated_at"))
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.col("updated_at").desc_nulls_last(), "collection_id")))


def list_documents(uploads: DataFrame) -> DataFrame:
    """The documents of each collection, the newest first."""
    rows = once(uploads.select("collection_id", "upload_id", "filename", "file_format", "row_count", "confidence", "created_at"), "upload_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("collection_id").orderBy(F.col("created_at").desc_nulls_last(), "upload_id")))


def health(spark: SparkSession) -> dict:
    try:
        return {"status": "up" if spark.range(1).count() == 1 else "down"}
    except AnalysisException:
        return {"status": "down"}
