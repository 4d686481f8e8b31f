"""Queries of the general problems on semi-structured data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators.drift import consistent_table, schema_changes
from tessera.operators.nested import columns_table, link_parents, schema_tables, shred_responses, values_table
from tessera.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _nodes(spark: SparkSession, sf_dir: str, with_fields: bool = False) -> DataFrame:
    return link_parents(shred_responses(read_table(spark, sf_dir, "model_responses"), read_table(spark, sf_dir, "collections"), with_fields))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("response_id", "node_kind", "node_path", "parent_path")


def p1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of columns, each with its place and its parent's."""
    return columns_table(_nodes(spark, sf_dir, with_fields=True)).select("response_id", "schema_path", _label("dewey"), _label("parent_dewey"), "node_path", "parent_path", "name", "type", "description", "required", "example")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables of records, one below the other: the table, the place, the parent's place and the fields."""
    records = _nodes(spark, sf_dir, with_fields=True).filter("node_kind = 'record'")
    return records.select("response_id", "schema_path", _label("dewey"), _label("parent_dewey"), "node_path", "parent_path", F.to_json("fields").alias("fields"))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_table(_nodes(spark, sf_dir, with_fields=True)).select("response_id", "schema_path", "node_path", "field", "value")


def _label(name: str) -> Column:
    return F.array_join(F.col(name).cast("array<string>"), ".").alias(name)


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_tables(_nodes(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = schema_changes(read_table(spark, sf_dir, "collections"))
    return changes.select("collection_id", "schema_version", "change_kind", "old_path", "new_path")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_table(read_table(spark, sf_dir, "model_responses"), read_table(spark, sf_dir, "collections"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_tables, p1_columns, p1_records, p1_values, p4_found, p4_table)}


def oracle_sql() -> dict[str, str]:
    """Recursive JSON of any shape is beyond plain SQL; see the tests."""
    return {}
