"""The collection the reference queries run on: orders with their line items.

The main table is orders with their customer, the child tables are line items
and their parts. Provenance is made from keys, alike in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.model import Column
from tessera.operators.filters import Collection
from tessera.session import read_table


def _hint(role: str) -> dict:
    return {"role": role}


COLUMNS = [
    Column("Customer Name", "text", hint=_hint("company")),
    Column("Status", "text", hint=_hint("status")),
    Column("Total", "currency", hint=_hint("money")),
    Column("Order Date", "date", hint=_hint("date")),
    Column("Priority", "text"),
    Column("Segment", "text"),
    Column("Urgent", "boolean"),
    Column("Line Items", "entity_array", has_entity=True, children=[
        Column("Quantity", "number"), Column("Amount", "currency"), Column("Discount", "number"), Column("Tax", "number"),
        Column("Return Flag", "text"), Column("Ship Date", "date"), Column("Line Number", "number"),
    ]),
    Column("Parts", "entity_array", has_entity=True, children=[Column("Part Name", "text"), Column("Brand", "text"), Column("Size", "number")]),
]

#: The same tables as common table expressions.
SQL = """
    orders_main AS (
        SELECT o_orderkey AS _row_id, CAST(o_orderkey AS VARCHAR) AS _document_id, c_name AS customer_name,
               nullif(o_orderstatus, 'P') AS status, CAST(o_totalprice AS DOUBLE) AS total,
               strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS order_date, o_orderpriority AS priority,
               c_mktsegment AS segment, o_orderpriority = '1-URGENT' AS urgent
        FROM orders JOIN customer ON o_custkey = c_custkey),
    line_items AS (
        SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS _row_id,
               l_orderkey AS _parent_row_id, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS amount,
               CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax, l_returnflag AS return_flag,
               strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS ship_date, CAST(l_linenumber AS DOUBLE) AS line_number, l_partkey AS _partkey
        FROM lineitem),
    parts AS (
        SELECT i._row_id, i._parent_row_id, p_name AS part_name, p_brand AS brand, CAST(p_size AS DOUBLE) AS size
        FROM line_items i JOIN part ON i._partkey = p_partkey)
"""


def line_items(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Line items by order. Row ids, where wanted, number all rows in one
    order: a range sort, then offsets per partition of it."""
    rows = read_table(spark, sf_dir, "lineitem")
    out = rows.select(
        F.col("l_orderkey").alias("_parent_row_id"),
        *[F.col(a).cast("double").alias(b) for a, b in (("l_quantity", "quantity"), ("l_extendedprice", "amount"), ("l_discount", "discount"), ("l_tax", "tax"))],
        F.col("l_returnflag").alias("return_flag"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"),
        F.col("l_linenumber").cast("double").alias("line_number"),
        F.col("l_partkey").alias("_partkey"),
        *([] if not numbered else [F.col(c).alias(f"_k{k}") for k, c in enumerate(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))]),
    )
    if not numbered:
        return out
    keys = [f"_k{k}" for k in range(11)]
    # number within each order's rows, then add the rows of all orders before it
    counts = out.groupBy("_parent_row_id").agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor(F.col("_parent_row_id") / 4096).alias("_block")
    per_block = counts.groupBy(block).agg(F.sum("_n").alias("_bn"))
    starts = per_block.select("_block", F.coalesce(F.sum("_bn").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_bstart"))
    inside = Window.partitionBy("_block").orderBy("_parent_row_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_block", block).join(starts, "_block").select("_parent_row_id", (F.col("_bstart") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_before"))
    order = Window.partitionBy("_parent_row_id").orderBy(*keys)
    return out.withColumn("_r", F.row_number().over(order)).join(offsets, "_parent_row_id").withColumn("_row_id", F.col("_before") + F.col("_r")).drop("_r", "_before", *keys)


def orders_collection(spark: SparkSession, sf_dir: str, numbered: bool = False) -> Collection:
    orders, customer = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    main = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("_row_id"), F.col("o_orderkey").cast("string").alias("_document_id"), F.col("c_name").alias("customer_name"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_totalprice").cast("double").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    items = line_items(spark, sf_dir, numbered)
    part = read_table(spark, sf_dir, "part")
    keys = ["_row_id"] if numbered else []
    parts = items.join(part, F.col("_partkey") == F.col("p_partkey")).select(*keys, "_parent_row_id", F.col("p_name").alias("part_name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("size"))
    return Collection(COLUMNS, main, {"Line Items": items, "Parts": parts})


def with_provenance(main: DataFrame) -> DataFrame:
    """Made-up provenance: a row's total is low where its key divides by 7,
    medium where by 3, else high; its status is always high."""
    level = F.when(F.col("_row_id") % 7 == 0, "low").when(F.col("_row_id") % 3 == 0, "medium").otherwise("high")
    conf = F.to_json(F.create_map(F.lit("total"), level, F.lit("status"), F.lit("high")))
    proof = F.to_json(F.create_map(F.lit("total"), F.struct(level.alias("level"), (F.col("_row_id") % 5 + 1).cast("int").alias("page"), F.concat(F.lit("order "), F.col("_row_id").cast("string")).alias("rawSource"))))
    return main.select("_row_id", "_document_id", conf.alias("_confidence_json"), proof.alias("_evidence_json"), "customer_name", "status", "total")
