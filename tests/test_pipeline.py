import json

from tessera.model import Column, parse_columns
from tessera.operators.filters import Condition, FilterRequest
from tessera.operators.mapping import response_analysis
from tessera.operators.verify import total_columns
from tessera.plans.catalog import Catalog
from tessera.plans.pipeline import add_documents, answer_request, create_collection

BODY = {
    "document_type": "tax_invoice", "document_type_info": {"name": " ", "category": "finance"}, "document_analysis": {"purpose": "Billing", "detected_sections": ["a", None, 2]}, "warnings": ["w"],
    "schema": {"columns": [{"name": "Vendor", "type": "text"}, {"name": "Total", "type": "currency"}, {"name": "Line Items", "type": "entity_array", "entitySchema": {"columns": [{"name": "Description"}, {"name": "Amount", "type": "currency"}]}}]},
    "rows": [{"Vendor": {"value": "Acme Corp", "chunk": 1, "page": 1, "confidence": "high", "raw_source": "Vendor Acme Corp"}, "Total": {"value": 999.0, "chunk": 1, "page": 1, "confidence": "high"}, "Line Items": [{"Description": "Widget", "Amount": 5}]}],
}


def test_from_responses_to_answers(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    create_collection(cat, "c", "Invoices", json.dumps(BODY))
    responses = spark.createDataFrame([(1, "d1", json.dumps(BODY)), (2, "d2", json.dumps(BODY | {"rows": []})), (3, "d3", None)], "response_id bigint, document_id string, response_json string")
    chunks = spark.createDataFrame([("d1", 1, 1, "Vendor Acme Corp, Widget 5")], "document_id string, chunk_index int, page int, text string")
    assert add_documents(cat, "c", responses, chunks, proposed=[Column("Tax", "currency")]) == 2
    collection = cat.collection("c")
    got = answer_request(collection, FilterRequest([Condition("Vendor", "contains", "acme")]))
    row = got.rows.first()
    assert (row.vendor.value, row.vendor.confidence, row.total.confidence, row.tax.value) == ("Acme Corp", "high", "low", None)
    assert got.total == 1 and got.headline == "1 result" and got.kind == "single_value"
    entries = answer_request(collection, FilterRequest([Condition("Amount", "eq", 5, "Line Items")]))
    assert entries.headline == "Found 1 Line Items entry" and entries.rows.first().parent.value == "Acme Corp"
    none = answer_request(collection, FilterRequest([Condition("Vendor", "eq", "nobody")], exclude_low=True))
    assert none.headline == "No matching results" and none.total == 0


def test_analysis(spark):
    responses = spark.createDataFrame([(1, json.dumps(BODY)), (1, json.dumps(BODY)), (2, "{"), (3, "{}x")], "response_id bigint, response_json string")
    (row,) = response_analysis(responses).collect()
    assert (row.document_type, row.category, row.purpose, row.owner, row.sections, row.warnings) == ("Tax Invoice", "finance", "Billing", None, ["a", "2"], ["w"])


def test_total_columns():
    schema = parse_columns([{"name": "Tax", "type": "currency"}, {"name": "Discount", "type": "number"}, {"name": "Grand Total", "type": "currency"}, {"name": "Lines", "type": "entity_array", "entitySchema": {"columns": [{"name": "Unit Price", "type": "currency"}, {"name": "Amount", "type": "currency"}]}}])
    assert total_columns(schema) == ("Lines", "Amount", "Grand Total", False, ("Tax",), ("Discount",))
    assert total_columns(schema[:3]) is None
    assert total_columns([*schema, Column("Sub-total", "currency")])[2:4] == ("Sub-total", True)
