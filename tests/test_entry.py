import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert {"p1_found", "p4_found", "flt_eq", "gateway_union"} <= set(contract.queries())


def test_the_contract_can_be_read_without_a_session():
    root = os.path.dirname(os.path.abspath(contract.__file__))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout.split()[-1]) > 50


def test_the_rest_stands_without_the_llm_package():
    root = os.path.dirname(os.path.abspath(contract.__file__))
    code = "import sys; sys.modules['tessera.llm'] = None\nimport __spark_entry__ as e; print(sorted(e.queries())[-1], any(q.startswith('p2') for q in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[-1] == "False", said.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p1_tables", "p1_columns", "p1_records", "p1_values", "p4_table", "exists_mixed_or", "entries_match_any", "coverage_line", "score_cells", "section_coverage", "view_flatten", "gateway_rollup"])
def test_queries_run(spark, name):
    assert contract.queries()[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert contract.entry(spark).columns == ["response_id", "node_kind", "node_path", "parent_path"]


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(contract.__file__))
    code = f"""import sys; sys.path.insert(0, {root!r})
from tessera.session import local_session
from tessera.operators.drift import schema_changes
spark = local_session(cores=1, shuffle_partitions=1, driver_memory='1g')
rows = [('c', 1, '[{{"name": "A"}}]'), ('c', 2, '[]')]
print(schema_changes(spark.createDataFrame(rows, 'collection_id string, schema_version int, schema_json string')).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert said.returncode == 0 and said.stdout.split()[-1] == "1", said.stderr[-2000:]
