import os
import sys

import duckdb
import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_module
from check_queries import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            connection.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return connection


def test_entry_has_rows(spark):
    assert 0 < entry_module.entry(spark).count() <= 20


def test_every_check_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_some_query_checks_every_numeric_column(spark):
    queries = entry_module.queries()
    numeric = {f.name for f in queries["corpus_user_days"](spark, SF).schema if isinstance(f.dataType, T.NumericType)}
    found = {r["column"] for r in queries["quality_constant_numeric_columns"](spark, SF).collect() if r["check"] == "constant"}
    assert "usb_count" in found and numeric == found


def test_numeric_columns_equal_their_sql(spark, base):
    test_query_equals_its_sql(spark, base, "quality_constant_numeric_columns")


CHECKED = [
    "corpus_user_days", "usb_burst_dedup", "host_user_days", "labelled_days", "holdout_split",
    "exported_thresholds", "deployment_user_report", "quality_zscores", "exact_roc_auc",
    "declared_email_features", "security_event_xml", "csv_features",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, base, name):
    df = entry_module.queries()[name](spark, SF)
    answer = base.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(answer.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(answer.columns, answer.fetchall())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_imports_without_the_text_operators(tmp_path, with_pipeline):
    """A copy without the optional folders keeps every other query, whether or not the pipeline file is there."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "riskloom"), tmp_path / "riskloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    code = "import re, __spark_entry__ as e; print(sum(bool(re.match(r'op\\d+_|pipeline', k)) for k in e.queries()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    text, every = map(int, out.stdout.split()[-2:])
    assert text == 0 and every >= 130
