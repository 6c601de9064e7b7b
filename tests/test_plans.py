"""The shape of physical plans: what must hold at any size."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from riskloom.operators.reports import top_days
from riskloom.operators.sessions import pair_adjacent
from riskloom.registry import QUERIES, views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.mark.parametrize("name", [
    "corpus_user_days", "host_user_days", "fused_scores", "labelled_days", "days_since_last_usb",
    "external_email_with_archive", "population_zscore", "class_weights",
])
def test_no_pairs_of_everything(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_events_are_ordered_per_user_and_cell(spark):
    text = plan(pair_adjacent(views.logons(spark, SF), views.CORPUS_VIEW))
    lead = next(line for line in text.splitlines() if "lead(ts" in line)
    assert "__cell" in lead.split("windowspecdefinition(")[1].split("ASC")[0]


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(views.devices(spark, SF).where(F.col("activity") == "Connect").select("user"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "In(event_type" in scan
    assert "value" not in scan.split("ReadSchema")[1] and "props" not in scan.split("ReadSchema")[1]


def test_top_days_are_limited_before_the_shuffle(spark):
    table = views.scores(spark, SF).withColumn("combined_risk_score", F.col("supervised_score"))
    text = plan(top_days(table, 3, "id"))
    assert text.count("WindowGroupLimit") == 2
