"""Queries with much work a row don't leave a small file to one task."""

import pytest

from reportloom.plans.queries import QUERIES
from reportloom.session import spread


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = spark.sql("SELECT id AS p_partkey, concat('part ', id) AS p_name, cast(id % 50 + 1 AS int) AS p_size FROM range(200)")
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["parse_answer_lines", "report_measurements", "report_texts", "checklist_booleans"])
def test_rows_of_one_file_are_spread(spark, parts, name):
    assert QUERIES[name](spark, parts).rdd.getNumPartitions() >= 4


def test_rows_in_enough_partitions_stay(spark):
    rows = spark.range(0, 100, 1, 9)
    assert spread(rows) is rows
    assert sorted(r[0] for r in spread(spark.range(0, 100, 1, 1)).collect()) == list(range(100))


def test_texts_of_a_measurement_are_parsed_once(spark, parts):
    plan = QUERIES["report_measurements"](spark, parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(measurements,MapType") <= 2
