"""The plan of all scores at once: what is broadcast, and code that the JVM compiles."""

import re

import pytest
from pyspark.sql import functions as F

from reportloom.operators import scorecard as C
from reportloom.plans.scoring import Options, score_all


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("scores"))
    spark.sql("SELECT cast(id AS string) AS ID, 'true' AS ivh_presence, 'no' AS phe_presence, 'mild' AS phe_intensity, 'a/b' AS ich_location, 'c' AS ivh_location, 'false' AS all_booleans_false FROM range(50)").write.parquet(f"{folder}/gt")
    # the predictions' file is the larger one by far, as theirs are
    spark.sql("SELECT cast(id % 60 AS string) AS ID, concat('m', id % 2) AS model, '1' AS prompt_id, element_at(array('ICH', 'IVH', 'PHE'), cast(id % 3 + 1 AS int)) AS type, 'a-d' AS structure, 'mild' AS size, md5(cast(id AS string)) AS Report FROM range(20000)").write.parquet(f"{folder}/rows")
    return score_all(spark.read.parquet(f"{folder}/gt"), spark.read.parquet(f"{folder}/rows"), Options(True, order=("structure", "size")))


def lines_of(scored):
    return C.error_lines(scored.wide, [(s.source, s.mode) for s in scored], ("model", "prompt_id"))


def test_names_are_broadcast_and_not_the_ground_truth(scored):
    plan = scored.sums._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildRight, Cross" in plan and "BuildLeft, Cross" not in plan


def test_ground_truth_is_dealt_once_for_its_windows(scored):
    plan = scored.wide._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 1


def test_error_lines_are_made_by_code_that_is_compiled(scored):
    spark = scored.wide.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else no code is made before the run
    try:
        lines = lines_of(scored).groupBy("section").agg(F.sum(F.length("line")))
        shown = spark._jvm.PythonSQLUtils.explainString(lines._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) <= 8000  # HotSpot compiles no method beyond that


def test_shares_are_written_as_by_format_string(spark):
    rows = spark.sql("SELECT cast(a AS double) / b AS x FROM (SELECT explode(sequence(1, 60)) AS b) LATERAL VIEW explode(sequence(0, b)) t AS a")
    assert rows.filter(F.format_string("%.3f", "x") != F.col("x").cast("decimal(38,3)").cast("string")).count() == 0
