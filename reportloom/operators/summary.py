"""Summaries: metric by model for a prompt, and metric by prompt for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_AVAILABLE = "N/A"
# The summary's rows, each with the metric's folder, its mode and its column, in order.
SUMMARY_METRICS = [
    ("phe_presence_sensitivity", "phe_presence", "", "sensitivity"),
    ("ivh_presence_sensitivity", "ivh_presence", "", "sensitivity"),
    ("ivh_presence_specificity", "ivh_presence", "", "specificity"),
    ("ich_location_accuracy", "ich_location", "strict", "accuracy"),
    ("ivh_location_accuracy", "ivh_location", "strict", "accuracy"),
    ("phe_severity_accuracy", "phe_severity", "", "accuracy"),
    ("ich_size_accuracy", "ich_size", "strict", "accuracy"),
]


def grid(metrics: DataFrame, values: DataFrame, column: str = "model") -> DataFrame:
    """(metric, ord, column, value) of every metric and every model or prompt; 'N/A' where there is no value.

    ``metrics`` is (metric, ord), ``values`` (metric, column, value). Of several values the first by ``path`` counts, where
    there is such a column. The grid is metrics by names, a few rows.
    """
    value = F.min_by("value", "path") if "path" in values.columns else F.first("value")
    one = values.groupBy("metric", column).agg(value.alias("value"))
    whole = metrics.crossJoin(values.select(column).distinct())
    return whole.join(one, ["metric", column], "left").withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit(NOT_AVAILABLE)))


def wide(cells: DataFrame, column: str = "model", names: list[str] | None = None) -> DataFrame:
    """One row a metric, in order, one text column a name; names in order of text unless given."""
    names = names or sorted(r[0] for r in cells.select(column).distinct().collect())
    return cells.groupBy("metric", "ord").pivot(column, names).agg(F.first("value")).orderBy("ord", "metric").drop("ord")


def summary_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m[0], i) for i, m in enumerate(SUMMARY_METRICS)], "metric string, ord int")


def long_metrics(table: DataFrame, metric: str, mode: str = "") -> DataFrame:
    """(metric, model, prompt_id, value) of the summary's rows that a metrics table (with model and prompt_id) feeds."""
    wanted = [(name, column) for name, folder, m, column in SUMMARY_METRICS if (folder, m) == (metric, mode) and column in table.columns]
    cells = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("string").alias("value")) for n, c in wanted)) if wanted else F.array().cast("array<struct<metric:string,value:string>>")
    return table.select("model", "prompt_id", F.inline(cells))


def common_names(values: DataFrame, name: str = "model", across: str = "prompt_id") -> DataFrame:
    """Names that every group of ``across`` has."""
    held = values.groupBy(name).agg(F.count_distinct(across).alias("n"))
    return held.join(values.agg(F.count_distinct(across).alias("all")), F.col("n") == F.col("all")).select(name)


def prompt_summary(values: DataFrame, model: str, metrics: DataFrame) -> DataFrame:
    """Metric by prompt of one model; prompts in order of text (1, 10, 2)."""
    prompts = sorted(r[0] for r in values.select("prompt_id").distinct().collect())
    own = values.filter(F.col("model") == model)
    cells = metrics.crossJoin(values.select("prompt_id").distinct()).join(own.select("metric", "prompt_id", "value"), ["metric", "prompt_id"], "left")
    cells = cells.withColumn("value", F.coalesce("value", F.lit(NOT_AVAILABLE)))
    return wide(cells.withColumn("prompt", F.concat(F.lit("prompt"), "prompt_id")), "prompt", [f"prompt{p}" for p in prompts])
