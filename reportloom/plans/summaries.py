"""Summaries out of the files that scoring wrote: metric by model of a prompt, and metric by prompt of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import na_normalize, plain_path
from ..operators import summary as M
from ..sources import store
from ..sources.paths import prompt_id
from ..sources.writers import write_rows


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda x: x != "")


def _cells(line: Column) -> Column:
    """The values of a CSV line: those in quotes may hold commas and doubled quotes."""
    bare = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), bare)


def _folders(spark: SparkSession, path: str) -> list[str]:
    if not store.exists(spark, path):
        raise ValueError(f"no folder {path}")
    return [name for _, name, is_folder in store.children(spark, path) if is_folder and not name.startswith(("_", "."))]


def metric_values(spark: SparkSession, folder: str) -> DataFrame:
    """(metric, model, path, value) of the metrics files of a prompt's folder that the summary reads: the strict ones, and
    but for sizes those that left out all-false reports."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="metrics_*.csv")
    parts = F.split(F.regexp_extract(plain_path(F.col("_metadata.file_path")), r"/([^/]+(?:/[^/]+)*)$", 1), "/")
    files = files.select(F.col("_metadata.file_path").alias("path"), parts.alias("p"), _cells(F.try_element_at(_lines(F.col("value")), F.lit(1))).alias("names"), _cells(F.try_element_at(_lines(F.col("value")), F.lit(2))).alias("values"))
    rules = [(name, kind, mode, column, "" if kind == "ich_size" else "_all_false_ignored") for name, kind, mode, column in M.SUMMARY_METRICS]
    wanted = F.broadcast(spark.createDataFrame(rules, "metric string, kind string, mode string, column string, suffix string"))
    both = files.crossJoin(wanted)
    depth = F.when(F.col("mode") == "", 0).otherwise(1)
    at = lambda k: F.try_element_at("p", (F.lit(-k) - depth).cast("int"))
    stem = F.concat(F.lit("_"), F.col("kind"), F.when(F.col("mode") == "", "").otherwise(F.concat(F.lit("_"), F.col("mode"))), F.col("suffix"), F.lit(".csv"))
    model, name = at(3), F.element_at("p", -1)
    fits = (F.size("p") > depth + 2) & (at(2) == F.col("kind")) & ((F.col("mode") == "") | (F.element_at("p", -2) == F.col("mode"))) & F.startswith(name, F.concat(F.lit("metrics_"), model, F.lit("_prompt"))) & F.endswith(name, stem)
    value = F.get("values", F.array_position("names", F.col("column")).cast("int") - 1)
    found = both.filter(fits).select("metric", model.alias("model"), "path", F.when(F.array_contains("names", F.col("column")), value).alias("value"))
    return na_normalize(found, "value")


def summarize_folder(spark: SparkSession, folder: str, output: str | None = None) -> str:
    """Writes the summary of a prompt's folder into it, a column a model folder, and returns its path."""
    models = _folders(spark, folder)
    values = metric_values(spark, folder)
    # every folder is a column, also one without files
    named = values.unionByName(spark.createDataFrame([(m,) for m in models], "model string"), allowMissingColumns=True)
    table = M.wide(M.grid(M.summary_rows(spark), named).filter(F.col("model").isin(models)), "model", models) if models else M.summary_rows(spark).orderBy("ord").select("metric")
    path = f"{folder.rstrip('/')}/{output or f'summary_metrics_prompt{prompt_id(folder.rstrip("/"))}.csv'}"
    write_rows(spark, path, table.columns, [list(r) for r in table.collect()])
    return path


def prompt_values(spark: SparkSession, root: str) -> DataFrame:
    """(path, prompt_id, ord, metric, model, value) of all prompts' summaries under a root."""
    files = spark.read.text(f"{root.rstrip('/')}/prompt*/summary_metrics_prompt*.csv", wholetext=True)
    told = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_name", r"(?:^|_)prompt([^_]*?)(?:_|\.csv$)", 1), F.lit("")), F.lit("U"))
    lines = _lines(F.col("value"))
    x = files.select(F.col("_metadata.file_path").alias("path"), told.alias("prompt_id"), _cells(F.try_element_at(lines, F.lit(1))).alias("names"), F.posexplode(F.slice(lines, F.lit(2), F.size(lines))).alias("ord", "line"))
    x = x.withColumn("cells", _cells(F.col("line"))).filter(F.array_contains("names", "metric"))
    metric = F.get("cells", F.array_position("names", "metric").cast("int") - 1)
    x = x.select("path", "prompt_id", "ord", metric.alias("metric"), F.posexplode("names").alias("at", "model"), "cells").filter("model <> 'metric'")
    return na_normalize(x.select("path", "prompt_id", "ord", "metric", "model", F.get("cells", F.col("at")).alias("value")), "value")


def summarize_prompts(spark: SparkSession, root: str, output: str, model: str | None = None, all_models: bool = False) -> list[str]:
    """Writes one summary a model over all prompts: of one model, or of all that every prompt's summary has."""
    if not model and not all_models:
        raise ValueError("name a model, or ask for all models")
    if not any(name.startswith("prompt") for name in _folders(spark, root)):
        raise ValueError(f"no prompt summaries in {root}")
    values = prompt_values(spark, root).cache()
    models = sorted(r[0] for r in M.common_names(values, "model", "path").collect()) if all_models else [model]
    if not models:
        raise ValueError("no model is in all prompt summaries")
    metrics = values.groupBy("metric").agg(F.min(F.struct("path", "ord")).alias("o"))
    metrics = metrics.select("metric", F.struct("o.path", "o.ord").alias("ord"))
    out = []
    for name in models:
        table = M.prompt_summary(values.select("metric", "prompt_id", "model", "value"), name, metrics)
        out.append(f"{output.rstrip('/')}/summary_prompts_{name}.csv")
        write_rows(spark, out[-1], table.columns, [list(r) for r in table.collect()])
    values.unpersist()
    return out
