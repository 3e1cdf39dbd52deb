"""Scores of formatted lesion rows against a ground truth: presence, severity, locations, sizes.

Every score has two steps. ``*_rows`` gives a row a ground-truth row, with what was predicted for it and how it compares;
``*_metrics`` aggregates that in one pass. Predictions are first gathered to one row an ID, so the join is a hash join
on ID with at most one match, and strict and flexible scores share one plan. ``by`` names columns (such as model and
prompt_id) whose combinations are scored side by side in one job.

IDs compare as texts; a null ID is no prediction, and ground-truth rows with equal IDs count each. ``order`` names the
columns that tell the order of prediction rows; it decides greedy size matches and the texts of error reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import norm, parse_bool, require, safe_div
from ..functions.labels import label_list, overlap, same_set, severity_list
from ..functions.sizes import TOLERANCE_MM, greedy_match, parse_sizes, size_text
from .formatting import of_type

By = tuple[str, ...]


def evaluated(gt: DataFrame, predictions: DataFrame, by: By, ignore_all_false: bool = False) -> DataFrame:
    """Ground-truth rows that count, for each combination of ``by``; these are few and known by the predictions."""
    rows = gt.withColumn("ID", F.col("ID").cast("string"))
    if ignore_all_false:
        rows = require(rows, "all_booleans_false").filter(~parse_bool(F.col("all_booleans_false")))
    return rows.crossJoin(predictions.select(*by).distinct()) if by else rows


def ignored_ids(gt: DataFrame) -> DataFrame:
    return require(gt, "all_booleans_false").filter(parse_bool(F.col("all_booleans_false"))).select(F.col("ID").cast("string").alias("ID"))


def gathered(predictions: DataFrame, kind: str, value: str, parts: Column, by: By, order: tuple[str, ...], strip: bool = True) -> DataFrame:
    """(by, ID, pred): all parts of an ID's rows of one type, end to end in the rows' order; and its raw values."""
    rows = predictions.filter(of_type(kind, strip)).select(*by, F.col("ID").cast("string").alias("ID"), F.struct(*order, parts.alias("parts"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("raw")).alias("x"))
    held = rows.groupBy(*by, "ID").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return held.select(*by, "ID", F.flatten("x.parts").alias("pred"), F.col("x.raw").alias("raw"))


def matched(gt: DataFrame, found: DataFrame, by: By) -> DataFrame:
    """Ground-truth rows with ``pred``, null where no row of the type was predicted."""
    return gt.join(found, [*by, "ID"], "left")


# presence


def presence_rows(gt: DataFrame, predictions: DataFrame, truth: str, kind: str, by: By = (), ignore_all_false: bool = False, strip: bool = True) -> DataFrame:
    require(gt, "ID", truth)
    require(predictions, "ID", "type")
    ids = predictions.filter(of_type(kind, strip)).select(*by, F.col("ID").cast("string").alias("ID")).distinct().withColumn("predicted", F.lit(True))
    rows = evaluated(gt, predictions, by, ignore_all_false).select(*by, "ID", parse_bool(F.col(truth)).alias("actual"))
    return rows.join(ids, [*by, "ID"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(False)))


def presence_metrics(rows: DataFrame, by: By = ()) -> DataFrame:
    a, p = F.col("actual"), F.col("predicted")
    counts = rows.groupBy(*by).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    return counts.select(*by, *presence_fields(*map(F.col, ("tp", "fp", "fn", "tn"))))


def presence_fields(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    precision, sensitivity = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), sensitivity.alias("sensitivity"), safe_div(tn, tn + fp).alias("specificity"),
        safe_div(2 * precision * sensitivity, precision + sensitivity).alias("f1_score"), safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    ]


def presence_errors(rows: DataFrame, by: By = ()) -> DataFrame:
    """(section, ID) of wrongly detected and missed rows."""
    wrong = rows.filter(F.col("actual") != F.col("predicted"))
    return wrong.select(*by, F.when(F.col("predicted"), "false_positive").otherwise("false_negative").alias("section"), "ID")


def extra_ids(gt: DataFrame, predictions: DataFrame, kind: str, by: By = (), ignore_all_false: bool = False, strip: bool = True) -> DataFrame:
    """Predicted IDs that no evaluated ground-truth row has."""
    known = evaluated(gt, predictions, (), ignore_all_false).select("ID")
    ids = predictions.filter(of_type(kind, strip)).select(*by, F.col("ID").cast("string").alias("ID")).distinct()
    return ids.join(known, "ID", "left_anti").select(*by, "ID")


# severity


def severity_rows(gt: DataFrame, predictions: DataFrame, by: By = (), ignore_all_false: bool = False, order: tuple[str, ...] = (), truth: str = "phe_intensity", value: str = "size") -> DataFrame:
    """The whole true text must be one of the predicted severities; ``several`` tells of a '/' in a predicted text."""
    require(gt, "ID", truth)
    require(predictions, "ID", "type", value)
    rows = evaluated(gt, predictions, by, ignore_all_false).withColumn("gt", norm(F.col(truth))).filter(F.col("gt") != "")
    both = matched(rows, gathered(predictions, "PHE", value, severity_list(F.col(value)), by, order), by)
    return both.select(*by, "ID", *severity_fields(F.col("gt"), F.col("pred"), F.col("raw")))


def severity_fields(gt: Column, pred: Column, raw: Column) -> list[Column]:
    several = F.coalesce(F.exists(raw, lambda r: F.contains(r, F.lit("/"))), F.lit(False))
    return [gt.alias("gt"), pred.alias("pred"), raw.alias("raw"), F.coalesce(F.array_contains(pred, gt), F.lit(False)).alias("correct"), several.alias("several")]


def severity_metrics(rows: DataFrame, by: By = ()) -> DataFrame:
    return strict_metrics(rows, by).drop("no_detection")


# label sets and sizes


def strict_metrics(rows: DataFrame, by: By = ()) -> DataFrame:
    """total, correct, no_detection, accuracy; what wasn't detected counts in the total."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.count_if(F.col("pred").isNull()).alias("no_detection"))
    return counts.withColumn("accuracy", safe_div(F.col("correct"), F.col("total")))


def flexible_metrics(rows: DataFrame, by: By = (), jaccard: bool = True) -> DataFrame:
    """Mean scores over all rows, 0 for what wasn't detected."""
    mean = lambda c: F.coalesce(F.avg(F.coalesce(F.when(F.col("pred").isNotNull(), F.col(f"score.{c}")), F.lit(0.0))), F.lit(0.0))
    scores = [mean("coverage").alias("avg_gt_coverage"), mean("precision").alias("avg_pred_precision"), *([mean("jaccard").alias("avg_jaccard")] if jaccard else [])]
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("pred").isNull()).alias("no_detection"), *scores)


def location_rows(gt: DataFrame, predictions: DataFrame, kind: str, truth: str, by: By = (), ignore_all_false: bool = False, order: tuple[str, ...] = (), value: str = "structure") -> DataFrame:
    """Predicted and true label sets, whether they are equal, and their overlap."""
    gt = require(with_location(gt, truth), "ID", truth)
    require(predictions, "ID", "type", value)
    rows = evaluated(gt, predictions, by, ignore_all_false).filter(norm(F.col(truth)) != "").withColumn("gt", label_list(F.col(truth)))
    both = matched(rows, gathered(predictions, kind, value, label_list(F.col(value)), by, order), by).withColumn("pred", F.array_distinct("pred"))
    return both.select(*by, "ID", *location_fields(F.col("gt"), F.col("pred")))


def with_location(gt: DataFrame, truth: str) -> DataFrame:
    """The ground truth with its ICH locations under the name of the metric."""
    old = truth == "ich_location" and truth not in gt.columns and "ich_localisation" in gt.columns
    return gt.withColumnRenamed("ich_localisation", truth) if old else gt


def location_fields(gt: Column, pred: Column) -> list[Column]:
    return [
        gt.alias("gt"), pred.alias("pred"), F.coalesce(same_set(gt, pred), F.lit(False)).alias("correct"), overlap(gt, pred).alias("score"),
        F.array_sort(F.array_except(gt, pred)).alias("missing"), F.array_sort(F.array_except(pred, gt)).alias("extra"),
    ]


def size_rows(gt: DataFrame, predictions: DataFrame, tolerance_mm: float = TOLERANCE_MM, by: By = (), order: tuple[str, ...] = (), kind: str = "ICH", truth: str = "size", value: str = "size") -> DataFrame:
    """True and predicted sizes, what the greedy match leaves of either, and the matched shares."""
    require(gt, "ID", truth)
    require(predictions, "ID", "type", value)
    rows = evaluated(gt, predictions, by).filter(norm(F.col(truth)) != "").withColumn("gt", parse_sizes(F.col(truth)))
    both = matched(rows, gathered(predictions, kind, value, parse_sizes(F.col(value)), by, order), by)
    both = both.withColumn("m", F.when(F.col("pred").isNotNull(), greedy_match(F.col("gt"), F.col("pred"), tolerance_mm)))
    return both.select(*by, "ID", *size_fields(F.col("gt"), F.col("pred"), F.col("m")))


def size_fields(gt: Column, pred: Column, match: Column) -> list[Column]:
    """``match`` is what the greedy match leaves of either, null where nothing was predicted."""
    missing, extra = match["missing"], match["remaining"]
    hits = F.size(gt) - F.size(missing)
    score = F.struct(safe_div(hits, F.size(gt)).alias("coverage"), safe_div(hits, F.size(pred)).alias("precision"))
    correct = F.coalesce(pred.isNotNull() & (F.size(missing) == 0) & (F.size(extra) == 0), F.lit(False))
    return [gt.alias("gt"), pred.alias("pred"), correct.alias("correct"), score.alias("score"), missing.alias("missing"), extra.alias("extra")]


def error_rows(rows: DataFrame, by: By = (), flexible: bool = False) -> DataFrame:
    """(section, ID, gt, pred[, missing, extra, scores]) of rows that weren't detected or don't match, as texts."""
    text = lambda c: F.array_join(F.transform(c, size_text), "/") if dict(rows.dtypes)[c].startswith("array<array") else (F.array_join(c, "/") if dict(rows.dtypes)[c].startswith("array") else F.col(c))
    section = F.when(F.col("pred").isNull(), "no_detection").otherwise("mismatch").alias("section")
    out = [section, "ID", text("gt").alias("gt"), F.coalesce(text("pred"), F.lit("")).alias("pred")]
    if flexible:
        names = {"coverage": "gt_coverage", "precision": "pred_precision", "jaccard": "jaccard"}
        have = [n for n in names if n in rows.select("score.*").columns]
        scores = F.concat_ws(" ", *(F.format_string(names[n] + "=%.3f", F.col(f"score.{n}")) for n in have))
        out += [text("missing").alias("missing"), text("extra").alias("extra"), scores.alias("scores")]
    return rows.filter(~F.col("correct")).select(*by, *out)
