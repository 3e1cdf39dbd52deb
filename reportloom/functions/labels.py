"""Label lists and their set measures, in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import norm, safe_div


def label_list(value: Column) -> Column:
    """Distinct labels in order of appearance: parts between '/' and '-', without blanks and the unknown mark."""
    parts = F.flatten(F.transform(F.split(norm(value), "/"), lambda x: F.split(x, "-")))
    kept = F.filter(F.transform(parts, norm), lambda x: (x != "") & (x != "u"))
    return F.array_distinct(kept)


def severity_list(value: Column) -> Column:
    """Severities between '/' alone, repeats kept."""
    return F.filter(F.transform(F.split(norm(value), "/"), norm), lambda x: x != "")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def overlap(gt: Column, pred: Column) -> Column:
    """struct(coverage, precision, jaccard) of two label arrays; 0.0 over nothing."""
    both = F.size(F.array_intersect(gt, pred))
    return F.struct(
        safe_div(both, F.size(gt)).alias("coverage"),
        safe_div(both, F.size(pred)).alias("precision"),
        safe_div(both, F.size(F.array_union(gt, pred))).alias("jaccard"),
    )
