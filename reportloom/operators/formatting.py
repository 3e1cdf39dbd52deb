"""From raw lesion rows to one row for each (ID, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import UNKNOWN
from ..functions.exprs import strip as blanks_off
from ..functions.rules import map_ich_structure, map_ivh_structure, map_phe_severity

TYPES = ["ICH", "IVH", "PHE"]
#: Columns that tell the rows' order, and lineage, aren't values.
LINEAGE = ("file", "prompt_id", "model")


def drop_bulky(raw: DataFrame) -> DataFrame:
    return raw.drop("DNN Answer", "Report")


def keep_types(rows: DataFrame, types: list[str] = TYPES) -> DataFrame:
    """Exact names alone."""
    return rows.filter(F.col("type").isin(types))


def of_type(name: str, strip: bool = True) -> F.Column:
    """Whether a row is of a type, whatever the case (and, with ``strip``, blanks around it)."""
    kind = F.upper(F.col("type"))
    return F.coalesce((blanks_off(kind) if strip else kind) == name, F.lit(False))


def _mapped(rows: DataFrame, name: str, target: str, needs: tuple[str, ...], value) -> DataFrame:
    if not {"type", target, *needs} <= set(rows.columns):
        return rows
    return rows.withColumn(target, F.when(of_type(name, strip=False), value).otherwise(F.col(target)))


def map_ich_location(rows: DataFrame) -> DataFrame:
    return _mapped(rows, "ICH", "structure", (), map_ich_structure(F.col("structure")))


def map_ivh_location(rows: DataFrame) -> DataFrame:
    return _mapped(rows, "IVH", "structure", ("lateralization",), map_ivh_structure(F.col("structure"), F.col("lateralization")))


def map_phe_size(rows: DataFrame) -> DataFrame:
    """Only PHE rows are folded, in a Python worker; the others don't leave the JVM."""
    if not {"type", "size"} <= set(rows.columns):
        return rows
    mine = of_type("PHE", strip=False)
    mapped = rows.filter(mine).withColumn("size", map_phe_severity(F.col("size")))
    return rows.filter(~mine).unionByName(mapped)


def group_by_lesion_type(rows: DataFrame, order: list[str], by: tuple[str, ...] = ("ID", "type")) -> DataFrame:
    """One row a group: the other columns' values joined with '/' in the told order (unknown for none), and the count.

    ``order`` columns are not aggregated; texts among them go by the number they spell ("2" before "10"), then as texts;
    null keys are a group. Lineage columns belong in ``by`` when files are together.
    """
    rows = rows.drop("certainty") if "Lesion Index" in order else rows.drop("Lesion Index", "certainty")
    values = [c for c in rows.columns if c not in by and c not in order]
    kinds = dict(rows.dtypes)
    told = ", ".join(f"try_cast(`{c}` AS DOUBLE) NULLS LAST, `{c}`" if kinds[c] == "string" else f"`{c}`" for c in order)
    joined = [F.coalesce(F.expr(f"listagg(cast(`{c}` AS STRING), '/') WITHIN GROUP (ORDER BY {told})"), F.lit(UNKNOWN)).alias(c) for c in values]
    return rows.groupBy(*(F.col(f"`{c}`") for c in by)).agg(*joined, F.count("*").alias("count"))


def format_rows(raw: DataFrame, order: list[str], keep: bool = True, ich: bool = True, ivh: bool = True, phe: bool = True, group: bool = True, by: tuple[str, ...] = ("ID", "type")) -> DataFrame:
    """The steps that are switched on, in this order: type filter, ICH, IVH and PHE mapping, grouping."""
    rows = drop_bulky(raw)
    for on, step in ((keep, keep_types), (ich, map_ich_location), (ivh, map_ivh_location), (phe, map_phe_size)):
        rows = rows.transform(step) if on else rows
    return group_by_lesion_type(rows, order, by) if group else rows
