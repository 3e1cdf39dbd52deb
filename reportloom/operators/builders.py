"""From report JSON to reports, checklists, measurements and the ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import any_true, parse_bool_value, prefixed, require
from ..functions.sizes import pair_text, to_cm

AXES = ["x1", "y1", "z1", "x2", "y2", "z2"]
NO_MEASURE = "no_measure"
ICH_PREFIX, IVH_PREFIX, PHE_PREFIX = "loc_", "ivh_", "phe_"
IVH_NONE, PHE_NONE = "ivh_none", "phe_none"
PHE_LEVELS = ("phe_mild", "phe_moderate", "phe_severe")

# number types of a variant; a JSON true counts as 1.0 where a number is asked for
_NUMBER = r"^(?:BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"


def _variant(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _number(variant: Column) -> Column:
    kind = F.schema_of_variant(variant)
    return F.when(kind.rlike(_NUMBER), F.try_variant_get(variant, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(variant, "$", "boolean").cast("double"))


def _text(variant: Column) -> Column:
    return F.when(F.schema_of_variant(variant) == "STRING", F.try_variant_get(variant, "$", "string"))


def with_dictation(documents: DataFrame) -> DataFrame:
    """Documents (ID, value) whose dictation is a non-empty string, with it."""
    said = _text(_variant(F.try_parse_json("value"), "$.dictation"))
    return documents.withColumn("dictation", said).filter(F.col("dictation") != "")


def build_reports(documents: DataFrame) -> DataFrame:
    return with_dictation(documents).select("ID", F.col("dictation").alias("Report"))


def _checklists(documents: DataFrame) -> DataFrame:
    return documents.withColumn("list", F.from_json("value", "checklist map<string,variant>")["checklist"])


def common_keys(documents: DataFrame) -> DataFrame:
    """(key) of the checklist keys that every document with a checklist has, dictation or not."""
    lists = _checklists(documents).filter(F.col("list").isNotNull())
    held = lists.select(F.explode_outer(F.map_keys("list")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return held.join(lists.agg(F.count("*").alias("all")), F.col("n") == F.col("all")).filter(F.col("key").isNotNull()).select("key")


def build_booleans(documents: DataFrame) -> DataFrame:
    """ID and a column for each common key, in order of name; only a JSON true is true, and a report without a checklist
    has none. The keys are a table's header, so they come to the driver."""
    keys = sorted(r["key"] for r in common_keys(documents).collect())
    rows = _checklists(with_dictation(documents))
    is_true = lambda k: F.coalesce((F.schema_of_variant(F.try_element_at("list", F.lit(k))) == "BOOLEAN") & F.try_variant_get(F.try_element_at("list", F.lit(k)), "$", "boolean"), F.lit(False))
    return rows.select("ID", *(is_true(k).alias(k) for k in keys))


def build_measurements(documents: DataFrame) -> DataFrame:
    """A row a valid measurement (numbered from 1), or one without for a report that has none; null when measurements isn't
    a list. The first entry of a measurement counts, in the order of the text, and is valid with a value other than 0."""
    raw = F.from_json("value", "measurements array<string>")["measurements"]
    items = with_dictation(documents).select("ID", raw.alias("raw")).filter(F.col("raw").isNotNull())
    typed = lambda x: F.from_json(x, "measurements map<string,variant>, control_points array<variant>")

    def held(one: Column) -> Column:
        first = F.try_element_at(one["measurements"], F.map_keys(one["measurements"])[0])
        points = F.filter(F.coalesce(one["control_points"], F.array().cast("array<variant>")), lambda p: p.isNotNull())
        return F.struct(first.alias("first"), points.alias("points"))

    def entry(x: Column) -> Column:
        first, points = x["first"], x["points"]
        axis = lambda k, d: F.when(F.size(points) >= 2, F.when(_variant(F.get(points, F.lit(k)), "$.position_ras[2]").isNotNull(), _number(_variant(F.get(points, F.lit(k)), f"$.position_ras[{d}]"))))
        return F.struct(_number(_variant(first, "$.value")).alias("measurement"), _text(_variant(first, "$.unit")).alias("unit_measure"), *(axis(k, d).alias(f"{'xyz'[d]}{k + 1}") for k in (0, 1) for d in (0, 1, 2)))

    objects = F.filter("raw", lambda x: F.startswith(F.ltrim(x), F.lit("{")))
    entries = F.transform(F.transform(F.transform(objects, typed), held), entry)  # one after the other: each text is parsed once
    valid = F.filter(entries, lambda e: e["measurement"].isNotNull() & (e["measurement"] != 0))
    rows = items.select("ID", F.posexplode_outer(valid).alias("at", "e"))
    index = F.coalesce((F.col("at") + 1).cast("string"), F.lit(NO_MEASURE))
    return rows.select("ID", index.alias("measurement_index"), *(F.col(f"e.{a}").alias(a) for a in AXES), F.col("e.measurement").alias("measurement"), F.col("e.unit_measure").alias("unit_measure"))


def multi_label(df: DataFrame, flags: list[str], prefix: str) -> Column:
    """Suffixes of the true flags, in column order, joined with '/'; null for none."""
    names = F.array(*(F.when(F.col(f), F.lit(f.removeprefix(prefix))) for f in flags)) if flags else F.array().cast("array<string>")
    return F.nullif(F.array_join(F.filter(names, lambda x: x.isNotNull()), "/"), F.lit(""))


def ground_truth_labels(booleans: DataFrame, all_ich_true: bool = False) -> DataFrame:
    """Presence, locations and severity of each row of a checklist table."""
    require(booleans, "ID")
    kinds = dict(booleans.dtypes)
    names = [c for c in booleans.columns if c != "ID"]
    x = booleans.select("ID", *(parse_bool_value(F.col(c), kinds[c] if kinds[c] in ("boolean", "string") else "number").alias(c) for c in names))
    ich, ivh = prefixed(names, ICH_PREFIX), prefixed(names, IVH_PREFIX, (IVH_NONE,))
    phe = [c for c in PHE_LEVELS if c in names]
    veto = lambda none: ~F.col(none) if none in names else F.lit(True)
    return x.select(
        "ID",
        (~any_true(*map(F.col, names))).alias("all_booleans_false"),
        (F.lit(True) if all_ich_true else any_true(*map(F.col, ich))).alias("ich_presence"),
        (veto(IVH_NONE) & any_true(*map(F.col, ivh))).alias("ivh_presence"),
        (veto(PHE_NONE) & any_true(*map(F.col, phe))).alias("phe_presence"),
        multi_label(x, ich, ICH_PREFIX).alias("ich_localisation"),
        multi_label(x, ivh, IVH_PREFIX).alias("ivh_location"),
        multi_label(x, phe, PHE_PREFIX).alias("phe_intensity"),
    )


def size_texts(measurements: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(ID, size): a report's measurements in centimetres, in pairs. In order of their number, those without one last,
    then of ``order`` (columns that tell the rows' order)."""
    require(measurements, "ID", "measurement_index", "measurement", "unit_measure")
    number = F.expr("try_cast(measurement_index AS DOUBLE)")
    value = to_cm(F.expr("try_cast(measurement AS DOUBLE)"), F.col("unit_measure"))
    part = F.struct(F.coalesce(number, F.lit(float("inf"))).alias("n"), *(F.col(c) for c in order or []), value.alias("v"))
    rows = measurements.filter(F.col("ID").isNotNull())
    gathered = rows.groupBy("ID").agg(F.array_sort(F.collect_list(part)).alias("x"))
    values = F.filter(F.transform("x", lambda e: e["v"]), lambda v: v.isNotNull())
    return gathered.select("ID", pair_text(values).alias("size"))


def ground_truth(booleans: DataFrame | None = None, measurements: DataFrame | None = None, all_ich_true: bool = False, order: list[str] | None = None) -> DataFrame:
    """Labels and sizes of all reports of either table; either alone is enough."""
    if booleans is None and measurements is None:
        raise ValueError("a checklist table or a measurement table is needed")
    if booleans is None:
        return size_texts(measurements, order)
    labels = ground_truth_labels(booleans, all_ich_true)
    return labels if measurements is None else labels.join(size_texts(measurements, order), "ID", "full_outer")


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 1 inside a key, in a told order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
