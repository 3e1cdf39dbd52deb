"""All scores out of one shuffle of the predictions.

``gathered_all`` brings a model's, prompt's and ID's rows together once, whatever their types; ``wide_rows`` meets them with the
ground truth in one join and gives a row a struct for each metric (null where the row doesn't count for it); ``tallies`` adds
all of them up in one aggregation. Tallies are sums, so those of disjoint rows can be added (``merged``), and
``metric_table`` turns them into a metric's table. Meanings of the metrics are those of ``scoring``, whose expressions are used.

Nulls: a row without an ID is no prediction; ground-truth rows without one count and match nothing. Repeated ground-truth rows
count each. Without predictions nothing is detected; without ground truth every predicted ID is an extra one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import any_true, norm, parse_bool, require, safe_div
from ..functions.labels import label_list, severity_list
from ..functions.sizes import TOLERANCE_MM, greedy_match, parse_sizes, size_text
from . import scoring as S
from .formatting import of_type


@dataclass(frozen=True)
class Metric:
    """``form`` is presence, severity, location or size; ``kind`` the type of the rows that it reads."""

    name: str
    form: str
    kind: str
    truth: str
    value: str = ""
    strip: bool = True

    @property
    def modes(self) -> tuple[str, ...]:
        return ("strict", "flexible") if self.form in ("location", "size") else ("",)


METRICS = (
    Metric("ivh_presence", "presence", "IVH", "ivh_presence", strip=False), Metric("phe_presence", "presence", "PHE", "phe_presence"),
    Metric("phe_severity", "severity", "PHE", "phe_intensity", "size"), Metric("ich_location", "location", "ICH", "ich_location", "structure"),
    Metric("ivh_location", "location", "IVH", "ivh_location", "structure"), Metric("ich_size", "size", "ICH", "size", "size"),
)
_PARTS = {"severity": severity_list, "location": label_list, "size": parse_sizes}


def metrics_for(gt: DataFrame, wanted: tuple[str, ...] = ()) -> list[Metric]:
    """Metrics (of ``wanted``, if told) whose columns the ground truth has."""
    return [m for m in METRICS if m.truth in S.with_location(gt, m.truth).columns and (not wanted or m.name in wanted)]


def gathered_all(predictions: DataFrame, metrics: list[Metric], by: S.By, order: tuple[str, ...] = ()) -> DataFrame:
    """(by, ID, a column a metric): whether a row of its type is there, or its rows' parts and raw texts in order, null
    without any. One exchange, by (by, ID)."""
    require(predictions, "ID", "type", *{m.value for m in metrics if m.value})
    mine = {m: of_type(m.kind, m.strip) for m in metrics}
    held = []
    for m in metrics:
        if m.form == "presence":
            held.append(F.bool_or(mine[m]).alias(m.name))
        else:
            value = F.col(m.value)
            raw = [F.coalesce(value.cast("string"), F.lit("")).alias("raw")]
            held.append(F.array_sort(F.collect_list(F.when(mine[m], F.struct(*order, _PARTS[m.form](value).alias("parts"), *raw)))).alias(m.name))
    rows = predictions.filter(F.col("ID").isNotNull() & any_true(*mine.values())).withColumn("ID", F.col("ID").cast("string"))
    found = rows.groupBy(*by, "ID").agg(*held)
    lists = {m.name: F.struct(F.flatten(f"{m.name}.parts").alias("pred"), F.col(f"{m.name}.raw").alias("raw")) for m in metrics if m.form != "presence"}
    return found.withColumns({n: F.when(F.size(n) > 0, x) for n, x in lists.items()})


def truths(gt: DataFrame, metrics: list[Metric], ignore_all_false: bool) -> DataFrame:
    """(ID, counts, known, first, truth): whether a row counts (for sizes every row does), whether a row of its ID does, and
    whether it is the one that stands for an ID of which none does."""
    rows = S.with_location(gt, "ich_location").withColumn("ID", F.col("ID").cast("string"))
    ask = {"presence": lambda c: parse_bool(c), "severity": norm, "location": lambda c: F.when(norm(c) != "", label_list(c)), "size": lambda c: F.when(norm(c) != "", parse_sizes(c))}
    truth = F.struct(*(ask[m.form](F.col(m.truth)).alias(m.name) for m in metrics)).alias("truth")
    if not ignore_all_false:
        return rows.select("ID", F.lit(True).alias("counts"), F.lit(True).alias("known"), F.lit(False).alias("first"), truth)
    counts = ~parse_bool(F.col("all_booleans_false"))
    rows = require(rows, "all_booleans_false").select("ID", counts.alias("counts"), truth)
    rows = rows.withColumn("apart", F.when(F.col("ID").isNull(), F.monotonically_increasing_id()))  # rows without an ID stay apart
    same = Window.partitionBy("ID", "apart").orderBy("counts")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("ID", "counts", F.max("counts").over(whole).alias("known"), (F.row_number().over(same) == 1).alias("first"), "truth")


def wide_rows(gt: DataFrame, found: DataFrame, names: DataFrame | None, metrics: list[Metric], by: S.By, ignore_all_false: bool = False, tolerance_mm: float = TOLERANCE_MM) -> DataFrame:
    """(by, ID, a struct a metric, extra): ground-truth rows of each of ``names`` with what was found, and found rows without
    any. ``extra`` lists the presence metrics for which the ID is predicted though no row that counts has it."""
    rows = truths(gt, metrics, ignore_all_false)
    rows = rows.crossJoin(F.broadcast(names.select(*by).distinct())) if by else rows  # a row a model and prompt, which are few
    both = rows.join(found, [*by, "ID"], "full_outer").withColumn("in_gt", F.col("counts").isNotNull())
    pred = lambda m, f: F.col(f"`{m.name}`")[f]
    sized = [m for m in metrics if m.form == "size"]
    both = both.withColumns({f"_m_{m.name}": F.when(F.col("in_gt") & pred(m, "pred").isNotNull(), greedy_match(F.col("truth")[m.name], pred(m, "pred"), tolerance_mm)) for m in sized})
    located = [m for m in metrics if m.form == "location"]
    both = both.withColumns({f"_p_{m.name}": F.array_distinct(pred(m, "pred")) for m in located})
    out = []
    for m in metrics:
        true, counts = F.col("truth")[m.name], F.col("counts")
        if m.form == "presence":
            fields, scope = [true.alias("actual"), F.coalesce(F.col(m.name), F.lit(False)).alias("predicted")], counts
        elif m.form == "severity":
            fields, scope = S.severity_fields(true, pred(m, "pred"), pred(m, "raw")), counts & (true != "")
        elif m.form == "location":
            fields, scope = S.location_fields(true, F.col(f"_p_{m.name}")), counts & true.isNotNull()
        else:
            fields, scope = S.size_fields(true, pred(m, "pred"), F.col(f"_m_{m.name}")), F.col("in_gt") & true.isNotNull()
        out.append(F.when(scope, F.struct(*fields)).alias(m.name))
    unknown = ~F.col("in_gt") | (~F.col("known") & F.col("first"))
    extra = F.array_compact(F.array(*(F.when(unknown & F.col(m.name), F.lit(m.name)) for m in metrics if m.form == "presence")))
    return both.select(*by, "ID", "in_gt", *out, extra.cast("array<string>").alias("extra"))


def rows_of(wide: DataFrame, m: Metric, by: S.By) -> DataFrame:
    """A metric's own rows, as ``scoring`` gives them."""
    return wide.filter(F.col(m.name).isNotNull()).select(*by, "ID", f"{m.name}.*")


def tallies(wide: DataFrame, metrics: list[Metric], by: S.By) -> DataFrame:
    """(by, a struct of sums a metric): one aggregation for all of them."""

    def sums(m: Metric) -> Column:
        x = F.col(m.name)
        if m.form == "presence":
            a, p = x["actual"], x["predicted"]
            return F.struct(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
        out = [F.count_if(x.isNotNull()).alias("total"), F.count_if(x["correct"]).alias("correct"), F.count_if(x.isNotNull() & x["pred"].isNull()).alias("no_detection")]
        for s in {"location": ("coverage", "precision", "jaccard"), "size": ("coverage", "precision")}.get(m.form, ()):
            out.append(F.coalesce(F.sum(F.when(x["pred"].isNotNull(), x["score"][s])), F.lit(0.0)).alias(s))
        return F.struct(*out)

    return wide.filter("in_gt").groupBy(*by).agg(*(sums(m).alias(m.name) for m in metrics))


def merged(parts: DataFrame, metrics: list[Metric], by: S.By) -> DataFrame:
    """Sums of tallies; ``sign`` says whether a row is added or taken away."""
    add = lambda m, f: F.sum(F.col(m.name)[f] * F.col("sign")).alias(f)
    names = lambda m: [f.name for f in parts.schema[m.name].dataType.fields]
    return parts.groupBy(*by).agg(*(F.struct(*(add(m, f) for f in names(m))).alias(m.name) for m in metrics))


def metric_fields(m: Metric, mode: str) -> list[Column]:
    """A metric's columns out of its tallies."""
    x = F.col(m.name)
    if m.form == "presence":
        return S.presence_fields(*(x[n] for n in ("tp", "fp", "fn", "tn")))
    total, none = x["total"].alias("total"), x["no_detection"].alias("no_detection")
    if mode == "flexible":
        mean = lambda c: safe_div(x[c], x["total"])
        shares = [mean("coverage").alias("avg_gt_coverage"), mean("precision").alias("avg_pred_precision")]
        return [total, none, *shares, *([mean("jaccard").alias("avg_jaccard")] if m.form == "location" else [])]
    strict = [total, x["correct"].alias("correct"), none, safe_div(x["correct"], x["total"]).alias("accuracy")]
    return [c for c in strict if m.form != "severity" or c is not none]


def counted(m: Metric) -> Column:
    """Whether any row counted for the metric."""
    x = F.col(m.name)
    return (x["tp"] + x["fp"] + x["fn"] + x["tn"] if m.form == "presence" else x["total"]) > 0


def metric_table(sums: DataFrame, m: Metric, mode: str, by: S.By) -> DataFrame:
    """A metric's table; models and prompts without any row that counts have none."""
    return sums.filter(counted(m)).select(*by, *metric_fields(m, mode))


def long_values(sums: DataFrame, chosen: list[tuple[Metric, str]], by: S.By) -> DataFrame:
    """(by, metric, mode, name, value): all tables under each other, in one pass over the sums."""

    def cells(m: Metric, mode: str) -> Column:
        table = F.struct(*metric_fields(m, mode))
        names = [f.name for f in sums.select(table.alias("x")).schema["x"].dataType.fields]
        own = [F.struct(F.lit(m.name).alias("metric"), F.lit(mode).alias("mode"), F.lit(n).alias("name"), table[n].cast("double").alias("value")) for n in names]
        return F.when(counted(m), F.array(*own))

    return sums.select(*by, F.inline(F.flatten(F.array_compact(F.array(*(cells(m, mode) for m, mode in chosen))))))


def error_columns(m: Metric, mode: str) -> list[str]:
    shown = {"presence": [], "severity": ["gt", "pred"]}.get(m.form, ["gt", "pred"])
    return ["ID", *shown, *(["missing", "extra", "scores"] if mode == "flexible" else [])]


def error_lines(wide: DataFrame, chosen: list[tuple[Metric, str]], by: S.By) -> DataFrame:
    """(by, metric, mode, section, ID, line): all errors of all metrics in one pass over the rows, as lines of reports. Metrics
    with an error become rows of one shape first, so that one expression, of a size that the JVM compiles, makes all lines."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    texts = "array<string>"
    none = F.lit(None).cast(texts)

    def listed(m: Metric, field: str) -> Column:
        x = F.col(m.name)[field]
        return F.transform(x, size_text) if m.form == "size" else F.array(x) if m.form == "severity" and field == "gt" else x

    entries = []
    for m in dict.fromkeys(m for m, _ in chosen):
        x, modes = F.col(m.name), [mode for other, mode in chosen if other == m]
        score = F.lit(None).cast("struct<coverage:double,precision:double,jaccard:double>")
        if m.form == "presence":
            section = F.when(F.array_contains("extra", m.name), "extra").when(x["actual"] != x["predicted"], F.when(x["predicted"], "false_positive").otherwise("false_negative"))
            lists = [none] * 4
        else:
            section = F.when(~x["correct"], F.when(x["pred"].isNull(), "no_detection").otherwise("mismatch"))
            flexible = "flexible" in modes
            lists = [listed(m, "gt"), listed(m, "pred"), *([listed(m, "missing"), listed(m, "extra")] if flexible else [none] * 2)]
            if flexible:
                score = F.struct(x["score"]["coverage"].alias("coverage"), x["score"]["precision"].alias("precision"), (x["score"]["jaccard"] if m.form == "location" else F.lit(None).cast("double")).alias("jaccard"))
        told = [F.lit(m.name).alias("metric"), F.lit(m.form).alias("form"), F.lit(",".join(modes)).alias("modes"), section.alias("section"), *(c.cast(texts).alias(n) for n, c in zip(("gt", "pred", "missing", "extra"), lists, strict=True)), score.alias("score")]
        entries.append(F.when(section.isNotNull(), F.struct(*told)))
    found = wide.select(*by, "ID", F.inline(F.array(*entries))).filter(F.col("section").isNotNull())
    found = found.select("*", F.explode(F.split("modes", ",")).alias("mode"))
    share = lambda n, s: F.concat(F.lit(f"{n}="), F.coalesce(F.col("score")[s].cast("decimal(38,3)").cast("string"), F.lit("nul")))
    shares = F.concat_ws(" ", share("gt_coverage", "coverage"), share("pred_precision", "precision"), F.when(F.col("form") == "location", share("jaccard", "jaccard")))
    told = lambda when, names: [F.when(when, blank(F.array_join(n, "/"))) for n in names]
    flexible = F.col("mode") == "flexible"
    line = F.concat_ws("\t", blank(F.col("ID")), *told(F.col("form") != "presence", ("gt", "pred")), *told(flexible, ("missing", "extra")), F.when(flexible, shares))
    return found.select(*by, "ID", "metric", "mode", "section", line.alias("line"))
