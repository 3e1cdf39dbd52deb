"""All metrics of all models and prompts out of one shuffle of the predictions, and their files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import TOLERANCE_MM
from ..operators import scorecard as C
from ..operators import scoring as S
from ..operators.summary import NOT_AVAILABLE, SUMMARY_METRICS, long_metrics
from ..sources import store
from ..sources.paths import metric_paths
from ..sources.writers import write_rows

BY = ("model", "prompt_id")
#: A report of more bytes is a folder of files in order.
REPORT_BYTES = 64 << 20


@dataclass(frozen=True)
class Options:
    ignore_all_false: bool = True
    all_modes: bool = True
    tolerance_mm: float = TOLERANCE_MM
    order: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scored:
    """One metric: its table, its errors, and how its report reads."""

    metric: str
    mode: str
    table: DataFrame
    errors: DataFrame
    title: str
    source: C.Metric


class Scores(list):
    """What was scored, and the rows and sums that all of it comes from."""

    def __init__(self, wide: DataFrame, sums: DataFrame) -> None:
        super().__init__()
        self.wide, self.sums = wide, sums


def score_all(gt: DataFrame, formatted: DataFrame, options: Options = Options(), by: tuple[str, ...] = BY, names: DataFrame | None = None) -> Scores:
    """Every metric (of ``options.metrics``, if told) whose columns the ground truth has. ``names`` are models and prompts
    that are scored even where none of their rows is left."""
    metrics = C.metrics_for(gt, options.metrics)
    if not metrics:
        return Scores(formatted.limit(0), formatted.limit(0))
    known = formatted.select(*by) if names is None else formatted.select(*by).unionByName(names.select(*by))
    found = C.gathered_all(formatted, metrics, by, options.order)
    wide = C.wide_rows(gt, found, known if by else None, metrics, by, options.ignore_all_false, options.tolerance_mm)
    out = Scores(wide, C.tallies(wide, metrics, by))
    for m in metrics:
        for mode in m.modes if options.all_modes else m.modes[:1]:
            out.append(Scored(m.name, mode, C.metric_table(out.sums, m, mode, by), _errors(wide, m, mode, by), _title(m, mode), m))
    return out


def _errors(wide: DataFrame, m: C.Metric, mode: str, by: tuple[str, ...]) -> DataFrame:
    rows = C.rows_of(wide, m, by)
    if m.form != "presence":
        return S.error_rows(rows, by, mode == "flexible")
    extra = wide.filter(F.array_contains("extra", m.name)).select(*by, F.lit("extra").alias("section"), "ID")
    return S.presence_errors(rows, by).unionByName(extra)


def _title(m: C.Metric, mode: str) -> str:
    return f"{m.kind} {m.form} errors" + (f" ({mode})" if mode else "")


def summarize(scored: list[Scored]) -> DataFrame:
    """(metric, ord, model, prompt_id, value) of the summary's rows."""
    return reduce(DataFrame.unionByName, (long_metrics(s.table, s.metric, s.mode) for s in scored))


def write_all(scored: Scores, root: str, ignore_all_false: bool, order: DataFrame | None = None, report_bytes: int = REPORT_BYTES) -> None:
    """A metrics file and an error report for each model, prompt, metric and mode, and a summary a prompt: two jobs whatever
    their number, one for all sums, one in which tasks sort and write the lines of all reports. The driver sees a row a model
    and prompt, and puts a report together out of its files, as one file up to ``report_bytes``. ``order`` is (ID, at):
    errors stand in the order of the ground truth, IDs that it doesn't have last."""
    if not scored:
        return
    spark = scored.wide.sparkSession
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    scored.wide.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cell = lambda s: F.when(C.counted(s.source), F.struct(*C.metric_fields(s.source, s.mode))).alias(f"{s.metric}|{s.mode}")
        tables = scored.sums.select(*BY, *map(cell, scored)).collect()
        files = _write_lines(scored, staged, order)
        values: list[tuple] = []
        for row in tables:
            model, prompt = row["model"], row["prompt_id"]
            for s in scored:
                if row[f"{s.metric}|{s.mode}"] is None:
                    continue
                own = row[f"{s.metric}|{s.mode}"].asDict()
                table_path, text_path = metric_paths(root, prompt, model, s.metric, s.mode, ignore_all_false)
                write_rows(spark, table_path, list(own), [list(own.values())])
                columns = "\t".join(C.error_columns(s.source, s.mode))
                pieces = [store.Text("\n".join([s.title, " ".join(f"{k}={v}" for k, v in own.items())]) + "\n")]
                for section, parts in sorted(files.get((model, prompt, s.metric, s.mode), {}).items()):
                    pieces += [store.Text(f"\nErrors - {section}\n{columns}\n"), *parts]
                store.join_files(spark, text_path, pieces, report_bytes)
                values.extend((name, model, prompt, str(own[column])) for name, folder, mode, column in SUMMARY_METRICS if (folder, mode) == (s.metric, s.mode) and own.get(column) is not None)
    finally:
        scored.wide.unpersist()
        store.delete(spark, staged)
    for prompt in sorted({v[2] for v in values}):
        models = sorted({v[1] for v in values if v[2] == prompt})
        cells = {(v[0], v[1]): v[3] for v in values if v[2] == prompt}
        write_rows(spark, f"{root}/prompt{prompt}/summary_metrics_prompt{prompt}.csv", ["metric", *models], [[m[0], *(cells.get((m[0], x), NOT_AVAILABLE) for x in models)] for m in SUMMARY_METRICS])


def _write_lines(scored: Scores, staged: str, order: DataFrame | None) -> dict[tuple, dict[str, list[str]]]:
    """Files of error lines in order, by (model, prompt, metric, mode) and section. The lines are range-sorted, so a large
    report is the work of many tasks."""
    errors = C.error_lines(scored.wide, [(s.source, s.mode) for s in scored], BY)
    errors = errors.withColumn("at", F.lit(None).cast("long")) if order is None else errors.join(order, "ID", "left")
    folders = [*BY, "metric", "mode", "section"]
    keys = {f"_{c}": F.concat(F.lit("k"), F.col(c)) for c in folders}  # an empty name would be no folder
    lines = errors.filter(F.col("model").isNotNull() & F.col("prompt_id").isNotNull()).select(*(v.alias(k) for k, v in keys.items()), "at", "ID", "line")
    lines = lines.orderBy(*keys, F.col("at").asc_nulls_last(), "ID", "line").select(*keys, "line")
    lines.write.partitionBy(*keys).text(staged)
    spark = scored.wide.sparkSession
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    out: dict[tuple, dict[str, list[str]]] = {}

    def walk(path: str, named: list[str]) -> None:
        if len(named) == len(folders):
            parts = [p for p, name, _ in store.children(spark, path) if name.startswith("part-")]
            out.setdefault(tuple(named[:4]), {})[named[4]] = parts
            return
        for child, name, is_folder in store.children(spark, path):
            if is_folder and "=" in name:
                walk(child, [*named, unescaped(name.partition("=")[2])[1:]])

    walk(staged, [])
    return out


def ground_truth_order(gt: DataFrame) -> DataFrame:
    """(ID, at) by the rows' place in their file."""
    return gt.select(F.col("ID").cast("string").alias("ID"), F.monotonically_increasing_id().alias("at")).groupBy("ID").agg(F.min("at").alias("at"))
