"""Writers: CSV tables and error reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import require
from . import store
from .paths import results_path


def csv_ready(df: DataFrame) -> DataFrame:
    """Booleans as True and False, as data frame libraries print them."""
    flags = [f.name for f in df.schema.fields if f.dataType.simpleString() == "boolean"]
    return df.withColumns({c: F.initcap(F.col(f"`{c}`").cast("string")) for c in flags})


def write_table(df: DataFrame, path: str, mode: str = "overwrite", **partition: str) -> None:
    """A folder of CSV files, one scan of the plan; ``mode`` append adds to it, as a run without restart does. A table that
    replaces another is written beside it and takes its place when it is complete, so a job that fails leaves the old one."""
    spark = df.sparkSession
    target = store.beside(path, "staged") if mode == "overwrite" else path
    writer = csv_ready(df).write.mode(mode).option("header", True).option("escape", '"')
    if by := partition.get("by"):
        writer = writer.partitionBy(*by.split(","))
    try:
        writer.csv(target)
        if target != path:
            store.replace_folder(spark, target, path)
    finally:
        if target != path:
            store.delete(spark, target)


def write_results(df: DataFrame, root: str, kind: str, mode: str = "overwrite") -> list[str]:
    """A table a prompt and model, each under the name of the convention: one job writes all, then each takes its place."""
    spark = df.sparkSession
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    out = []
    try:
        write_table(df.withColumns({f"_{c}": F.col(c) for c in ("prompt_id", "model")}), staged, "append", by="_prompt_id,_model")
        for prompt, prompt_name, is_folder in store.children(spark, staged):
            for model, model_name, _ in store.children(spark, prompt) if is_folder else ():
                names = [unescaped(x.partition("=")[2]) for x in (prompt_name, model_name)]
                out.append(results_path(root, *names, kind))
                if mode == "overwrite":
                    store.replace_folder(spark, model, out[-1])
                else:
                    store.add_files(spark, model, out[-1])
    finally:
        store.delete(spark, staged)
    return sorted(out)


def only_new(rows: DataFrame, before: DataFrame, key: str = "ID") -> DataFrame:
    """Rows whose key isn't there yet, for runs that are taken up again."""
    return require(rows, key).join(before.select(key).distinct(), key, "left_anti")


def write_rows(spark: SparkSession, path: str, header: list[str], rows: list[list]) -> None:
    """A metrics or summary table of a few rows as one CSV file, published at once."""
    import csv
    import io

    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([header, *rows])
    store.write_text(spark, path, text.getvalue())


def error_report(title: str, counters: dict[str, object], sections: Iterable[tuple[str, str, Iterable, bool]]) -> str:
    """The text of an error report: a title, a line of counters, then (heading, column line, rows, optional) sections in
    the rows' order; optional ones are left out when empty."""
    lines = [title, " ".join(f"{k}={v}" for k, v in counters.items())]
    for heading, columns, rows, optional in sections:
        found = list(rows)
        if optional and not found:
            continue
        lines += ["", heading, *([columns] if columns else []), *("\t".join("" if v is None else str(v) for v in r) for r in found)]
    return "\n".join(lines) + "\n"
