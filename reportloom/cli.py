"""Command line: ``python -m reportloom.cli <command> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import answers as A
from .operators.builders import build_booleans, build_measurements, build_reports, ground_truth
from .operators.inference import Retry, Unanswered, answered_rows, ask, read_ledger
from .operators.formatting import drop_bulky, format_rows
from .plans.scoring import Options, ground_truth_order, score_all, write_all
from .plans.summaries import summarize_folder, summarize_prompts
from .session import importable
from .sources import store
from .sources.paths import FORMATTED, POSTPROCESSED
from .sources.readers import load_reports, read_report_json, read_table
from .sources.writers import write_results, write_table

STEPS = ("keep", "ich", "ivh", "phe", "group")
METRICS = ("ivh_presence", "phe_presence", "phe_severity", "ich_location", "ivh_location", "ich_size")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="reportloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("reports", "booleans", "measurements"):
        p = sub.add_parser(name, help=f"report JSON folder -> {name} table")
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
    p = sub.add_parser("ground-truth", help="checklist and measurement tables -> ground truth")
    p.add_argument("--booleans")
    p.add_argument("--measurements")
    p.add_argument("--output", required=True)
    p.add_argument("--all-ich-true", action="store_true")
    p = sub.add_parser("infer", help="reports -> raw lesion rows, through a chat endpoint")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--base-url", required=True)
    p.add_argument("--model", help="the name that results go by; the endpoint's first model if not told")
    p.add_argument("--prompt-id", type=int, default=1)
    p.add_argument("--prompts", help="a JSON file of prompts")
    p.add_argument("--calls", type=int, default=4, help="calls that a task makes at once")
    p.add_argument("--tasks", type=int, help="tasks that call at once; all cores by default")
    p.add_argument("--wave", type=int, default=10_000, help="reports whose answers are committed together")
    p.add_argument("--attempts", type=int, default=Retry.attempts, help="calls for a report before it is left")
    p.add_argument("--wait", type=float, default=Retry.first, help="seconds before a second call; each wait is twice the one before")
    p.add_argument("--restart", action="store_true", help="forget this model's answers to this prompt")
    for name in ("postprocess", "format", "score"):
        p = sub.add_parser(name)
        p.add_argument("--input", required=True, help="a table, a folder of them, or a folder of prompt folders")
        p.add_argument("--output", required=True)
        if name == "format":
            p.add_argument("--steps", default=",".join(STEPS), help="those of the steps to take, between commas (all by default)")
        if name == "score":
            p.add_argument("--ground-truth", required=True)
            p.add_argument("--ignore-all-false", action="store_true")
            p.add_argument("--all-modes", action="store_true")
            p.add_argument("--tolerance-mm", type=float, default=Options.tolerance_mm)
            p.add_argument("--metrics", default="", help=f"those of {', '.join(METRICS)}, between commas (all by default)")
    p = sub.add_parser("summarize", help="metrics files of a prompt -> metric by model")
    p.add_argument("--metrics-dir", required=True)
    p.add_argument("--output")
    p = sub.add_parser("prompt-summary", help="summaries of all prompts -> metric by prompt, a table a model")
    p.add_argument("--metrics-root", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--model")
    p.add_argument("--all-models", action="store_true")
    return top


def chosen(text: str, known: tuple[str, ...]) -> tuple[str, ...]:
    out = tuple(filter(None, text.split(",")))
    if odd := set(out) - set(known):
        raise ValueError(f"not one of {known}: {sorted(odd)}")
    return out


def infer(spark: SparkSession, args: argparse.Namespace) -> None:
    """Asks what the ledger of this prompt and model lacks, and writes the rows of all its answers, also where some are missing."""
    prompts = A.load_prompts(spark, args.prompts) if args.prompts else A.PROMPTS
    model = args.model or A.HttpProvider(args.base_url).model()
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    ledger = f"{args.output}/answers/prompt_id={args.prompt_id}/model={escaped(model)}"
    if args.restart:
        store.delete(spark, ledger)
    url, lost = args.base_url, None
    try:
        rows = ask(load_reports(spark, args.input), args.prompt_id, lambda: A.HttpProvider(url), ledger, prompts, args.calls, args.tasks, args.wave, Retry(args.attempts, args.wait))
    except Unanswered as e:
        rows, lost = answered_rows(read_ledger(spark, ledger)), e
    rows = A.parse_answers(rows, args.prompt_id, prompts)
    write_results(rows.withColumns({"prompt_id": F.lit(str(args.prompt_id)), "model": F.lit(model)}), f"{args.output}/raw", "")
    if lost is not None:
        raise lost


def lesions(rows: DataFrame, **steps: bool) -> DataFrame:
    """Formatted rows; a table that has a count is formatted already."""
    rows = rows.drop("file")
    return rows if "count" in rows.columns else format_rows(rows, ["Lesion Index"], by=("ID", "type", "prompt_id", "model"), **steps)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = importable(SparkSession.builder.appName("reportloom").getOrCreate())
    if args.command in ("reports", "booleans", "measurements"):
        build = {"reports": build_reports, "booleans": build_booleans, "measurements": build_measurements}[args.command]
        seen = Observation("report files")
        table = build(read_report_json(spark, args.input, seen))
        index = [F.expr("try_cast(measurement_index AS INT)")] if args.command == "measurements" else []
        write_table(table.orderBy("ID", *index), args.output)
        print(f"{seen.get['files']} files read, {seen.get['skipped']} skipped")
    elif args.command == "ground-truth":
        tables = [read_table(spark, path).drop("file", "prompt_id", "model") if path else None for path in (args.booleans, args.measurements)]
        write_table(ground_truth(*tables, args.all_ich_true).orderBy("ID"), args.output)
    elif args.command == "infer":
        infer(spark, args)
    elif args.command == "postprocess":
        write_results(drop_bulky(read_table(spark, args.input)).drop("file"), args.output, POSTPROCESSED)
    elif args.command == "format":
        steps = chosen(args.steps, STEPS)
        write_results(lesions(read_table(spark, args.input), **{s: s in steps for s in STEPS}), args.output, FORMATTED)
    elif args.command == "score":
        raw = read_table(spark, args.input)
        gt = read_table(spark, args.ground_truth).drop("file", "prompt_id", "model")
        options = Options(args.ignore_all_false, args.all_modes, args.tolerance_mm, metrics=chosen(args.metrics, METRICS))
        rows = lesions(raw).cache()
        write_all(score_all(gt, rows, options, names=raw.select("model", "prompt_id")), args.output, args.ignore_all_false, ground_truth_order(gt))
        rows.unpersist()
    elif args.command == "summarize":
        print(summarize_folder(spark, args.metrics_dir, args.output))
    else:
        print(*summarize_prompts(spark, args.metrics_root, args.output_dir, args.model, args.all_models), sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
