"""Metrics that follow a stream of answers: each arrival adds its part, nothing is scored again.

An answer to (model, prompt, ID) arrives whole, as one row, so its ground-truth rows can be tallied as soon as it is there. A
batch writes two small rows a model and prompt: the tallies of the rows it answers, and what the same rows count for while they
have no answer, to be taken away. ``metrics_so_far`` adds all of them to the tallies of a ground truth without any answer.

Exactly once: a batch's tallies are a folder under its number, so a batch that runs again replaces its own. Of repeated answers
to one request the first counts; the stream keeps the requests that it has seen as state, spread by key over the store. Null
names or IDs are no answers. IDs that the ground truth lacks change no metric. The order of arrival, and how arrivals fall
into batches, don't matter; sums of shares may differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import require
from ..operators import scorecard as C
from ..operators.answers import PROMPTS, Prompt, parse_answers
from ..operators.formatting import format_rows
from ..plans.scoring import BY, Options
from ..sources import store

Truth = Callable[[SparkSession], DataFrame]
ANSWERS = "ID string, model string, prompt_id string, `DNN Answer` string"


def stream_answers(spark: SparkSession, folder: str, schema: str = ANSWERS, files: int | None = None) -> DataFrame:
    """Answers of all models and prompts as Parquet files arrive in a folder, each request's first one."""
    reader = spark.readStream.schema(schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    found = require(reader.parquet(folder), *BY, "ID").dropna(subset=[*BY, "ID"])
    return found.dropDuplicates([*BY, "ID"])


def _without_answers(spark: SparkSession, metrics: list[C.Metric], order: tuple[str, ...] = ()) -> DataFrame:
    rows = spark.createDataFrame([], "ID string, type string, size string, structure string, model string, prompt_id string")
    return C.gathered_all(rows, metrics, BY, order)


def batch_tallies(answers: DataFrame, gt: DataFrame, options: Options = Options(), prompts: dict[int, Prompt] = PROMPTS) -> DataFrame:
    """(model, prompt_id, sign, a struct of sums a metric) of a batch of answers."""
    metrics, spark = C.metrics_for(gt, options.metrics), answers.sparkSession
    here = {r[0] for r in answers.select("prompt_id").distinct().collect()}  # prompts are few, and each has fields of its own
    lesions = [parse_answers(answers.filter(F.col("prompt_id") == str(k)), k, prompts) for k in sorted(prompts) if str(k) in here]
    lesions = lesions or [parse_answers(answers, min(prompts), prompts).limit(0)]
    needed = ["ID", *BY, "Lesion Index", "type", "certainty", "size", "structure", "lateralization"]
    told = lambda rows: rows.select(*(c if c in rows.columns else F.lit("U").alias(c) for c in needed))
    rows = format_rows(reduce(DataFrame.unionByName, map(told, lesions)), ["Lesion Index"], by=("ID", "type", *BY))
    asked = answers.select(*BY, F.col("ID").cast("string").alias("ID")).distinct()
    # the ID's other rows tell whether one of them counts, so they come along whole
    own = gt.withColumn("ID", F.col("ID").cast("string")).join(asked.select("ID").distinct(), "ID", "left_semi")

    def part(found: DataFrame, sign: int) -> DataFrame:
        wide = C.wide_rows(own, found, asked, metrics, BY, options.ignore_all_false, options.tolerance_mm)
        return C.tallies(wide.join(asked, [*BY, "ID"], "left_semi"), metrics, BY).withColumn("sign", F.lit(sign))

    return part(C.gathered_all(rows, metrics, BY), 1).unionByName(part(_without_answers(spark, metrics), -1))


def follow(answers: DataFrame, truth: Truth, folder: str, checkpoint: str, options: Options = Options(), prompts: dict[int, Prompt] = PROMPTS, once: bool = True) -> StreamingQuery:
    """Tallies of a stream of answers under ``folder``. ``truth`` gives the ground truth to the session of a batch."""

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            sums = batch_tallies(batch, truth(batch.sparkSession), options, prompts)
            sums.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")  # two rows a model and prompt
        finally:
            batch.unpersist()

    writer = answers.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def metrics_so_far(spark: SparkSession, folder: str, gt: DataFrame, names: DataFrame, options: Options = Options()) -> dict[tuple[str, str], DataFrame]:
    """Tables by (metric, mode) of ``names`` (models and prompts) after the batches that are in the folder."""
    metrics = C.metrics_for(gt, options.metrics)
    base = C.wide_rows(gt, _without_answers(spark, metrics), names, metrics, BY, options.ignore_all_false, options.tolerance_mm)
    parts = C.tallies(base, metrics, BY).withColumn("sign", F.lit(1))
    if store.exists(spark, folder) and any(name.startswith("batch=") for _, name, _ in store.children(spark, folder)):
        done = spark.read.parquet(folder).drop("batch").join(names.select(*BY).distinct(), [*BY], "left_semi")
        parts = parts.unionByName(done)
    sums = C.merged(parts, metrics, BY)
    modes = lambda m: m.modes if options.all_modes else m.modes[:1]
    return {(m.name, mode): C.metric_table(sums, m, mode, BY) for m in metrics for mode in modes(m)}
