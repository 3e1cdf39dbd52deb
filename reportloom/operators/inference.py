"""Model calls whose answers survive failures: a ledger of requests, asked in waves by bounded pools of calls.

A request is a report's ID and text, under a prompt and a model, whose ledger is one Parquet folder. Reports that the ledger has an
answer to aren't asked. The others are dealt once into waves; each wave is a job that appends to the ledger when it is complete, so
what a dead driver or a lost executor costs is the wave in flight at most, and a task that runs again appends nothing twice (a
job commits each task's rows once, and ``answered_rows`` reads one answer a request). Inside a task a few calls run at once;
a call that fails is tried again after growing waits. A report whose calls all fail gets a row with the error, never an
exception, so a failing endpoint loses no answer that was given; a task that sees several such reports in a row stops asking.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.error import HTTPError

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import require
from ..sources import store
from .answers import PROMPTS, AnswerProvider, Prompt, messages

ANSWER, ERROR, TRIES, DIGEST = "DNN Answer", "_error", "_tries", "_digest"
#: Replies that a later call may not get.
PASSING = (408, 425, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Retry:
    """How often a call is made, the seconds before the second, what each wait is times the one before, and the longest; and
    how many reports in a row a task sees fail before it stops asking."""

    attempts: int = 5
    first: float = 1.0
    factor: float = 2.0
    longest: float = 60.0
    give_up: int = 3

    def wait(self, attempt: int, error: Exception) -> float:
        told = getattr(getattr(error, "headers", None), "get", lambda _: None)("Retry-After")
        if told and str(told).isdigit():
            return min(float(told), self.longest)
        return min(self.first * self.factor**attempt, self.longest) * random.uniform(0.5, 1.0)


class Unanswered(RuntimeError):
    """Some reports have no answer; those that have are in the ledger."""


def passing(error: Exception) -> bool:
    """Whether a call that failed so may succeed later."""
    if isinstance(error, HTTPError):
        return error.code in PASSING
    return isinstance(error, OSError)  # URL errors, time-outs and broken connections among them


class Caller:
    """Calls of one task: a bounded pool, retries, and an end to asking."""

    def __init__(self, answer: AnswerProvider, calls: int, retry: Retry, sleep: Callable[[float], None] = time.sleep):
        self.answer, self.retry, self.sleep = answer, retry, sleep
        self.pool = ThreadPoolExecutor(calls)
        self.failed, self.lock = 0, threading.Lock()

    def one(self, conversation: list[dict[str, str]]) -> tuple[str | None, str | None, int]:
        """(answer, error, calls made) of a conversation."""
        error: Exception | None = None
        for attempt in range(self.retry.attempts):
            if self.failed >= self.retry.give_up:
                return None, "not asked: calls before it failed" if error is None else repr(error), attempt
            try:
                found = self.answer(conversation)
            except Exception as e:
                error = e
                if not passing(e):
                    break
                if attempt + 1 < self.retry.attempts:
                    self.sleep(self.retry.wait(attempt, e))
            else:
                with self.lock:
                    self.failed = 0
                return found, None, attempt + 1
        with self.lock:
            self.failed += 1
        return None, repr(error), attempt + 1

    def all(self, conversations: list[list[dict[str, str]]]) -> list[tuple[str | None, str | None, int]]:
        return list(self.pool.map(self.one, conversations))


def _asked(rows: DataFrame, prompt_id: int, provider: Callable[[], AnswerProvider], prompts: dict[int, Prompt], calls: int, retry: Retry) -> DataFrame:
    kept = rows.columns
    asked = rows.withColumn("_ask", messages(F.col("Report").cast("string"), prompt_id, prompts))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).add(ANSWER, "string").add(ERROR, "string").add(TRIES, "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = None
        for batch in batches:
            caller = caller or Caller(provider(), calls, retry)
            step = 16 * calls
            for at in range(0, batch.num_rows, step):  # in small steps, so that a task's memory is bounded
                part = batch.slice(at, step)
                found = caller.all(part.column("_ask").to_pylist())
                columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)]
                yield pa.record_batch([*(part.column(c) for c in kept), *columns], names=[*kept, ANSWER, ERROR, TRIES])

    return asked.mapInArrow(run, schema)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """A ledger's rows, with and without an answer; None before its first wave."""
    if not store.exists(spark, ledger) or not any(name.startswith("part-") for _, name, _ in store.children(spark, ledger)):
        return None
    return spark.read.option("mergeSchema", True).parquet(ledger)


def answered_rows(ledger: DataFrame) -> DataFrame:
    """The reports of a ledger with their answers, one a request."""
    rows = ledger.filter(F.col(ERROR).isNull())
    kept = [c for c in rows.columns if c not in ("ID", DIGEST, ERROR, TRIES)]
    first = rows.groupBy("ID", DIGEST).agg(F.min(F.struct(ANSWER, *(c for c in kept if c != ANSWER))).alias("_r"))
    return first.select("ID", *(F.col(f"_r.`{c}`").alias(c) for c in kept))


def ask(reports: DataFrame, prompt_id: int, provider: Callable[[], AnswerProvider], ledger: str, prompts: dict[int, Prompt] = PROMPTS, calls: int = 4, tasks: int | None = None, wave: int = 10_000, retry: Retry = Retry()) -> DataFrame:
    """Asks for what the ledger (a folder, of one prompt and model) lacks, and returns all its answers. Raises ``Unanswered``
    where reports are left without, after their wave is in the ledger. A null ID or report is not asked."""
    require(reports, "ID", "Report")
    spark = reports.sparkSession
    reports = reports.filter(F.col("ID").isNotNull() & F.col("Report").isNotNull()).withColumn(DIGEST, F.sha2(F.col("Report").cast("string"), 256))
    pending = reports
    if (before := read_ledger(spark, ledger)) is not None:
        held = before.filter(F.col(ERROR).isNull()).select("ID", DIGEST).distinct()
        pending = reports.join(held, ["ID", DIGEST], "left_anti").select(reports.columns)
    pending = pending.dropDuplicates(["ID", DIGEST])
    dealt = store.beside(ledger, "pending")
    try:
        waves = max(1, -(-pending.count() // wave))
        pending.withColumn("_wave", F.pmod(F.xxhash64("ID", DIGEST), F.lit(waves))).write.partitionBy("_wave").parquet(dealt)
        todo = spark.read.schema(pending.withColumn("_wave", F.lit(0)).schema).parquet(dealt)
        failed = 0
        for k in range(waves):
            rows = todo.filter(F.col("_wave") == k).drop("_wave")
            rows = rows.repartition(tasks or spark.sparkContext.defaultParallelism)
            before = _failures(spark, ledger)
            _asked(rows, prompt_id, provider, prompts, calls, retry).write.mode("append").parquet(ledger)
            failed = _failures(spark, ledger) - before
            if failed:
                break
    finally:
        store.delete(spark, dealt)
    made = read_ledger(spark, ledger)
    left = pending.join(made.filter(F.col(ERROR).isNull()).select("ID", DIGEST), ["ID", DIGEST], "left_anti").count() if failed else 0
    if left:
        last = made.filter(F.col(ERROR).isNotNull() & (F.col(TRIES) > 0)).select(ERROR).first()
        raise Unanswered(f"{left} reports without an answer: {last[0] if last else 'not asked'}")
    return answered_rows(made)


def _failures(spark: SparkSession, ledger: str) -> int:
    rows = read_ledger(spark, ledger)
    return 0 if rows is None else rows.filter(F.col(ERROR).isNotNull()).count()
