"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Rows are told apart by a row number that is written with
them, not by doc_id, so null, repeated and equal ids are safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm import decontam, langid, secrets, sentpiece, simhash
from reportloom.llm.common import discard, table, written
from reportloom.llm.queries import tokenizer_path
from reportloom.session import importable


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a row number, and its column's name, which no other column has."""
    name = _free(docs, "_row")
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _free(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    return next(x for x in (f"_pipeline{name}{'_' * k}" for k in range(len(taken) + 1)) if x not in taken)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, trained on the labelled documents: what it rejects goes. A null text, and one without a letter, is
    rejected; where no document is labelled, all are. Equal rows share a fate; an empty table gives none."""
    importable(spark)
    names = tuple(_free(docs, x) for x in ("_lang", "_score", "_rejected"))
    return langid.predict(docs, langid.train(docs), names=names).filter(~F.col(names[2])).select(_all(docs))


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of near duplicates the document with the smallest doc_id stays (null ids last; of
    equal ids one row). Null and empty texts are near duplicates of each other; an empty table gives none."""
    importable(spark)
    rows, row = _numbered(docs)
    groups = simhash.near_duplicates(rows, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    first = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("x"))
    kept = written(first.select(F.col(f"x.{row}").alias(row)), "kept")
    # one plan at every size: what stays grows with the table, so it is never broadcast
    return rows.join(kept.hint("merge"), row, "left_semi").select(_all(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go. Null and empty texts stay, and with an empty benchmark all do;
    equal rows share a fate."""
    importable(spark)
    rows, row = _numbered(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), doc_id=row)
    bad = written(found.filter("contaminated").select(F.col("doc_id").alias(row)), "contaminated")
    return rows.join(bad, row, "left_anti").select(_all(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret is replaced by a mark; all documents stay. A null text stays null."""
    importable(spark)
    return secrets.redacted(docs, secrets.train_field(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: (doc_id, ids, n_tokens) of every row; no ids for null and empty texts."""
    importable(spark)
    return sentpiece.encode(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
