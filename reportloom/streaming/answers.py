"""A stream of answers to lesion rows: the parser holds no state, so a file source and an append are all it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.answers import parse_answers


def stream_lesions(spark: SparkSession, folder: str, prompt_id: int, schema: str = "ID string, Report string, `DNN Answer` string") -> DataFrame:
    """Lesion rows of Parquet answers as they arrive in a folder."""
    return parse_answers(spark.readStream.schema(schema).parquet(folder), prompt_id)


def append_lesions(rows: DataFrame, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends exactly once: the file sink keeps a log of committed files."""
    writer = rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
