"""Readers: folders of report JSON, result tables, reports to be sent to a model, image listings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import feather
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from ..functions.exprs import id_of_file, model_of, na_normalize, plain_path, prompt_id_of, table_file

#: Headers of a table's files that are read at a time.
HEADER_READERS = 16
#: Rows of a workbook that a task hands over at a time.
ROWS_A_BATCH = 1000


def read_report_json(spark: SparkSession, folder: str, skipped: Observation | None = None) -> DataFrame:
    """(ID, file, value) of each ``*.json`` of a folder that holds an object. Others (malformed, or another root) are skipped.
    ``skipped`` observes (files, skipped) in the pass that reads them; ``count_skipped`` counts in a pass of its own."""
    files = _json_texts(spark, folder).withColumn("_object", _is_object("value"))
    if skipped is not None:
        files = files.observe(skipped, F.count("*").alias("files"), F.count_if(~F.col("_object")).alias("skipped"))
    return files.filter("_object").select(id_of_file(F.col("file")).alias("ID"), "file", "value")


def count_skipped(spark: SparkSession, folder: str) -> int:
    return _json_texts(spark, folder).filter(~_is_object("value")).count()


def _json_texts(spark: SparkSession, folder: str) -> DataFrame:
    # as an argument: the reader's own default would undo the option
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_name").alias("file"), "value")


def _is_object(column: str) -> F.Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(column)), F.lit("OBJECT")), F.lit(False))


def table_paths(spark: SparkSession, path: str) -> list[str]:
    """A table's own path, or the tables (``*.csv``, files or folders of part files) of a folder, in order; those of its
    prompt folders where it has none itself. A folder without any is an error."""
    if path.rstrip("/").lower().endswith(".csv") or not store.is_folder(spark, path):
        return [path]
    inside = store.children(spark, path)
    if any(name.startswith(("part-", "prompt_id=")) for _, name, _ in inside):
        return [path]  # the part files, or partitions, of one table
    tables = [full for full, name, _ in inside if name.lower().endswith(".csv")]
    for folder in () if tables else (full for full, name, is_folder in inside if is_folder and re.fullmatch(r"prompt\w+", name)):
        tables += table_paths(spark, folder)
    if not tables:
        raise ValueError(f"no CSV files in {path}")
    return tables


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table (or a folder of them) as strings, with quoted line ends, missing-value tokens as null, and lineage.

    Without a schema the columns are those of the header, all strings: ids keep their zeros; tables with other columns are
    brought together by name. Adds file, and prompt_id and model by the path where the table has no such columns; these,
    and any row order, are what later stages group by, so all files of a folder are one job.
    """

    def one(paths: list[str]) -> DataFrame:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", "*.[cC][sS][vV]")
        if schema is not None:
            reader = reader.schema(schema)
        raw = reader.option("inferSchema", False).csv(paths)
        file = table_file(plain_path(F.col("_metadata.file_path")))
        found = {"file": file, "prompt_id": prompt_id_of(file), "model": model_of(file)}
        return na_normalize(raw).withColumns({k: v for k, v in found.items() if k == "file" or k not in raw.columns})

    # files are read by place of column, so only those of one header are read together: a scan a header, whatever the files
    paths, headers = table_paths(spark, path), {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        firsts = [""] * len(paths) if schema is not None else list(pool.map(lambda p: _header(spark, p), paths))
    for p, header in zip(paths, firsts, strict=True):
        headers.setdefault(header, []).append(p)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, headers.values()))


def _header(spark: SparkSession, path: str) -> str:
    """The header of a table: the first record of its first file that has one, of which nothing else is read."""
    if not store.is_folder(spark, path):
        return store.first_record(spark, path)
    inside = [x for x in store.children(spark, path) if not x[1].startswith(("_", "."))]
    found = (_header(spark, full) for full, name, folder in inside if folder or name.lower().endswith(".csv"))
    return next(filter(None, found), "")


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports to be sent, by suffix: CSV, XLSX or Feather; rows without ID or Report are dropped."""
    suffix = path.rpartition(".")[2].lower()
    if suffix == "csv":
        table = read_table(spark, path).drop("file", "prompt_id", "model")
    elif suffix == "xlsx":
        table = na_normalize(read_sheet(spark, path))
    elif suffix == "feather":
        table = read_feather(spark, path)
    else:
        raise ValueError(f"unsupported file type: {path}")
    return table.dropna(subset=["ID", "Report"])


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook (or of each of a folder's that share a header), all texts, by a task a workbook; the
    driver sees the header alone."""
    cells = "cells array<string>"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path).select("content")
    header = files.mapInArrow(lambda batches: _sheets(batches, stop=1), cells).first()
    names = [str(name) for name in header["cells"]] if header else []
    rows = files.mapInArrow(lambda batches: _sheets(batches, start=1), cells)
    return rows.select(*(F.get("cells", F.lit(k)).alias(name) for k, name in enumerate(names)))


def _sheets(batches: Iterator[pa.RecordBatch], start: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = islice(sheet_rows(content.as_py()), start, stop)
            while some := list(islice(rows, ROWS_A_BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.string()))], ["cells"])


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet as texts, a row at a time; a sheet without any is an error."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    texts = lambda node: "".join(t.text or "" for t in node.iter(f"{space}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names, shared = set(book.namelist()), []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        if not sheets:
            raise ValueError("a workbook without a sheet")
        if "xl/sharedStrings.xml" in names:
            shared = [texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        for _, row in ElementTree.iterparse(book.open(sheets[0])):
            if row.tag != f"{space}row":
                continue
            cells: list[str | None] = []
            for cell in row.iter(f"{space}c"):
                at = reduce(lambda n, c: 26 * n + ord(c) - 64, re.match(r"[A-Z]*", cell.get("r", ""))[0], 0) - 1
                cells += [None] * (at - len(cells))  # empty cells are left out
                kind, value = cell.get("t"), cell.findtext(f"{space}v")
                if kind == "inlineStr":
                    value = texts(cell)
                elif kind == "s":
                    value = shared[int(value)]
                elif kind == "b":
                    value = "True" if value == "1" else "False"
                cells.append(value)
            row.clear()
            yield cells


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """A Feather file (or a folder's, of one schema), by a task a file and a record batch at a time; the driver sees the schema
    alone. Dictionary columns become their values, times have microseconds, columns of nulls are texts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[fF][eE][aA][tT][hH][eE][rR]").load(path).select("content")
    first = files.mapInArrow(_feather_schemas, "schema binary").first()
    if first is None:
        raise ValueError(f"no Feather files in {path}")
    schema = pa.ipc.read_schema(pa.py_buffer(bytes(first["schema"])))
    return files.mapInArrow(_feather_rows, spark.createDataFrame(schema.empty_table()).schema)


def _feather_schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            schema = _plain(_feather_batches(content)[0])
            yield pa.RecordBatch.from_arrays([pa.array([schema.serialize().to_pybytes()], pa.binary())], ["schema"])


def _feather_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            for found in _feather_batches(content)[1]:
                yield from pa.Table.from_batches([found]).cast(_plain(found.schema), safe=False).to_batches()


def _feather_batches(content: pa.BinaryScalar) -> tuple[pa.Schema, Iterator[pa.RecordBatch]]:
    data = content.as_buffer()
    if data.slice(0, 6).to_pybytes() == b"ARROW1":
        reader = pa.ipc.open_file(data)
        return reader.schema, map(reader.get_batch, range(reader.num_record_batches))
    table = feather.read_table(pa.BufferReader(data))  # the format's first version
    return table.schema, iter(table.to_batches())


def _plain(schema: pa.Schema) -> pa.Schema:
    def kind(t: pa.DataType) -> pa.DataType:
        if pa.types.is_dictionary(t):
            return kind(t.value_type)
        if pa.types.is_timestamp(t):
            return pa.timestamp("us", t.tz)
        return pa.string() if pa.types.is_null(t) or pa.types.is_large_string(t) else t

    return pa.schema([pa.field(f.name, kind(f.type)) for f in schema])


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the ``*.nii.gz`` files of a folder, or of one such file; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii.gz").load(path).select("path", "length")
    if found.isEmpty():
        raise ValueError(f"no *.nii.gz files in {path}")
    return found.orderBy("path")
