"""Files by any URI that Spark reaches: small texts published at once, and folders that replace others whole."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path). A local one without the checksum files that its layer adds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    where = store.makeQualified(where)
    return (store.getRawFileSystem() if store.getScheme() == "file" else store), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.getFileStatus(where).isDirectory()


def children(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(path, name, whether a folder) of what a folder holds, by name."""
    store, where = _at(spark, path)
    return sorted((x.getPath().toString(), x.getPath().getName(), x.isDirectory()) for x in store.listStatus(where))


def delete(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def beside(path: str, kind: str) -> str:
    """A new path next to this one, by a name that readers pass over."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_{kind}-{name}-{uuid.uuid4().hex}"


def read_text(spark: SparkSession, path: str) -> str:
    store, where = _at(spark, path)
    stream = store.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_record(spark: SparkSession, path: str) -> str:
    """The first record of a CSV file, which may hold quoted line ends; nothing else is read."""
    store, where = _at(spark, path)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(store.open(where), "UTF-8"))
    try:
        lines: list[str] = []
        while (line := reader.readLine()) is not None:
            lines.append(line)
            if sum(x.count('"') for x in lines) % 2 == 0:
                break
        return "\n".join(lines).removeprefix("﻿")
    finally:
        reader.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Publishes a text under its path in one step: readers see the old file or the new one."""
    store, target = _at(spark, path)
    if store.exists(target) and store.getFileStatus(target).isDirectory():
        raise IsADirectoryError(path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(beside(target.toString(), "staged"))
    store.mkdirs(target.getParent())
    stream = store.create(hidden, True)
    try:
        try:
            data = text.encode()
            for at in range(0, len(data), 1 << 20):
                stream.write(bytearray(data[at : at + (1 << 20)]))
        finally:
            stream.close()
        _rename_over(spark, store, hidden, target)
    except BaseException:
        store.delete(hidden, False)
        raise


class Text(str):
    """A piece of a file that is given as text, not as the path of one."""


def join_files(spark: SparkSession, path: str, pieces: list[str], most: int) -> None:
    """Publishes texts and files, in order, as one file of up to ``most`` bytes, else as a folder of files whose names are in
    order. Files are moved or copied by the file system's streams; they don't pass through Python."""
    store, target = _at(spark, path)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = sum(len(p.encode()) if isinstance(p, Text) else store.getFileStatus(_at(spark, p)[1]).getLen() for p in pieces)
    staged = beside(target.toString(), "staged")
    hidden = jvm.org.apache.hadoop.fs.Path(staged)
    store.mkdirs(target.getParent())
    try:
        if size > most:
            store.mkdirs(hidden)
            for k, p in enumerate(pieces):
                name = f"{staged}/part-{k:09d}.txt"
                if isinstance(p, Text):
                    write_text(spark, name, p)
                elif not store.rename(_at(spark, p)[1], jvm.org.apache.hadoop.fs.Path(name)):
                    raise OSError(f"can't move {p}")
        else:
            out = store.create(hidden, True)
            try:
                for p in pieces:
                    if isinstance(p, Text):
                        out.write(bytearray(p.encode()))
                        continue
                    part = store.open(_at(spark, p)[1])
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                    finally:
                        part.close()
            finally:
                out.close()
        was_folder = store.exists(target) and store.getFileStatus(target).isDirectory()
        if size > most or was_folder:
            replace_folder(spark, staged, path)
        else:
            _rename_over(spark, store, hidden, target)
    except BaseException:
        store.delete(hidden, True)
        raise


def _rename_over(spark: SparkSession, store, source, target) -> None:
    if target.toUri().getScheme() == "file":  # a POSIX rename replaces
        if not store.rename(source, target):
            raise OSError(f"can't publish {target}")
        return
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)


def replace_folder(spark: SparkSession, staged: str, target: str) -> None:
    """Puts a complete folder in another's place. The old one goes only when the new one is there, and comes back if it can't
    be put there; after a failure between the two, ``recover`` brings it back."""
    store, new = _at(spark, staged)
    _, there = _at(spark, target)
    store.mkdirs(there.getParent())
    recover(spark, target)
    old = None
    if store.exists(there):
        _, old = _at(spark, beside(target, "old"))
        if not store.rename(there, old):
            raise OSError(f"can't move {target} away")
    if not store.rename(new, there):
        if old is not None:
            store.rename(old, there)
        raise OSError(f"can't publish {target}")
    if old is not None:
        store.delete(old, True)


def add_files(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder's files into another."""
    store, new = _at(spark, source)
    _, there = _at(spark, target)
    store.mkdirs(there)
    for part in store.listStatus(new):
        store.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(there, part.getPath().getName()))


def recover(spark: SparkSession, target: str) -> None:
    """Brings back the table that a run moved away when it died before its own was in place."""
    store, there = _at(spark, target)
    parent = there.getParent()
    if store.exists(there) or not store.exists(parent):
        return
    left = [x.getPath() for x in store.listStatus(parent) if re.fullmatch(rf"_old-{re.escape(there.getName())}-[0-9a-f]{{32}}", x.getPath().getName())]
    if left:
        store.rename(left[0], there)
