"""Token-ID files: Arrow IPC files of fixed-size-list batches.

Documents are encoded, each followed by an end id, and laid end to end in ascending doc_id order. The stream is cut into
sequences of ``length`` ids; a file is a shard of it with two equal-length lists a row, ``ids`` (unsigned 16 bits where
the vocabulary allows, else 32) and ``mask`` (whether the id is real; only a shard's last row is padded). A file maps
into memory, and row k of a column is a slice at a fixed offset: random access copies nothing. Beside each shard lies
its index, an Arrow IPC file of (doc_id, at, n): where in the shard's stream each document begins and how long it is.

Encoding. A byte-level vocabulary's pieces follow a pattern that never looks back, and ahead from white space alone; so a
text may be cut before white space that follows another character, after a letter that no letter follows, between an ASCII
mark or digit (no apostrophe) and a letter, and after a line's end alone. Texts are cut at such places, told from the bytes of
ASCII, Latin and Cyrillic letters, and each distinct unit is encoded once a worker (its store is bounded in bytes). A text that
spells an added token of the vocabulary (such as <|endoftext|>, which the library reads as that token) is encoded whole, and so
is every text where the vocabulary has another pattern, a normalizer or a limit. All ways are the library's own encoding of the
whole text.

Plan. One shuffle deals documents by ranges of doc_id, then of their text's hash and their row (sampled, so neither a hot
source nor a hot id matters), into as many shards as the table's bytes ask for; each task sorts, encodes
and writes its shard, under a name of its own attempt that the manifest then names: a task that is run again leaves an
unnamed file, never half a one. A shard's place in the stream comes from the shards' totals, a row each. Reading goes
over the manifest, a task a shard. Files are written through pyarrow.fs, to whatever store the folder's URI names.

Defined results: null text is empty and has the end id alone; equal ids are in order of their texts' hashes; a null id comes
first; an empty table writes no shard and reads as none.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, STORE_BYTES, UnitStore, arrow_type, lean, pieces, raw, scratch_path, written

LENGTH = 2048
END = 2
#: Sequences that a record batch has, and bytes of input (as the optimizer counts them) that a shard has.
ROWS = 512
SHARD_BYTES = 64 << 20
#: Bytes of units, about, that a worker remembers.
KEPT_BYTES = 192 << 20

#: What a byte is: a character of its own (a letter, the apostrophe, another mark or digit, white space) or the first of a
#: letter's two bytes (U+00C0 to U+027F, U+0400 to U+047F; two of them are signs).
_LETTER, _APOSTROPHE, _MARK, _BLANK, _LEAD = range(1, 6)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x27] = _APOSTROPHE
_KIND[[*range(0x09, 0x0E), 0x20]] = _BLANK
_KIND[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = _LEAD
_SIGNS = np.array([0xC397, 0xC3B7])
#: White space beyond ASCII, as bytes of UTF-8.
_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the units of texts begin, given the texts' bytes end to end and their n + 1 offsets."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[at[:-1]] = True
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    letter = kind == _LETTER
    lead = np.flatnonzero(kind == _LEAD)
    lead = lead[~np.isin(data[lead].astype(np.int64) << 8 | data[lead + 1], _SIGNS)]
    letter[lead] = letter[lead + 1] = True
    blank, mark = kind == _BLANK, kind == _MARK
    solid = letter | mark | (kind == _APOSTROPHE)
    inner = cut[1:n]
    inner |= letter[:-1] & ~letter[1:] & (data[1:] < 0x80)
    inner |= mark[:-1] & letter[1:]
    inner |= solid[:-1] & blank[1:]
    # other characters than these before white space: few, and looked at one by one
    k = np.flatnonzero(blank[1:] & ~inner & (data[:-1] >= 0x80)) + 1
    two = data[k - 2].astype(np.int64) << 8 | data[k - 1]
    cut[k[~(np.isin(two, _WIDE) | np.isin(data[k - 3].astype(np.int64) << 16 | two, _WIDE))]] = True
    inner |= cut[: n - 1] & (data[:-1] == 0x0A) & solid[1:]
    return np.flatnonzero(cut[:n])


class Encoder:
    """Encodes columns of texts to ids. What it keeps is of the vocabulary's size."""

    _own: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """This process's encoder, kept from task to task."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        top = max(vocabulary.values(), default=0)
        self.kind = np.dtype(np.uint16 if top < 1 << 16 else np.uint32)
        self.spaced = np.zeros(top + 1, bool)
        for token, i in vocabulary.items():
            self.spaced[i] = token.startswith("Ġ")  # the byte-level name of a space
        self.kept: UnitStore | None = None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        said = json.loads(self.tokenizer.to_str())
        way = said["pre_tokenizer"] or {}
        self.cuttable = way.get("type") == "ByteLevel" and way.get("use_regex", True) and not way["add_prefix_space"] and not any(said[x] for x in ("normalizer", "truncation", "padding"))

    def store(self, most: int = 3 * STORE_BYTES) -> UnitStore:
        return UnitStore(self._solve, self.kind, most)

    def kept_store(self) -> UnitStore:
        """This process's store, kept from task to task like the encoder itself, and bounded in bytes."""
        self.kept = self.kept or self.store(KEPT_BYTES)
        return self.kept

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of every unit, end to end, and how many each has. Units of a space and what isn't white space are encoded as one text."""
        ids, sizes = [], np.zeros(len(units), np.int64)

        def alone(some: list[str]) -> list[list[int]]:
            return [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

        for first in range(0, len(units), 1 << 13):
            some = units[first : first + (1 << 13)]
            group = [k for k, u in enumerate(some) if u[0] == " " and (v := u[1:]) and " " not in v and v == v.strip()]
            size = np.zeros(len(some), np.int64)
            found = self.whole("".join([some[k] for k in group])) if group else np.zeros(0, self.kind)
            starts = np.flatnonzero(self.spaced[found])
            if len(starts) != len(group):  # a unit that isn't told from its neighbour by its space
                group, found = [], found[:0]
            else:
                size[group] = np.diff(starts, append=len(found))
            grouped = np.zeros(len(some), bool)
            grouped[group] = True
            rest = np.flatnonzero(~grouped)
            own = alone([some[k] for k in rest.tolist()])
            size[rest] = [len(x) for x in own]
            out = np.zeros(int(size.sum()), self.kind)
            told = np.repeat(grouped, size)
            out[told] = found
            out[~told] = list(itertools.chain.from_iterable(own))
            ids.append(out)
            sizes[first : first + len(some)] = size
        return np.concatenate(ids), sizes, np.zeros(len(units))

    def encode(self, texts: pa.Array, end: int, store: UnitStore) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, end to end; and how many each has."""
        named = np.full(len(texts), not self.cuttable)
        for token in self.added:
            named |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cuttable = pc.if_else(pa.array(named), pa.scalar(""), texts) if named.any() else texts
        data, at = raw(cuttable)
        starts = cuts(data, at)
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pc.dictionary_encode(pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)))
        places = store.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(store.sizes(places))])[np.searchsorted(starts, at)]
        more = [np.append(self.whole(texts[i].as_py()), self.kind.type(end)) for i in np.flatnonzero(named).tolist()]
        added = np.ones(len(texts), np.int64)
        added[named] = [len(x) for x in more]
        values = np.full(int(added.sum()), end, self.kind)
        if more:
            values[np.repeat(named, added)] = np.concatenate(more)
        return np.insert(store.spelled(places), np.repeat(ends[1:], added), values), np.diff(ends) + added


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+://|\w+:/", uri) else f"file://{uri}")


class ShardWriter:
    """Writes a stream of ids as rows of a fixed length, ``ROWS`` a batch."""

    def __init__(self, sink, kind: np.dtype, length: int):
        self.length, self.kind = length, kind
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.rest = np.zeros(0, kind)

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.rest = np.concatenate([self.rest, ids])
        step = ROWS * self.length
        while len(self.rest) >= step:
            self._put(self.rest[:step], step)
            self.rest = self.rest[step:]

    def close(self) -> None:
        if n := len(self.rest):
            self._put(np.concatenate([self.rest, np.zeros(-n % self.length, self.kind)]), n)
        self.out.close()


def table_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes, from file sizes: nothing is read. 0 where it knows none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def write_files(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end: int = END, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """Writes the shards of all documents into the folder; returns the manifest (shard, name, n_tokens, n_docs), written."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    order = [F.col("doc_id"), F.xxhash64("_t").alias("_h"), F.monotonically_increasing_id().alias("_n")]
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table_bytes(base) // SHARD_BYTES))
    dealt = base.select(*order, "_t").repartitionByRange(shards, "doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n").drop("_h", "_n")
    index_schema = pa.schema([("doc_id", arrow_type(f"x {kind}").field(0).type), ("at", pa.int64()), ("n", pa.int64())])
    schema = "shard int, name string, n_tokens long, n_docs long"
    made = arrow_type(schema)

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        encoder, writer, at, n_docs = Encoder.of(tokenizer), None, 0, 0
        units = encoder.kept_store()
        for batch, texts in pieces(batches, "_t", BATCH_BYTES):
            if writer is None:
                store, path = _store(folder)
                store.create_dir(path, recursive=True)
                sink, index_sink = (store.open_output_stream(f"{path}/{name}{x}") for x in (".arrow", ".index"))
                writer, index = ShardWriter(sink, encoder.kind, length), pa.ipc.new_file(index_sink, index_schema)
            ids, counts = encoder.encode(texts, end, units)
            writer.add(ids)
            index.write_batch(pa.record_batch([batch.column(0).cast(index_schema.field(0).type), pa.array(at + np.cumsum(counts) - counts), pa.array(counts)], schema=index_schema))
            at += len(ids)
            n_docs += len(counts)
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name]), pa.array([at]), pa.array([n_docs])], schema=made)

    return written(dealt.mapInArrow(lean(run), schema), "manifest")


class Shard:
    """A written shard: its index, and its ids by position, read in place."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        store, path = _store(folder)
        if isinstance(store, fs.LocalFileSystem):
            self.file, self.index_file = (pa.memory_map(f"{path}/{name}{x}") for x in (".arrow", ".index"))
        else:
            self.file, self.index_file = (store.open_input_file(f"{path}/{name}{x}") for x in (".arrow", ".index"))
        self.rows, self.index = pa.ipc.open_file(self.file), pa.ipc.open_file(self.index_file)
        self.length = self.rows.schema.field("ids").type.list_size

    def batch(self, k: int) -> np.ndarray:
        """The ids of batch k, a view of the file."""
        return self.rows.get_batch(k).column(0).values.to_numpy()

    def ids(self, at: int, n: int) -> np.ndarray:
        """n ids from position at of the shard's stream."""
        step = ROWS * self.length
        parts = [self.batch(k)[max(0, at - k * step) : at + n - k * step] for k in range(at // step, -(-(at + n) // step))]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one row."""
        batch = self.rows.get_batch(row // ROWS)
        k = row % ROWS
        return batch.column(0).values.to_numpy()[k * self.length : (k + 1) * self.length], batch.column(1)[k].values.to_numpy(zero_copy_only=False)

    def close(self) -> None:
        self.file.close()
        self.index_file.close()


def read_files(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    spark = manifest.sparkSession
    # a row a shard: their running total needs them in order, and they are as many as partitions
    starts = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    out = arrow_type(schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["name"])
                for k in range(shard.index.num_record_batches):
                    index = shard.index.get_batch(k)
                    at, n = index.column(1).to_numpy(), index.column(2).to_numpy()
                    if len(at) == 0:
                        continue
                    stream = shard.ids(int(at[0]), int(n.sum())).astype("<u4")
                    cut = memoryview(stream.view(np.uint8))
                    local = 4 * (at - at[0])
                    crc = [zlib.crc32(cut[a : a + 4 * b]) for a, b in zip(local.tolist(), n.tolist(), strict=True)]
                    yield pa.record_batch([index.column(0), pa.array(at + row["base"]), pa.array(n), pa.array(crc, pa.int64())], schema=out)
                shard.close()

    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return starts.select("shard", "name", "base").repartition(shards, "shard").mapInArrow(lean(run), schema)


def token_table(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, length: int = LENGTH) -> DataFrame:
    """Writes all documents to files in the shared folder and returns what the files say of each."""
    folder = scratch_path(docs.sparkSession, "tokens")
    manifest = write_files(docs, tokenizer, folder, doc_id, text, end, length)
    return read_files(manifest, folder, docs.schema[doc_id].dataType.simpleString())
