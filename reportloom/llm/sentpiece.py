"""SentencePiece encoding and decoding by a max-plus scan.

A text is a space mark, then its characters with spaces as marks; the best segmentation is the one with the largest sum
of the vocabulary's piece scores (among equal sums the one whose last piece is longer, then the one before it, and so on,
however the text is cut into chunks). No piece has a mark after another character, so a place where a mark follows one is a *sync point*, over which no piece reaches.

Ordinary texts are cut at sync points into units; each new unit of a batch is solved once, all units of one length at
once (see ``lattice``). A giant text (over ``chunk`` characters) is dealt out as chunks of that length, or up to the last sync point in it, so
that only a unit longer than a chunk is ever cut. A chunk yields a
boundary-state transfer matrix: entry (s, t) is the best score when a piece from before covers its first s characters
and its own last piece reaches t characters beyond it; beside it stands how paths of equal score are told apart. Matrices combine associatively in the max-plus semiring, in a tree
whose upper half then tells each chunk its two states, and the chunks are traced back on their own. A chunk with a sync
point has a matrix of rank one (head + middle + tail) and needs no more than its ends beside its units.

Plan. Ordinary texts aren't shuffled. Chunks are dealt by (text, number); what comes together for a text is its matrices,
``blocks`` of them at a time, then the blocks' products, and at last its ids, which are its row.

Defined results: null and empty texts have no ids; decoding gives back every text exactly, also one that holds a literal
space mark, as it is spelled in byte pieces; equal rows keep a row each.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STORE_BYTES, UnitStore, arrow_type, lean, pieces, plain, written
from .lattice import LITERAL_MARK, MARK, Vocabulary, Words, best_paths, spelled, windows

CHUNK = 1 << 15
BLOCK = 256
DECODED = 1 << 18


class Codec:
    """Encodes and decodes with one vocabulary. What it keeps is of the vocabulary's size."""

    _own: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        """This process's codec, kept from task to task."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        v = self.vocabulary = Vocabulary.load(path)
        self.scores = v.scores
        ordinary = v.scores[v.normal]
        self.unknown = float(ordinary[ordinary > -1e8].min() - 10)
        mark = chr(MARK)
        if any(mark in v.pieces[i].lstrip(mark) for i in v.normal):
            raise ValueError("a piece has a space mark after another character")
        self.bytes_of = [p.replace(mark, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.bytes_of[i] = bytes([b])

    def store(self, most: int = STORE_BYTES) -> UnitStore:
        return UnitStore(lambda units: best_paths(Words.of(units), self.scores, self.vocabulary, self.unknown), np.int32, most)

    def solve(self, text: str, store: UnitStore) -> tuple[np.ndarray, float]:
        """Ids and score of a text that is whole units."""
        units = cut_units(text)
        distinct = list(dict.fromkeys(units))
        place = dict(zip(distinct, store.places(distinct).tolist(), strict=True))
        at = np.fromiter(map(place.__getitem__, units), np.int64, len(units))
        return store.spelled(at), float(store.total[at].sum())

    def encode(self, texts: pa.Array, store: UnitStore) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has."""
        # the first space mark is the codec's own: texts begin with a space here, and empty ones stay empty
        whole = pc.if_else(pc.equal(texts, ""), pa.scalar(""), pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
        # where no spaces touch, a unit is a space and what follows up to the next; else units are cut by hand
        simple = ~(pc.match_substring(whole, "  ").to_numpy(zero_copy_only=False) | pc.ends_with(whole, " ").to_numpy(zero_copy_only=False))
        split = pc.split_pattern(pc.if_else(pa.array(simple), whole, pa.scalar("")), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(split.flatten())
        places = store.places([f" {u}" if u else "" for u in coded.dictionary.to_numpy(zero_copy_only=False)])[coded.indices.to_numpy()]
        ids, heads = store.spelled(places), offsets[:-1] - offsets[0]
        counts = np.add.reduceat(store.sizes(places), heads) if len(heads) else np.zeros(0, np.int64)
        if simple.all():
            return ids, counts
        ends = np.cumsum(counts)
        out = [ids[ends[i] - counts[i] : ends[i]] if simple[i] else self.solve(whole[i].as_py(), store)[0] for i in range(len(texts))]
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def decode(self, ids) -> str:
        """The text of whole-text ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def marked(unit: str) -> np.ndarray:
    """Code points of a unit, with spaces as marks and literal marks kept apart."""
    return Words.of([unit]).flat


def cut_units(text: str) -> list[str]:
    """The text cut before every space that follows another character."""
    return re.findall(r" *[^ ]+| +$", text)


def combine(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices, each (scores, ranks). A rank orders, for one leaving state, the best
    paths of the entering states by their cuts from the right (a lower last cut first), which tells equal sums apart."""
    total = one[0][:, :, None] + two[0][None, :, :]
    best = total.max(axis=1)
    through = np.where(total == best[:, None, :], two[1][None, :, :], np.inf).argmin(axis=1)
    states = np.arange(len(best))
    key = two[1][through, states[None, :]] * len(states) + one[1][states[:, None], through]
    return np.stack([best, key.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable")])


def between(one: np.ndarray, two: np.ndarray, enter: int, leave: int) -> int:
    """The state between two chunks on the best path from enter to leave."""
    total = one[0][enter] + two[0][:, leave]
    return int(np.where(total == total.max(), two[1][:, leave], np.inf).argmin())


def scan_states(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The states between consecutive chunks (one fewer than chunks) of the best path from enter to leave."""
    if len(matrices) < 2:
        return []
    pairs = [combine(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    outer = [enter, *scan_states(pairs, enter, leave), leave]
    states: list[int] = []
    for p in range(len(pairs)):
        if 2 * p + 1 < len(matrices):
            states.append(between(matrices[2 * p], matrices[2 * p + 1], outer[p], outer[p + 1]))
        if p + 1 < len(pairs):
            states.append(outer[p + 1])
    return states


class ChunkSolver:
    """Transfer matrix and backtrace of one chunk. ``codes`` holds the chunk and the look-ahead that pieces may reach."""

    def __init__(self, codec: Codec, store: UnitStore, codes: np.ndarray, size: int):
        self.codec, self.store, self.codes, self.size = codec, store, codes, size
        self.states = codec.vocabulary.longest
        inside = np.flatnonzero((codes[1:size] == MARK) & (codes[: size - 1] != MARK)) + 1
        inside = inside[inside >= self.states]  # beyond every entry state
        self.sync = (int(inside[0]), int(inside[-1])) if len(inside) else None

    def _forward(self, lo: int, hi: int, entries: np.ndarray):
        """Best sums from each entry (rows) to places lo..hi (hi may lie in the look-ahead), no step starting at or
        beyond the chunk's end; the steps; and the rows' ranks at each place."""
        v, wide = self.codec.vocabulary, np.concatenate([self.codec.scores, [-np.inf]])
        best = np.full((len(entries), hi - lo + 1), -np.inf)
        rows = np.arange(len(entries))
        best[rows, entries - lo] = 0
        from_, kind = np.full(best.shape, -1, np.int32), np.full(best.shape, -1, np.int32)
        ranks = np.zeros(best.shape, np.int16)
        never = np.int32(best.shape[1])
        for at, ids in windows(self.codes[lo:hi], v):
            for k in range(len(ids)):
                j = at + k + 1
                first = max(0, j - v.longest)
                last = min(j, self.size - lo)  # a step starts inside the chunk
                if first < last:
                    row = ids[k, v.longest - (j - first) :][: last - first]
                    weight = wide[row]
                    if last == j and row[-1] < 0:
                        weight[-1] = self.codec.unknown
                    x = best[:, first:last] + weight
                    m = x.argmax(axis=1)
                    better = x[rows, m] > best[:, j]
                    best[better, j] = x[rows, m][better]
                    from_[better, j] = (first + m)[better]
                    kind[better, j] = row[m][better]
                if len(rows) > 1:
                    # an entry at this place has its last cut before the chunk, so before all others'
                    order = np.lexsort((ranks[rows, from_[:, j]], np.where(best[:, j] > -np.inf, from_[:, j], never)))
                    ranks[order, j] = rows
        return best, from_, kind, ranks

    def _path(self, lo: int, from_, kind, end: int, begin: int) -> np.ndarray:
        path, at = [], end - lo
        while at > begin - lo:
            path.append((lo + int(from_[at]), lo + at, int(kind[at])))
            at = int(from_[at])
        return spelled(self.codes, path[::-1], self.codec.vocabulary)

    def middle_text(self) -> str:
        if self.sync is None:
            return ""
        codes = self.codes[self.sync[0] : self.sync[1]].copy()
        codes[codes == MARK] = 32
        codes[codes == LITERAL_MARK] = MARK
        return codes.tobytes().decode("utf-32-le")

    def _middle(self):
        return self.codec.solve(self.middle_text(), self.store)

    def _tail(self):
        return self._forward(self.sync[1], min(len(self.codes), self.size + self.states - 1), np.array([self.sync[1]]))

    def matrix(self) -> np.ndarray:
        """(scores, ranks), each a row an entering state and a column a leaving one."""
        s = self.states
        out, ranks = np.full((s, s), -np.inf), np.full((s, s), s)
        entries = np.arange(min(s, self.size + 1))
        if self.sync is None:
            best, _, _, order = self._forward(0, min(len(self.codes), self.size + s - 1), entries)
            ends = best[:, self.size :]
            out[: len(entries), : ends.shape[1]] = ends
            ranks[: len(entries), : ends.shape[1]] = order[:, self.size :] + 1
            # a piece that covers more than the whole chunk leaves the rest to the next
            for k in range(self.size + 1, s):
                out[k, k - self.size] = ranks[k, k - self.size] = 0
        else:
            head, _, _, order = self._forward(0, self.sync[0], entries)
            total = self._middle()[1] if self.sync[1] > self.sync[0] else 0.0
            tail = self._tail()[0][0, self.size - self.sync[1] :]
            out[: len(entries), : len(tail)] = head[:, -1:] + total + tail[None, :]
            ranks[: len(entries)] = order[:, -1:] + 1
        return np.stack([out, ranks.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable")])

    def trace(self, enter: int, leave: int) -> np.ndarray:
        """Ids of the pieces that start in the chunk."""
        if enter >= self.size:
            return np.zeros(0, np.int32)
        if self.sync is None:
            _, from_, kind, _ = self._forward(0, min(len(self.codes), self.size + self.states - 1), np.array([enter]))
            return self._path(0, from_[0], kind[0], self.size + leave, enter)
        _, from_, kind, _ = self._forward(0, self.sync[0], np.array([enter]))
        head = self._path(0, from_[0], kind[0], self.sync[0], enter)
        middle = self._middle()[0] if self.sync[1] > self.sync[0] else np.zeros(0, np.int32)
        _, from_, kind, _ = self._tail()
        return np.concatenate([head, middle, self._path(self.sync[1], from_[0], kind[0], self.size + leave, self.sync[1])])


def solvers(codec: Codec, parts, sizes: list[int], together: int = 16):
    """Solvers of a batch's chunks; the units of ``together`` chunks are solved at once before the chunks are."""
    store = codec.store()
    for k in range(0, len(sizes), together):
        some = [ChunkSolver(codec, store, marked(parts[i].as_py()), sizes[i]) for i in range(k, min(len(sizes), k + together))]
        store.places(list(dict.fromkeys(u for s in some for u in cut_units(s.middle_text()))))
        yield from some


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _ordinary(docs: DataFrame, model: str, kind: str) -> DataFrame:
    schema = f"doc_id {kind}, ids array<int>"
    out = arrow_type(schema)

    def run(batches):
        codec = Codec.of(model)
        store = codec.store()
        for batch, texts in pieces(batches, "_t"):
            ids, counts = codec.encode(texts, store)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, counts)], schema=out)

    return docs.mapInArrow(lean(run), schema)


def _chunks(docs: DataFrame, model: str, chunk: int, kind: str) -> DataFrame:
    """(doc_id, rid, c, size, part) of the chunks of giant texts; a part holds the look-ahead too."""
    schema = f"doc_id {kind}, rid long, c int, size int, part string"
    out = arrow_type(schema)

    def run(batches):
        reach = Codec.of(model).vocabulary.longest - 1
        for batch in batches:
            ids, rids, texts = batch.column(0), batch.column(1), plain(batch.column(2))
            for i in range(batch.num_rows):
                text = " " + texts[i].as_py()
                codes = marked(text)
                sync = np.flatnonzero((codes[1:] == MARK) & (codes[:-1] != MARK)) + 1
                at = c = 0
                while at < len(codes):
                    end = min(at + chunk, len(codes))
                    if end < len(codes) and (k := int(np.searchsorted(sync, end, side="right"))) and sync[k - 1] > at:
                        end = int(sync[k - 1])
                    part = text[at : end + reach]
                    yield pa.RecordBatch.from_arrays([ids.slice(i, 1), rids.slice(i, 1), pa.array([c], pa.int32()), pa.array([end - at], pa.int32()), pa.array([part], pa.string())], schema=out)
                    at, c = end, c + 1

    return docs.withColumn("rid", F.monotonically_increasing_id()).select("doc_id", "rid", "_t").mapInArrow(lean(run), schema)


def _giants(docs: DataFrame, model: str, chunk: int, block: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    chunks = written(_chunks(docs, model, chunk, kind), "chunks")
    if chunks.isEmpty():
        return spark.createDataFrame([], f"doc_id {kind}, ids array<int>")
    # by number: a chunk is much work for its bytes, so Spark should not put partitions together by bytes
    spread = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid", "c")
    dealt = spread(chunks)

    def matrices(batches):
        codec = Codec.of(model)
        for batch in batches:
            rows = [s.matrix().ravel() for s in solvers(codec, batch.column(3), batch.column(2).to_pylist())]
            if rows:
                yield pa.record_batch([batch.column(0), batch.column(1), _doubles(rows)], names=["rid", "c", "m"])

    one = written(dealt.select("rid", "c", "size", "part").mapInArrow(lean(matrices), "rid long, c int, m array<double>"), "matrices")
    blocks = one.withColumn("b", (F.col("c") / block).cast("int"))

    def product(table: pa.Table) -> pa.Table:
        mats = _sorted_matrices(table)
        while len(mats) > 1:
            mats = [combine(*mats[k : k + 2]) if k + 1 < len(mats) else mats[k] for k in range(0, len(mats), 2)]
        return pa.table({"rid": table["rid"][:1], "c": table["b"][:1], "m": _doubles([mats[0].ravel()])})

    def states(table: pa.Table) -> pa.Table:
        """(rid, c, enter, leave): of blocks from text ends, or of chunks from their block's states."""
        enter, leave = (table[x][0].as_py() if x in table.schema.names else 0 for x in ("enter", "leave"))
        held = [enter, *scan_states(_sorted_matrices(table), enter, leave), leave]
        c = sorted(table["c"].to_pylist())
        return pa.table({"rid": pa.array([table["rid"][0].as_py()] * len(c), pa.int64()), "c": pa.array(c, pa.int32()), "enter": pa.array(held[:-1], pa.int32()), "leave": pa.array(held[1:], pa.int32())})

    out = "rid long, c int, enter int, leave int"
    outer = blocks.groupBy("rid", "b").applyInArrow(product, "rid long, c int, m array<double>").groupBy("rid").applyInArrow(states, out)
    inner = blocks.join(outer.withColumnRenamed("c", "b"), ["rid", "b"]).groupBy("rid", "b").applyInArrow(states, out)

    def trace(batches):
        codec = Codec.of(model)
        for batch in batches:
            ends = zip(batch.column("enter").to_pylist(), batch.column("leave").to_pylist(), strict=True)
            rows = [s.trace(*e) for s, e in zip(solvers(codec, batch.column("part"), batch.column("size").to_pylist()), ends, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), batch.column("c"), _lists(np.concatenate(rows), np.array(list(map(len, rows))))], schema=traced)

    schema = f"doc_id {kind}, rid long, c int, ids array<int>"
    traced = arrow_type(schema)
    parts = dealt.join(spread(inner), ["rid", "c"]).select("doc_id", "rid", "c", "size", "enter", "leave", "part").mapInArrow(lean(trace), schema)
    whole = parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("x"))
    return whole.select("doc_id", F.flatten("x.ids").alias("ids"))


def _doubles(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * len(rows[0])).astype(np.int32)), pa.array(np.concatenate(rows)))


def _sorted_matrices(table: pa.Table) -> list[np.ndarray]:
    column = table["m"].combine_chunks()
    flat = column.flatten().to_numpy().reshape(len(table), -1)
    side = int(round((flat.shape[1] / 2) ** 0.5))
    return [flat[k].reshape(2, side, side) for k in np.argsort(table["c"].to_numpy())]


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids) of every row; model is the path of a vocabulary file that every executor has."""
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    giant = F.length("_t") > chunk
    return _ordinary(base.filter(~giant), model, kind).unionByName(_giants(base.filter(giant), model, chunk, block, kind))


def decode(rows: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text, ids_crc32): texts of whole-text ids; null ids give a null text."""
    schema = f"doc_id {rows.schema[doc_id].dataType.simpleString()}, ids array<int>, text string, ids_crc32 long"
    out = arrow_type(schema)

    def run(batches):
        codec = Codec.of(model)
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:  # some hundred thousand ids at a time, or one row
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + DECODED, side="right")))
                some, at = batch.slice(at, end - at), end
                column = some.column(1)
                texts, crcs = [], []
                for x in column:
                    own = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype("<u4")
                    texts.append(None if own is None else codec.decode(own))
                    crcs.append(None if own is None else zlib.crc32(own.tobytes()))
                yield pa.RecordBatch.from_arrays([some.column(0), column.cast(out.field("ids").type), pa.array(texts, pa.string()), pa.array(crcs, pa.int64())], schema=out)

    return rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(lean(run), schema)
