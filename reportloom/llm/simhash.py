"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

Fingerprint: the bitwise majority of the XXH64 (seed 42) values of a text's word shingles. Two fingerprints link when
they differ in at most ``radius`` bits; a component is what links reach.

Plan. Equal fingerprints collapse to one node first, so a group of copies of any size is one row. Candidates come from
blocks: the 64 bits are cut into ``radius + k`` blocks, so two linked fingerprints agree on k blocks at least, and
every k blocks give a key. For radius 4 and k = 2 that is 15 keys of 20 to 22 bits, for k = 3 35 keys of 27, for k = 4 70
keys of 32; k is what costs least for the number of nodes, so comparisons don't grow with its square. All give the same links.
Fingerprints are dealt and sorted by key and compared inside a key with bit planes. A key gives at most one link for each of its members (a spanning forest), never
all pairs. A key with more than ``most`` members is cut into blocks of members and every two blocks meet in a task of
their own, so no task grows with a key. Links go through large-star/small-star rounds, each written to the shared folder.

Defined results: null or empty text, or text of white space only, has fingerprint zero and links like any other; equal
ids keep a row each; a null id never is a component's label unless all its members are null; an empty table gives none.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, pieces, written

RADIUS = 4
SHINGLE = 4
#: Members of a key that meet in one task.
MOST = 8_000
#: What dealing a row costs, in comparisons of two fingerprints.
DEALT = 50
#: Runs up to this length are compared lane by lane; longer ones are searched breadth first.
LANES = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        digests = [xxhash.xxh64_digest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths + 1) - lengths - 1
        first, last = starts[: n - shingle + 1], (starts + lengths)[shingle - 1 :]
        cut = map(joined.__getitem__, map(slice, first.tolist(), last.tolist()))
        digests = list(map(xxhash.xxh64_digest, cut, repeat(42)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 15):
        some = np.frombuffer(b"".join(digests[at : at + (1 << 15)]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): the signed 64-bit value of the fingerprint of each row's whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch, texts in pieces(batches, "_t"):
            fps = np.array([fingerprint(x.as_buffer().to_pybytes(), shingle) for x in texts], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).mapInArrow(lean(run), f"doc_id {kind}, fp long")


def key_masks(radius: int, k: int = 2) -> list[int]:
    """Masks of k of the radius + k blocks each."""
    edges = [round(64 * b / (radius + k)) for b in range(radius + k + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(blocks, k)]


def blocks_for(n: int, radius: int) -> int:
    """How many blocks a key should have for n nodes: more make keys longer, and more of them."""
    cost = lambda k: math.comb(radius + k, k) * (DEALT + n / 2 ** (64 * k / (radius + k)))
    return min(range(2, 7), key=cost)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of fingerprints: plane b holds bit b of all of them, 64 a word."""
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Bit-sliced counters of up to ``radius`` (under 8); lanes beyond it are marked as over."""

    def __init__(self, over: np.ndarray, radius: int):
        self.low, self.mid, self.high = (np.zeros_like(over) for _ in range(3))
        self.over, self.radius = over, radius

    def add(self, bit: np.ndarray) -> None:
        carry = self.low & bit
        self.low ^= bit
        both = self.mid & carry
        self.mid ^= carry
        self.over |= self.high & both
        self.high ^= both

    def settle(self) -> np.ndarray:
        """Mark the lanes beyond the radius: compare the three counter bits with it."""
        greater, equal = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for value, bit in ((self.high, 4), (self.mid, 2), (self.low, 1)):
            if self.radius & bit:
                equal &= value
            else:
                greater |= equal & value
                equal &= ~value
        self.over |= greater
        return self.over

    def keep(self, words: np.ndarray) -> None:
        self.low, self.mid, self.high, self.over = (x[words] for x in (self.low, self.mid, self.high, self.over))


def distances_within(planes, other, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (64 a word) where the planes differ in at most ``radius`` bits. ``other(b, words)`` gives what plane b is
    compared with. Words of which every lane is over are abandoned after every eight planes."""
    full = ~np.uint64(0)
    words = np.flatnonzero(over != full)
    count = Counters(over[words], radius)
    for b in range(64):
        if len(words) == 0:
            break
        count.add(planes[b][words] ^ other(b, words))
        if b % 8 == 7:
            alive = count.settle() != full
            if not alive.all():
                words = words[alive]
                count.keep(alive)
    near = np.zeros_like(over)
    near[words] = ~count.over
    return near


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def lagged_links(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of one run that are within the radius, for sorted run numbers: lag by lag, all runs at once."""
    planes, n = planes_of(fps), len(fps)
    wide = np.concatenate([planes, np.zeros((64, 2), np.uint64)], axis=1)
    left, right, lag = [], [], 1
    while lag < n:
        same = np.zeros(planes.shape[1] * 64, bool)
        same[: n - lag] = run[lag:] == run[: n - lag]
        if not same.any():
            break
        over = ~np.packbits(same, bitorder="little").view(np.uint64)
        hop, by = lag // 64, np.uint64(lag % 64)

        def shifted(b, words, hop=hop, by=by):
            low = wide[b][np.minimum(words + hop, wide.shape[1] - 1)] >> by
            return low if by == 0 else low | wide[b][np.minimum(words + hop + 1, wide.shape[1] - 1)] << (np.uint64(64) - by)

        found = lanes(distances_within(planes, shifted, over, radius), n - lag)
        left.append(found)
        right.append(found + lag)
        lag += 1
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def forest_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one long run, breadth first: what is found leaves the planes, so a dense group is quick."""
    left, right = [], []
    index, planes = np.arange(len(fps)), planes_of(fps)
    gone = np.zeros(len(fps), bool)  # by position in index
    queue: list[int] = []
    nulls = np.uint64(0)
    while True:
        if gone.mean() > 0.25:
            index = index[~gone]
            planes, gone = planes_of(fps[index]), np.zeros(len(index), bool)
        if len(index) == 0 or gone.all():
            return np.array(left, np.int64), np.array(right, np.int64)
        if queue:
            at = queue.pop()
        else:
            k = int(np.argmin(gone))
            at, gone[k] = int(index[k]), True
        over = np.full(planes.shape[1] * 64, True)
        over[: len(index)] = gone
        value = int(fps[at])
        near = distances_within(planes, lambda b, words, v=value: ~nulls if v >> b & 1 else nulls, np.packbits(over, bitorder="little").view(np.uint64), radius)
        found = lanes(near, len(index))
        gone[found] = True
        left += [at] * len(found)
        right += index[found].tolist()
        queue += index[found].tolist()


def run_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys (rows sorted by them)."""
    if len(keys) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    size = ends - starts
    left, right = [], []
    short = np.flatnonzero((size > 1) & (size <= LANES))
    if len(short):
        rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[short], ends[short], strict=True)])
        i, j = lagged_links(fps[rows], np.repeat(np.arange(len(short)), size[short]), radius)
        left.append(rows[i])
        right.append(rows[j])
    for k in np.flatnonzero(size > LANES):
        i, j = forest_links(fps[starts[k] : ends[k]], radius)
        left.append(i + starts[k])
        right.append(j + starts[k])
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST, k: int = 2) -> DataFrame:
    """(a, b): fingerprints of distinct ``nodes`` (fp long) that link; enough of them to connect each component."""
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in key_masks(radius, k)))
    keyed = nodes.select("fp", F.posexplode(masks).alias("k", "m")).select("fp", F.xxhash64("k", F.col("fp").bitwiseAND(F.col("m"))).alias("key"))
    large = keyed.groupBy("key").count().filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int")
    # a member of part p meets part q in the cell (min, max); of one part, in the cell (p, p) alone
    cells = keyed.join(large, "key", "left").withColumn("own", own).select("fp", "key", F.explode(F.when(parts == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.least(q, F.col("own")) * parts + F.greatest(q, F.col("own"))))).alias("cell"))
    dealt = cells.select(F.xxhash64("key", "cell").alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(keys, fps):
            i, j = run_links(keys, fps, radius)
            return pa.record_batch([pa.array(fps[i].view(np.int64)), pa.array(fps[j].view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([rest_k, batch.column(0).to_numpy()])
            fps = np.concatenate([rest_f, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
                yield out(keys[:cut], fps[:cut])
                rest_k, rest_f = keys[cut:], fps[cut:]
        yield out(rest_k, rest_f)

    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "star") -> DataFrame:
    """(node, root) of every node that has an edge (a, b): root is the smallest node that edges reach.

    An edge goes from its larger node a to its smaller one b. A round moves each edge on to the least node that b has an edge to
    (large-star), then links all that a node has edges to with the least of them (small-star). The least ones are written first, so
    that they are broadcast if few, and else a hub's edges are split over tasks as a skewed join's; edges dealt by a lose copies
    and get their least one without another shuffle."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("moved")), name)
    while not edges.filter("moved").isEmpty():
        least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        least = written(least, name)
        large = edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        large = large.repartition("a").groupBy("a", "b").agg(F.max("moved").alias("moved")).withColumn("m", F.min("b").over(Window.partitionBy("a")))
        late = F.col("b") > F.col("m")
        small = large.select(F.when(late, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"), (late | F.col("moved")).alias("moved"))
        done, edges = edges, written(small, name)
        discard(done, least)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; fingerprint as 16 hex digits."""
    prints = written(fingerprints(docs, doc_id, text, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, radius, k=blocks_for(nodes.count(), radius)))
    held = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    held = written(held, "held")
    first = held.groupBy("root").agg(F.min("least").alias("component_id"))
    named = held.join(first, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
