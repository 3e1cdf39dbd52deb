"""Benchmark decontamination by winnowing.

A document word inside any occurrence of an item window (``span`` consecutive item words; a shorter item is one window)
is hit. Of a text's word k-gram hashes the smallest of every ``span - k + 1`` consecutive ones is kept, the rightmost among
equals, so any shared run of ``span`` words shares a kept hash at the same place. Kept document hashes that pass a Bloom
filter of the benchmark's are joined with the benchmark's, and each hit is extended word by word to both sides, which is
exact. Items under ``span`` words are looked up whole, by length.

Plan. One scan of the documents gives a row each with its word count and the few hashes that passed, each with the words
around it; places of one text with the same words around are one row, and so are those of all items. That table is
written. The join is on the hash alone, so AQE may split a passage that many documents share. What leaves a document is
at most its own hits; what comes to the driver is the filter, of ``FILTER_SHARE`` bits a kept benchmark hash up to
``FILTER_MOST`` (beyond that it lets more rows through), and the lengths of short items.

Defined results: null and empty texts have no words and aren't contaminated; equal rows keep a row each; an empty
benchmark hits nothing; an item of no words gives no window; items with equal texts are all counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, lean, pieces, raw, written

SPAN = 13
GRAM = 6
FILTER_SHARE = 16
FILTER_MOST = 1 << 27

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts, end to end, and each text's number of words."""
    data, offsets = raw(texts)
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = _LOWER[data]
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    power = np.full(int(lengths.max()), _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    heads = np.cumsum(lengths) - lengths
    places = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    hashes = mix(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * power[places], heads))
    hashes[hashes == 0] = 1
    return hashes, np.diff(np.searchsorted(starts, offsets))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on; the last k - 1 run into nothing and mean nothing."""
    padded = np.concatenate([words, np.zeros(k - 1, np.uint64)])
    out = np.zeros(len(words), np.uint64)
    for j in range(k):
        out = out * _GRAM_BASE + padded[j : j + len(words)]
    return mix(out + np.uint64(k))


def winnowed(words: np.ndarray, counts: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) kept of all texts with span words or more: the rightmost minimum of every window."""
    n = len(words) - (span - k)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = grams(words, k)
    least, ahead = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span - k + 1):
        other = hashes[j : n + j]
        lower = other <= least
        np.copyto(least, other, where=lower)
        np.copyto(ahead, j, where=lower)
    left = np.repeat(np.cumsum(counts), counts)[:n] - np.arange(n)  # words from here to the text's end
    at = (ahead + np.arange(n))[left >= span]
    kept = at[np.flatnonzero(np.diff(at, prepend=-1))]  # places of consecutive windows never go back
    return kept, hashes[kept]


def contexts(words: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, k: int, span: int) -> np.ndarray:
    """The word hashes from span - k before to span - k after each k-gram; 0 beyond the text."""
    spots = at[:, None] + np.arange(-(span - k), span)
    ok = (spots >= first[at][:, None]) & (spots < last[at][:, None])
    return np.where(ok, words[np.clip(spots, 0, len(words) - 1)], np.uint64(0))


def _prints(words, counts, k, span, lengths, of_items):
    """Rows (position, length, hash, context): length 0 for kept k-grams, else the length of a short item."""
    last = np.repeat(np.cumsum(counts), counts)
    first = last - np.repeat(counts, counts)
    at, hashes = winnowed(words, counts, k, span)
    yield at, 0, hashes, lambda i: contexts(words, first, last, at[i], k, span)
    here = np.arange(len(words))
    for n in lengths:
        ok = np.flatnonzero((last - here == n) & (first == here) if of_items else last - here >= n)

        def context(i, ok=ok, n=n):
            rows = np.zeros((len(i), 2 * span - k), np.uint64)
            rows[:, :n] = words[ok[i][:, None] + np.arange(n)]
            return rows

        yield ok, n, mix(grams(words, n)[ok] + np.uint64(n)), context


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.uint64(size - 1)
    return hashes & n, (hashes >> np.uint64(32)) & n


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _matrix(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * width).astype(np.int32)), pa.array(values.view(np.int64).ravel()))


def item_prints(benchmark: DataFrame, item_id: str, text: str, span: int, k: int) -> DataFrame:
    """(item_id, n, fp, ctx) of every item: its kept k-grams, or itself where it is short."""
    kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"item_id {kind}, n int, fp long, ctx array<long>"
    out = arrow_type(schema)

    def run(batches):
        for batch, texts in pieces(batches, "_t"):
            words, counts = words_of(texts)
            owner = np.repeat(np.arange(len(texts)), counts)
            for at, n, hashes, context in _prints(words, counts, k, span, range(1, span), True):
                if len(at):
                    yield pa.record_batch([batch.column(0).take(pa.array(owner[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(hashes.view(np.int64)), _matrix(context(np.arange(len(at))))], schema=out)

    return benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("_t")).mapInArrow(lean(run), schema)


def filter_bits(n: int) -> int:
    """The filter's size for n kept hashes."""
    return min(FILTER_MOST, max(1 << 16, 1 << (FILTER_SHARE * n).bit_length()))


def bloom(prints: DataFrame, size: int) -> np.ndarray:
    """The filter's bits as bytes; what comes to the driver is the filter's non-empty words at most."""
    low, high = F.col("fp").bitwiseAND(size - 1), F.shiftrightunsigned("fp", 32).bitwiseAND(size - 1)
    spots = prints.select(F.explode(F.array(low, high)).alias("bit"))
    words = spots.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("mask")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out.view(np.uint8)


def passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The indexes of the hashes that a filter lets through."""
    last = np.uint64(8 * len(sieve) - 1)
    found = np.arange(len(hashes))
    for bit in (hashes & last, (hashes >> np.uint64(32)) & last):
        bit = bit[found]
        found = found[sieve[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0]
    return found


HITS = "array<struct<h:int,n:int,fp:bigint,ctx:array<bigint>,ps:array<int>>>"


def scan(docs: DataFrame, doc_id: str, text: str, sieve: np.ndarray, lengths: list[int], span: int, k: int) -> DataFrame:
    """(doc_id, n_words, hits) of each row: hits holds what passed the filter, (number, length, hash, context, positions)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, hits {HITS}"
    out = arrow_type(schema)
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches):
        for batch, texts in pieces(batches, "_t", 1 << 20):
            words, counts = words_of(texts)
            ends = np.cumsum(counts)
            found = []
            for at, n, hashes, context in _prints(words, counts, k, span, lengths, False):
                i = passes(shared.value, hashes)
                if len(i):
                    found.append((at[i], np.full(len(i), n, np.int64), hashes[i], context(i)))
            at, n, fp, ctx = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2 * span - k), np.uint64))
            owner = np.searchsorted(ends, at, side="right")
            # places of one text with the same words around them are one hit
            rows = np.concatenate([np.stack([owner.astype(np.uint64), n.astype(np.uint64), fp], axis=1), ctx], axis=1)
            _, first, back = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            order = np.lexsort((at, back.ravel()))
            sizes = np.bincount(back.ravel(), minlength=len(first))
            local = (at - (ends - counts)[owner]).astype(np.int32)[order]
            mine = owner[first]
            upto = np.searchsorted(mine, np.arange(len(texts) + 1))
            number = np.arange(len(first)) - upto[mine]
            fields = [pa.array(number.astype(np.int32)), pa.array(n[first].astype(np.int32)), pa.array(fp[first].view(np.int64)), _matrix(ctx[first]), _lists(local, sizes)]
            hits = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(out.field("hits").type.value_type))).cast(out.field("hits").type)
            yield pa.record_batch([batch.column(0), pa.array(counts), hits], schema=out)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).mapInArrow(lean(run), schema)


def extended(pairs: DataFrame, span: int, k: int) -> DataFrame:
    """(rid, h, before, after, items): how many words of hit h, before its place and from it on, lie in an item's window."""
    kind = pairs.schema["items"].dataType.simpleString()
    side = span - k

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            table = {x: batch.column(x) for x in batch.schema.names}
            mine, other = (table[x].flatten().to_numpy().reshape(n, -1) for x in ("ctx", "item_ctx"))
            size = table["n"].to_numpy()
            same = (mine == other) & (mine != 0)
            left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, side + k :], axis=1).sum(axis=1)
            middle = same[:, side : side + k].all(axis=1)
            long_hit = (size == 0) & middle & (left + k + right >= span)
            short_hit = (size > 0) & (mine == other).all(axis=1)
            before, after = np.where(size > 0, 0, left).astype(np.int32), np.where(size > 0, size, k + right).astype(np.int32)
            ok = pa.array(np.flatnonzero(long_hit | short_hit))
            yield pa.record_batch([table["rid"].take(ok), table["h"].take(ok), pa.array(before).take(ok), pa.array(after).take(ok), table["items"].take(ok)], names=["rid", "h", "before", "after", "items"])

    return pairs.select("rid", "h", "n", "ctx", "item_ctx", "items").mapInArrow(lean(run), f"rid long, h int, before int, after int, items {kind}")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every row; items as sorted strings."""
    items = written(item_prints(benchmark, item_id, item_text, span, k), "items")
    lengths = sorted(r["n"] for r in items.filter("n > 0").select("n").distinct().collect())  # span - 1 numbers at most
    # windows with the same words are one, with all their items
    item = written(items.groupBy("n", "fp", F.col("ctx").alias("item_ctx")).agg(F.collect_set(F.col("item_id").cast("string")).alias("items")), "windows")
    sieve = bloom(item.select("fp"), filter_bits(item.count()))
    found = written(scan(docs, doc_id, text, sieve, lengths, span, k).withColumn("rid", F.monotonically_increasing_id()), "hits")
    hits = found.filter(F.size("hits") > 0).select("rid", F.inline("hits"))
    touched = extended(hits.drop("ps").join(item, ["fp", "n"]), span, k)
    # all windows at a hit hold its place, so the widest reach to both sides is their union
    reach = touched.groupBy("rid", "h").agg(F.max("before").alias("before"), F.max("after").alias("after"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    spread = found.filter(F.size("hits") > 0).select("rid", F.explode("hits").alias("x")).select("rid", F.col("x.h").alias("h"), F.col("x.ps").alias("ps"))
    ranges = reach.join(spread, ["rid", "h"]).select("rid", "items", F.transform("ps", lambda p: F.struct((p - F.col("before")).cast("long").alias("a"), (p + F.col("after")).cast("long").alias("b"))).alias("r"))
    per_doc = ranges.groupBy("rid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("r")))).alias("r"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    # ranges by start: each adds what lies beyond the furthest end so far
    n_hit = F.aggregate("r", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])
    out = found.select("rid", "doc_id", "n_words").join(per_doc.select("rid", n_hit.alias("n_hit"), F.sort_array("items").alias("items")), "rid", "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"))
