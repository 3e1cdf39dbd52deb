"""LM scoring by subword lattice likelihood, beside an add-one word model.

A text is its lower-cased words and one end. The model scores a word as a space mark and its characters: the sum, over
all segmentations into pieces of an existing vocabulary, of the product of unigram piece weights, by forward recursion in
log space; the text's score adds its words' and the end's log10 weights. The vocabulary's own scores start the weights: a
weight is exp(score / T) over the sum of all (pieces of the vocabulary without a rank come after the last that has one, and
byte pieces after them). Training texts then teach them in ``ROUNDS`` rounds of expected piece counts over the segmentations
of all training words. After a round a piece weighs its count, and as much as there are kinds of pieces among the counts is
dealt out beside them (Witten and Bell) by the own scores, at the T that makes the counts likeliest: so own scores tell
pieces apart that training hardly holds, and every piece keeps a weight. The end's weight is its share.

Plan. One scan gives word counts, combined per task, then by word: a row a distinct word with its counts in training texts
and in all. Piece counts come from that table, a word once however frequent. Each distinct word's score is found once. Then texts are
scored in a second scan against the most frequent words (at most ``HEAVY``, a fixed bound; frequent words stand for most
tokens), which is broadcast; a text's other words are kept as (word, times) and joined with the word table, and their
parts are summed per text. So a word that fills the corpus is never a join key, and rare words are, as many as there are.

Defined results: a null text is empty and is one end token; training counts are those of texts not held out; with no
training text all counts are 0 and the start weights hold; equal rows keep a row each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, discard, held_out, lean, pieces, written
from .lattice import Vocabulary, Words, expected, marginals

#: Words that are broadcast at most; rounds that fit the temperature, and where they start, as a share of the scores' range.
HEAVY = 1 << 19
ROUNDS = 2
START = 0.15
#: The score, at most, of a piece without a rank (runs of spaces have -1e9 beside ranks down to -31740).
UNRANKED = -1e8
#: The name under which the end of a text is counted; no word holds a space.
END = " "

_LOG10 = math.log(10)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words of all texts as one dictionary array, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    real = pc.not_equal(words, "")
    counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return pc.dictionary_encode(pc.filter(words, real)), counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): how often every word occurs in training texts and in all, with the end."""
    schema = "word string, c long, n long"
    made = arrow_type(schema)

    def run(batches):
        held, size = [], 0

        def out():
            table = pa.Table.from_arrays([pa.concat_arrays(x) for x in zip(*held, strict=True)], names=["word", "c", "n"]).group_by("word").aggregate([("c", "sum"), ("n", "sum")])
            return pa.record_batch([table[x].combine_chunks() for x in ("word", "c_sum", "n_sum")], schema=made)

        for batch, texts in pieces(batches, "_t", 4 << 20):
            trains = ~batch.column("held").to_numpy(zero_copy_only=False)
            coded, counts = words_of(texts)
            weight = np.repeat(trains, counts)
            c, n = (np.bincount(coded.indices.to_numpy(), w, len(coded.dictionary)).astype(np.int64) for w in (weight, None))
            held.append((pa.concat_arrays([coded.dictionary, pa.array([END])]), pa.array(np.append(c, trains.sum())), pa.array(np.append(n, len(trains)))))
            size += len(c)
            if size > 500_000:  # a bound on what a task holds, not on what it counts
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return docs.select("_t", "held").mapInArrow(lean(run), schema).groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def given_scores(vocabulary: Vocabulary) -> np.ndarray:
    """The vocabulary's own scores; unranked pieces come after the last ranked one, byte pieces after these, and ids that
    lattices don't use never occur."""
    own = vocabulary.scores[vocabulary.normal]
    last = own[own > UNRANKED].min(initial=0.0)
    out = np.full(len(vocabulary.pieces), -np.inf)
    out[vocabulary.normal] = np.where(own > UNRANKED, own, last - 1)
    out[vocabulary.byte_ids] = last - 2
    return out


def weights_at(given: np.ndarray, temperature: float, end: float) -> np.ndarray:
    """Natural logs of the weights of all pieces, which sum to 1 with the end's, the last."""
    x = given / temperature
    top = x.max()
    return np.append(x - top - np.log(np.exp(x - top).sum()) + np.log1p(-end), np.log(end))


def start_scores(vocabulary: Vocabulary) -> np.ndarray:
    given = given_scores(vocabulary)
    known = given[given > -np.inf]
    return weights_at(given, START * max(1.0, float(np.ptp(known))), 0.01)


def fitted_scores(given: np.ndarray, counts: np.ndarray, end: float) -> np.ndarray:
    """Piece weights by their counts, with a part dealt out by the own scores at the temperature under which the counts are
    likeliest; and the end's share."""
    total = counts.sum()
    seen = counts > 0
    width = max(1.0, float(np.ptp(given[given > -np.inf])))

    def likelihood(t: float) -> float:
        x = given / t
        top = x.max()
        return float((counts[seen] * x[seen]).sum() - total * (top + np.log(np.exp(x - top).sum())))

    low, high = np.log(1e-4 * width), np.log(100 * width)
    for _ in range(60):  # the likelihood has one top
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (a, high) if likelihood(np.exp(a)) < likelihood(np.exp(b)) else (low, b)
    share = end / (end + total)
    out = weights_at(given, float(np.exp((low + high) / 2)), share)
    kinds = np.minimum(counts, 1.0).sum()
    with np.errstate(divide="ignore"):
        out[:-1] = np.logaddexp(np.log(counts) + np.log1p(-share), np.log(kinds) + out[:-1]) - np.log(total + kinds)
    return out


def spelled_words(words: list[str]) -> Words:
    return Words.of([f" {w}" for w in words])


def learned_scores(counts: DataFrame, vocabulary_path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural logs of the piece weights, the end's last, after the rounds over all training words."""
    v = Vocabulary.load(vocabulary_path)
    given, learned = given_scores(v), start_scores(v)
    words = counts.filter("c > 0").select("word", "c")
    spark = counts.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(learned)

        def run(batches, shared=shared):
            v, scores = Vocabulary.load(vocabulary_path), shared.value
            total = np.zeros(len(scores))
            for batch in batches:
                for k in range(0, batch.num_rows, 1 << 13):
                    words, c = batch.column(0).slice(k, 1 << 13).to_pylist(), batch.column(1).slice(k, 1 << 13).to_numpy()
                    plain = [i for i, w in enumerate(words) if w != END]
                    total[:-1] += expected(spelled_words([words[i] for i in plain]), c[plain].astype(float), scores[:-1], v)
                    total[-1] += sum(int(c[i]) for i, w in enumerate(words) if w == END)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        found = words.mapInArrow(lean(run), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row a piece
        total = np.zeros(len(learned))
        total[found["piece"].to_numpy()] = found["n"].to_numpy()
        if total[:-1].sum() == 0 or total[-1] == 0:
            return learned
        learned = fitted_scores(given, total[:-1], float(total[-1]))
    return learned


def word_scores(counts: DataFrame, learned: np.ndarray, vocabulary_path: str) -> DataFrame:
    """(word, c, n, s): s is the word's log10 weight under the model."""
    shared = counts.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        v = Vocabulary.load(vocabulary_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 13):
                some = batch.slice(k, 1 << 13)
                words = some.column(0).to_pylist()
                s = marginals(spelled_words(["" if w == END else w for w in words]), shared.value[:-1], v) / _LOG10
                s[[i for i, w in enumerate(words) if w == END]] = shared.value[-1] / _LOG10
                yield pa.record_batch([*some.columns, pa.array(s)], names=["word", "c", "n", "s"])

    return counts.select("word", "c", "n").mapInArrow(lean(run), "word string, c long, n long, s double")


def heavy_floor(table: DataFrame, most: int) -> int:
    """The smallest count of which at most ``most`` words have as much: from a histogram of under a thousand bins."""
    bins = table.groupBy(F.floor(F.log2("n") * 8).alias("b")).agg(F.count("*").alias("words"), F.min("n").alias("low")).collect()
    total, floor = 0, None
    for row in sorted(bins, key=lambda r: -r["b"]):
        total += row["words"]
        if total > most:
            break
        floor = row["low"]
    return floor if floor is not None else 1 << 62


def score(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, heavy: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), held_out(doc_id, modulus).alias("held"))
    counts = written(word_counts(base), "counts")
    table = written(word_scores(counts, learned_scores(counts, vocabulary_path), vocabulary_path), "words")
    discard(counts)
    train, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    floor = heavy_floor(table, heavy)
    bottom = math.log10(train + distinct + 1)
    frequent = table.filter(F.col("n") >= floor).select("word", "c", "s").toArrow()  # at most ``heavy`` rows
    end = table.filter(F.col("word") == END).first()
    end_c, end_s = (end["c"], end["s"]) if end else (0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((frequent["word"].combine_chunks(), frequent["c"].to_numpy(), frequent["s"].to_numpy()))
    schema = f"doc_id {kind}, held boolean, n long, known long, base double, s double, rest array<struct<word:string,times:bigint>>"
    out = arrow_type(schema)

    def run(batches):
        names, cs, ss = shared.value
        logs = np.append(np.log10(cs + 1.0) - bottom, 0.0)
        ss, seen = np.append(ss, 0.0), np.append(cs > 0, False).astype(float)
        for batch, texts in pieces(batches, "_t", 4 << 20):
            n = len(texts)
            coded, counts = words_of(texts)
            spot = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), len(cs)).to_numpy()
            at = spot[coded.indices.to_numpy()]
            owner = np.repeat(np.arange(n), counts)
            common = at < len(cs)
            sums = [np.bincount(owner, w, n) for w in (seen[at], logs[at], ss[at])]
            rest = ~common
            pair, times = np.unique(owner[rest] * np.int64(len(coded.dictionary) + 1) + coded.indices.to_numpy()[rest], return_counts=True)
            whose, which = pair // (len(coded.dictionary) + 1), pair % (len(coded.dictionary) + 1)
            upto = np.concatenate([[0], np.searchsorted(whose, np.arange(n), side="right")]).astype(np.int32)
            words = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(which)), pa.array(times)], fields=list(out.field("rest").type.value_type))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column("held"), pa.array(counts + 1), pa.array(sums[0].astype(np.int64) + (end_c > 0)),
                pa.array(sums[1] + math.log10(end_c + 1) - bottom), pa.array(sums[2] + end_s), pa.ListArray.from_arrays(pa.array(upto), words).cast(out.field("rest").type),
            ], schema=out)

    scored = written(base.mapInArrow(lean(run), schema).withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("rid", F.inline("rest")).join(table.filter(F.col("n") < floor).drop("n"), "word")
    rest = rare.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known2"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1.0) - bottom)).alias("base2"),
        F.sum(F.col("times") * F.col("s")).alias("s2"),
    )
    whole = scored.drop("rest").join(rest, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select("doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), plus("known", "known2").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), plus("s", "s2").alias("score"))
