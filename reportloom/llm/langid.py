"""Language ID: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

Every byte 3-gram and 4-gram of the lower-cased text is hashed to one of 2 ** ``bits`` buckets; a text is the mean of
their embeddings and a linear softmax over it gives the languages and one class more, for text of none of them. Both are
fitted by stochastic gradient descent in numpy on the driver, on a bounded sample: ``sample`` labelled documents at most,
as many of each of ``most`` languages (the most frequent ones), in the order of their id's hash; whole, and some of their
lines. The class for other text learns from the same documents with the letters of each word shuffled, or with the letters
of the whole text exchanged for others by a random rule, which is what a language never seen looks like in n-grams.

Calibration. One in five sampled documents isn't fitted. They, their lines and their distorted copies set the temperature,
which falls with a text's number of grams (short texts tell less), by least log loss over all classes. The score is the
chosen language's probability so calibrated; a text is rejected when it is under ``REJECT_BELOW``: when fewer than one such
text in fifty would be in the language named for it.

As the softmax is linear, a text's logits are the mean of one row per gram (embeddings times weights), so prediction
gathers a few numbers a gram, over whole texts. The model is 2 ** bits rows and is broadcast; its size doesn't depend on
the data. Documents aren't shuffled. Executors count the sampled documents' grams; what comes to the driver is at most
2 ** bits buckets a sampled document, packed by the tasks (steps between buckets and counts, deflated) and held as small
numbers while the model is fitted.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; with no labelled document all
are; null labels are not learned; equal rows keep a row each; ties go to the first language in order.
"""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, lean, pieces, plain, raw, sampled_ids

BITS = 15
DIM = 16
#: Documents that training reads at most, languages that it tells apart at most, and lines of a document that it adds.
SAMPLE = 2000
MOST_LANGUAGES = 200
LINES = 1
EPOCHS = 3
#: The calibrated probability of the best language under which a text is rejected.
REJECT_BELOW = 0.02

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # all other ASCII separates words
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # a row a bucket, a column a language, the last for other text
    bias: np.ndarray
    temperature: float
    short: float  # the temperature is more by this over the number of grams
    threshold: float = REJECT_BELOW

    def probabilities(self, z: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return softmax(z / (self.temperature + self.short / grams)[:, None])


#: A text's buckets, how often each occurs, its label (or None for other text) and whether it calibrates.
Example = tuple[np.ndarray, np.ndarray, str | None, bool]


def buckets(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the 3-grams and 4-grams that start at each byte; data ends with 3 spaces at least."""
    x = _FOLD[data]
    shift = np.uint32(32 - bits)
    three = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16)
    four = three | x[3:] << np.uint32(24)
    return three * np.uint32(2654435761) >> shift, (four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519) >> shift


def counted(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their counts."""
    found = np.concatenate(buckets(np.frombuffer(b" " + text.encode() + b"   ", np.uint8), bits))
    n = np.bincount(found, minlength=1 << bits)
    at = np.flatnonzero(n)
    return at, n[at]


def shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with the letters of each word in random order."""
    text = text.lower()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    at = np.flatnonzero(np.fromiter(map(str.isalpha, text), bool, len(text)))
    word = np.cumsum(np.diff(at, prepend=-2) > 1)
    codes[at] = codes[at[np.lexsort((rng.random(len(at)), word))]]
    return codes.tobytes().decode("utf-32-le")


def exchanged(text: str, rng: np.random.Generator) -> str:
    """The text with each of its letters exchanged for another of them, always the same one."""
    text = text.lower()
    own = sorted({c for c in set(text) if c.isalpha()})
    return text.translate({ord(a): b for a, b in zip(own, rng.permutation(own).tolist(), strict=True)}) if own else text


def examples_of(text: str, language: str, bits: int = BITS, lines: int = LINES) -> list[Example]:
    """What a labelled document teaches: itself, some lines of it, and a distorted copy of either."""
    seed = zlib.crc32(text.encode())
    rng = np.random.default_rng(seed)
    checks = seed % 5 == 4
    own = sorted({x for x in text.split("\n") if x != text and _LETTER.search(x)})
    some = [own[k] for k in rng.permutation(len(own))[:lines]]
    distort = (shuffled, exchanged) if seed % 2 else (exchanged, shuffled)
    other = [distort[0](text, rng), *(distort[1](x, rng) for x in some[:1] if len(x) > 40)]
    return [(*counted(x, bits), y, checks) for x, y in [*((x, language) for x in [text, *some]), *((x, None) for x in other)]]


def fit(examples: list[Example], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, seed: int = 1) -> Model | None:
    """The model of examples in a fixed order."""
    languages = sorted({y for _, _, y, _ in examples if y is not None})
    if not languages:
        return None
    number = {y: i for i, y in enumerate(languages)} | {None: len(languages)}
    classes = len(languages) + 1
    fitted, checked = ([x for x in examples if x[3] == checks] for checks in (False, True))
    fitted = fitted or examples
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (dim, classes)).astype(np.float32), np.zeros(classes, np.float32)
    labels = np.array([number[y] for _, _, y, _ in fitted])
    share = len(fitted) / classes / np.maximum(1, np.bincount(labels, minlength=classes))
    steps = epochs * len(fitted)
    for step, k in enumerate(np.concatenate([rng.permutation(len(fitted)) for _ in range(epochs)])):
        at, n, y = *fitted[k][:2], labels[k]
        part = n.astype(np.float32) / n.sum()
        mean = part @ table[at]
        z = mean @ weight + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        rate = 0.5 * (1 - step / steps) * min(4.0, share[y])
        back = weight @ p
        weight -= rate * np.outer(mean, p)
        bias -= 0.1 * rate * p
        table[at] -= (rate * 20) * part[:, None] * back
    model = Model(languages, table @ weight, bias, 1.0, 0.0)
    if checked:
        calibrate(model, checked, np.array([number[y] for _, _, y, _ in checked]))
    return model


def calibrate(model: Model, checked: list[Example], y: np.ndarray) -> None:
    """Sets the temperature by examples that weren't fitted."""
    z = np.array([(n / n.sum()) @ model.logits[at] for at, n, _, _ in checked]) + model.bias
    grams = np.array([n.sum() for _, n, _, _ in checked])

    def loss(own: tuple[float, float]) -> float:
        model.temperature, model.short = map(float, own)
        return float(-np.log(np.maximum(model.probabilities(z, grams)[np.arange(len(y)), y], 1e-30)).mean())

    model.temperature, model.short = map(float, min(((t, s) for t in np.geomspace(0.1, 5, 25) for s in (0, *np.geomspace(1, 300, 15))), key=loss))


def packed(x: np.ndarray, steps: bool) -> bytes:
    """Buckets in ascending order as the steps between them (under 2 ** 16), or counts, deflated."""
    return zlib.compress((np.diff(x, prepend=0).astype("<u2") if steps else x.astype("<u4")).tobytes(), 1)


def unpacked(x: bytes, steps: bool) -> np.ndarray:
    """What was packed, in the smallest kind of numbers that holds it."""
    out = np.frombuffer(zlib.decompress(x), "<u2" if steps else "<u4")
    out = np.cumsum(out, dtype=np.uint32) if steps else out
    return out.astype(np.uint16 if steps else np.min_scalar_type(out.max(initial=0)))


def in_order(examples: list[Example]) -> list[Example]:
    """By label, part, checksum of the buckets and, among equals, buckets and counts: an order that doesn't depend on how rows came."""
    first = lambda x: (x[2] or "", x[3], zlib.crc32(x[0].astype("<u2").tobytes()))
    groups = itertools.groupby(sorted(examples, key=first), first)  # whole texts are compared where they may be equal alone
    return [x for _, own in groups for x in sorted(own, key=lambda x: (x[0].astype("<u2").tobytes(), x[1].astype("<u4").tobytes()))]


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def training_examples(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int, most: int) -> list[Example]:
    """The bounded sample: ids are chosen from ids and labels alone, then only their texts are read, and by executors."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = sampled_ids(labelled, doc_id, sample, by=lang, most_values=most)
    rows = labelled.join(F.broadcast(ids.distinct()), doc_id, "left_semi").groupBy(F.col(doc_id).alias("i")).agg(F.min(F.struct(F.col(text).alias("t"), F.col(lang).cast("string").alias("y"))).alias("x"))

    def run(batches):
        for batch in batches:
            out = []
            for t, y in zip(plain(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if _LETTER.search(own := t.as_py()):
                    out += examples_of(own, y)
            if out:
                told = lambda k, steps: pa.array([packed(x[k], steps) for x in out], pa.binary())
                yield pa.record_batch([told(0, True), told(1, False), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out])], names=["at", "n", "y", "checks"])

    found = rows.select("x.t", "x.y").mapInArrow(lean(run), "at binary, n binary, y string, checks boolean").toArrow()
    return in_order([(unpacked(a.as_py(), True), unpacked(n.as_py(), False), y.as_py(), c.as_py()) for a, n, y, c in zip(*(found.column(k) for k in range(4)), strict=True)])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int = MOST_LANGUAGES) -> Model | None:
    model = fit(training_examples(docs, doc_id, text, lang, sample, most))
    hand_back()  # the examples' memory
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with lang_pred, score and rejected (no letter, or a score under the threshold), in place of columns so named."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    docs = docs.drop(*(x for x in names if x != text))
    schema = StructType(list(docs.schema.fields)).add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    out = to_arrow_schema(schema)
    if model is None:
        return docs.select("*", F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in pieces(batches, text, 1 << 20):
            named, score, rejected = judged(texts, shared.value)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, out, strict=False)), pa.array(named, pa.string()), pa.array(score), pa.array(rejected)], schema=out)

    return docs.mapInArrow(lean(run), schema)


def judged(texts: pa.Array, m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language, score and rejection of each text."""
    bits = (len(m.logits) - 1).bit_length()
    data, offsets = raw(texts)
    sums = np.zeros((len(texts), m.logits.shape[1]))
    full = np.flatnonzero(np.diff(offsets) > 0)
    spaced = np.full(len(data) + 4 * len(texts), 32, np.uint8)
    own = np.repeat(4 * np.arange(len(texts)) + 1, np.diff(offsets))
    spaced[np.arange(len(data)) + own] = data  # " text   " for each text
    # grams that start in the spaces behind a text would reach into the next
    own = np.ones(len(spaced), bool)
    own[(offsets[1:] + 4 * np.arange(len(texts)))[:, None] + [1, 2, 3]] = False
    heads = offsets[:-1] + np.arange(len(texts))
    for hashed in buckets(np.concatenate([spaced, np.full(3, 32, np.uint8)]), bits):
        hashed = hashed[own]
        for k in range(sums.shape[1]):
            sums[:, k] += np.add.reduceat(m.logits[:, k][hashed], heads) if len(heads) else 0
    grams = 2.0 * (np.diff(offsets) + 1)
    p = m.probabilities(sums / grams[:, None] + m.bias, grams)[:, :-1]
    known = np.zeros(len(texts), bool)
    known[full] = [_LETTER.search(texts[int(i)].as_py()) is not None for i in full]
    named = [m.languages[k] if ok else "und" for k, ok in zip(p.argmax(axis=1), known, strict=True)]
    score = np.where(known, p.max(axis=1), 0.0)
    return named, score, ~known | (score < m.threshold)
