"""Secret scans: three patterns, and a linear-chain conditional random field that adds to them.

Patterns (leftmost, not overlapping, per kind): an assignment of 6 characters or more to a secret's name, an access key of
20 or more, a hexadecimal run of 24 or more. The field tags the words of a text as begin, inside or outside of a secret.
A word's features are small numbers found for all words at once: length, case, digits, hexadecimal and symbol shape,
quotes, an assignment sign, a secret's name in it, and those of the words before and after; beside them stand file
features (how dense digits and symbols are in the text). Each feature's weights are a table, so a word costs a few
gathers. It is trained in numpy by gradient steps on the log likelihood, on silver labels: the patterns' own matches in
at most ``SAMPLE`` documents, in the order of their id's hash, as they are and in ``VARIANTS`` forms that the patterns miss:
the cue dropped or put in other words, and the value drawn anew (shorter, in another case or alphabet, with a prefix or
dashes). So it has to learn from shape and surroundings what the patterns find by name. Decoding is by Viterbi, over the stretches of words that may
stand in a run of tags other than outside which gains by them: a bound on every run that holds the word, so the tags are
those of decoding whole texts. Tagged spans lose quotes and punctuation at their ends; one that holds more than the
patterns' matches, beside white space and punctuation, is added whole, so it may overlap them.

Plan. Documents aren't shuffled: training reads the sampled ones alone, scanning is one pass. The model is of fixed size.

Defined results: a null text is empty and holds no secret; offsets are code points of the whole text, end exclusive;
equal rows keep a row each; with no secret in the sample the field adds nothing.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, hand_back, lean, pieces, raw, sampled_ids

#: Documents that training may read, and stretches of words that it may fit.
SAMPLE = 20_000
STRETCHES = 4000
#: Distorted copies of each match that training sees.
VARIANTS = 4
#: Copies of a stretch of each text with an ordinary shape put in.
PLAINER = 2
KINDS = ("assign", "access", "hex", "crf")
_NAMES = rb"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = re.compile(rb"(" + _NAMES + rb")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_NAME = re.compile(_NAMES)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # the longest runs, as a run never starts inside another
_HINTS = (b"passw", b"secret", b"token", b"api")

SIZES = {"length": 8, "digits": 4, "upper": 4, "lower": 3, "hex": 2, "symbols": 3, "quote": 2, "sign": 2, "name": 2, "other": 2, "switches": 4}
PLACES = (-1, 0, 1)
FILE_SIZES = {"digits": 4, "symbols": 4}


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in bytes."""
    out = []
    low = data.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    return sorted(out)


_CLASS = np.zeros((256, 7), np.int32)  # digit, upper, lower, hexadecimal, symbol, quote, sign
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = [_s.isdigit(), "A" <= _s <= "Z", "a" <= _s <= "z", _s in "0123456789abcdef", _s in "#*$%&|<>!+/_-", _s in "\"'`", _s in "=:"]
_LETTER_DIGIT = np.where(_CLASS[:, 0] > 0, 1, np.where(_CLASS[:, 1] + _CLASS[:, 2] > 0, -1, 0)).astype(np.int8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # words a text
    features: np.ndarray  # a column a feature
    files: np.ndarray  # a column a file feature, a row a text


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words (runs without white space) of texts that lie end to end, with their features."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inside[heads]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = ends - starts
    sums = []
    for k in range(_CLASS.shape[1]):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_CLASS[:, k].astype(np.int8)[data], out=total[1:])
        sums.append((total[ends] - total[starts], total[offsets[1:]] - total[offsets[:-1]]))
    digit, upper, lower, hexa, symbol, quote, sign = (s[0] for s in sums)
    named = np.zeros(len(starts), np.int32)
    joined = data.tobytes()
    low = joined.lower()
    if any(h in low for h in _HINTS):
        at = np.array([m.start() for m in _NAME.finditer(joined)], np.int64)
        if len(at):
            named[np.searchsorted(starts, at, side="right") - 1] = 1
    mixed = np.maximum(n, 1)
    # how often a word changes between digits and letters
    kind = _LETTER_DIGIT[data]
    change = np.zeros(len(data) + 1, np.int32)
    np.cumsum((kind[1:] * kind[:-1]) < 0, out=change[1 : len(data)] if len(data) else change[:0])
    if len(data):
        change[len(data)] = change[len(data) - 1]
    switched = change[np.maximum(ends - 1, starts)] - change[starts]
    features = np.stack([
        np.searchsorted([4, 8, 12, 16, 20, 28, 48], n, side="right"),
        np.where(digit == 0, 0, np.where(4 * digit < mixed, 1, np.where(digit < mixed, 2, 3))),
        np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper < mixed, 2, 3))),
        np.where(lower == 0, 0, np.where(lower < mixed, 1, 2)),
        (hexa >= mixed - 2 * (quote > 0)) & (digit > 0) & (hexa > 4),
        np.minimum(symbol, 2),
        np.minimum(quote, 1),
        np.minimum(sign, 1),
        named,
        digit + upper + lower + symbol + quote + sign < n,
        np.searchsorted([1, 2, 5], switched, side="right"),
    ], axis=1).astype(np.int32)
    size = np.maximum(np.diff(offsets), 1)
    files = np.stack([np.searchsorted([1, 10, 50], 1000 * s // size, side="right") for s in (sums[0][1].astype(np.int64), sums[4][1].astype(np.int64))], axis=1)
    return Words(starts, ends, np.diff(np.searchsorted(starts, offsets)), features, files.astype(np.int32))


@dataclass
class Field:
    """Weights: a row a feature value (at each place), then file values; a column a tag (outside, begin, inside)."""

    emit: np.ndarray
    step: np.ndarray

    @staticmethod
    def rows(words: Words) -> np.ndarray:
        """For each word the rows of ``emit`` that it adds up."""
        shifts = np.cumsum([0, *SIZES.values()])
        width = shifts[-1] + 1  # the last value: no such word
        n = len(words.starts)
        own = words.features + shifts[:-1]
        ends = np.cumsum(words.counts)
        out = []
        for k, place in enumerate(PLACES):
            x = np.full_like(own, width - 1)
            if place == 0:
                x = own
            elif place < 0:
                x[1:] = own[:-1]
                x[(ends - words.counts)[words.counts > 0]] = width - 1
            else:
                x[:-1] = own[1:]
                x[(ends - 1)[words.counts > 0]] = width - 1
            out.append(x + k * width)
        files = np.cumsum([0, *FILE_SIZES.values()])[:-1] + words.files + len(PLACES) * width
        out.append(np.repeat(files, words.counts, axis=0))
        return np.concatenate(out, axis=1) if n else np.zeros((0, own.shape[1] * len(PLACES) + len(FILE_SIZES)), np.int64)

    def tables(self) -> list[np.ndarray]:
        """For each place the summed weights of every combination of feature values; the last row: no such word."""
        if not hasattr(self, "_tables"):
            shape, shifts, self._tables = tuple(SIZES.values()), np.cumsum([0, *SIZES.values()]), []
            for k in range(len(PLACES)):
                own = self.emit[k * (shifts[-1] + 1) : (k + 1) * (shifts[-1] + 1)]
                total = np.zeros((*shape, 3))
                for f, size in enumerate(shape):
                    total += own[shifts[f] : shifts[f] + size].reshape([size if g == f else 1 for g in range(len(shape))] + [3])
                self._tables.append(np.concatenate([total.reshape(-1, 3), len(shape) * own[-1:]]))
        return self._tables

    def emissions(self, words: Words) -> np.ndarray:
        """The summed weights of each word's rows, by one look-up a place."""
        code = np.zeros(len(words.starts), np.int32)
        for f, size in enumerate(SIZES.values()):
            code = code * np.int32(size) + words.features[:, f]
        before, own, after = self.tables()
        ends, some = np.cumsum(words.counts), words.counts > 0
        e = own[code]
        left, right = np.full_like(code, len(own) - 1), np.full_like(code, len(own) - 1)
        left[1:], right[:-1] = code[:-1], code[1:]
        left[(ends - words.counts)[some]] = right[(ends - 1)[some]] = len(own) - 1
        e += before[left]
        e += after[right]
        base = len(PLACES) * (sum(SIZES.values()) + 1)
        files = self.emit[np.cumsum([0, *FILE_SIZES.values()])[:-1] + words.files + base].sum(axis=1)
        return e + np.repeat(files, words.counts, axis=0)

    @staticmethod
    def height() -> int:
        return len(PLACES) * (sum(SIZES.values()) + 1) + sum(FILE_SIZES.values())


#: Log weights of tag steps that can't be: inside never follows outside, nor starts a text.
_NEVER = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])


def train(sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """The field of sequences of (rows of each word, tags): full-batch gradient steps with Adagrad."""
    field = Field(np.zeros((Field.height(), 3)), np.zeros((3, 3)))
    if not sequences:
        return field
    most = max(len(y) for _, y in sequences)
    n = len(sequences)
    size = np.array([len(y) for _, y in sequences])
    rows = np.zeros((n, most, sequences[0][0].shape[1]), np.int16)
    tags = np.zeros((n, most), np.int64)
    for k, (x, y) in enumerate(sequences):
        rows[k, : len(y)], tags[k, : len(y)] = x, y
    real = np.arange(most) < size[:, None]
    seen_e, seen_s = np.full_like(field.emit, 1e-8), np.full_like(field.step, 1e-8)
    one = np.eye(3)
    truth = np.zeros_like(field.emit)
    for tag in range(3):
        here = real & (tags == tag)
        truth[:, tag] = np.bincount(rows[here].ravel(), minlength=len(truth))
    pairs = real[:, 1:]
    truth_s = np.einsum("nti,ntj->ij", one[tags[:, :-1]] * pairs[..., None], one[tags[:, 1:]])
    total = real.sum()

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    for _ in range(epochs):
        e = np.zeros((n, most, 3))
        for k in range(rows.shape[2]):  # a feature at a time: memory of one table, not of all
            e += field.emit[rows[:, :, k]]
        step = field.step + _NEVER
        a = np.zeros((n, most, 3))
        a[:, 0] = e[:, 0] + [0, 0, -1e9]
        for t in range(1, most):
            a[:, t] = np.where(real[:, t, None], lse(a[:, t - 1, :, None] + step, 1) + e[:, t], a[:, t - 1])
        z = lse(a[:, -1], 1)
        b = np.zeros((n, most, 3))
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(real[:, t + 1, None], lse(step + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), b[:, t + 1])
        p = np.exp(a + b - z[:, None, None]) * real[..., None]
        grad, own, share = np.zeros_like(truth), rows[real], p[real]
        for k in range(rows.shape[2]):
            for tag in range(3):
                grad[:, tag] += np.bincount(own[:, k], share[:, tag], len(truth))
        joint = np.exp(a[:, :-1, :, None] + step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        grad, grad_s = (grad - truth) / total + decay * field.emit, (joint.sum(axis=(0, 1)) - truth_s) / total + decay * field.step
        seen_e += grad**2
        seen_s += grad_s**2
        field.emit -= rate * grad / np.sqrt(seen_e)
        field.step -= rate * grad_s / np.sqrt(seen_s)
    return field


def viterbi(e: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best tags of one stretch that starts and ends outside."""
    n = len(e)
    back = np.zeros((n, 3), np.int64)
    (s00, s01, _), (s10, s11, s12), (s20, s21, s22) = (step + _NEVER).tolist()
    rows = e.tolist()
    o, b, i = s00 + rows[0][0], s01 + rows[0][1], -1e18
    for t in range(1, n):
        eo, eb, ei = rows[t]
        to, tb, ti = (o + s00, b + s10, i + s20), (o + s01, b + s11, i + s21), (-1e18, b + s12, i + s22)
        ko, kb, ki = to.index(max(to)), tb.index(max(tb)), ti.index(max(ti))
        back[t] = ko, kb, ki
        o, b, i = to[ko] + eo, tb[kb] + eb, ti[ki] + ei
    last = [o + s00, b + s10, i + s20]
    tag = last.index(max(last))
    out = np.zeros(n, np.int64)
    for t in range(n - 1, -1, -1):
        out[t] = tag
        tag = back[t, tag]
    return out


def tagged(words: Words, field: Field) -> list[tuple[int, int]]:
    """(first, last) word of each tagged span, by position among all words."""
    if len(words.starts) == 0:
        return []
    e = field.emissions(words)
    steps = field.step + _NEVER
    steps = steps - steps[0, 0]
    gain = max(0.0, float(steps.max()))
    over = np.maximum(e[:, 1], e[:, 2]) - e[:, 0]
    # a run of n words between outside ones changes n + 1 steps: with two gains a word none without a promising word can win
    hope = np.flatnonzero(over + 2 * gain > 0)
    if len(hope) == 0:
        return []
    ends = np.cumsum(words.counts)
    inner, edges = float(steps[1:, 1:].max()), float(steps[0, 1] + steps[1:, 0].max())
    out = []
    for t in np.unique(np.searchsorted(ends, hope, side="right")).tolist():
        lo, hi = int(ends[t] - words.counts[t]), int(ends[t])
        for a, b in _stretches(over[lo:hi] + inner, edges - inner):
            tags = viterbi(e[lo + a : lo + b], field.step)
            for k in np.flatnonzero(tags == 1).tolist():
                end = k + 1
                while end < b - a and tags[end] == 2:
                    end += 1
                out.append((lo + a + k, lo + a + end - 1))
    return out


def _stretches(gains: np.ndarray, edges: float) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a text's words that some run of words holds whose gains and ``edges`` sum to 0 or
    more; a run in which they don't is beaten by outside tags, so all words elsewhere are outside."""
    upto = np.concatenate([[0.0], np.cumsum(gains)])
    lowest, highest = np.minimum.accumulate(upto[:-1]), np.maximum.accumulate(upto[:0:-1])[::-1]
    slack = 1e-9 * (1 + np.abs(upto).max())
    held = np.concatenate([[False], highest - lowest + edges >= -slack, [False]])
    at = np.flatnonzero(held[1:] != held[:-1])
    return list(zip(at[::2].tolist(), at[1::2].tolist(), strict=True))


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: How a distorted match's value may look: (alphabet, least and greatest length, letters of a prefix, length of dashed groups).
VALUES = (
    ("0123456789abcdef", 14, 23, 0, 0), ("0123456789ABCDEF", 20, 48, 0, 0), (_ALNUM, 16, 44, 0, 0), (_ALNUM + "+/", 24, 64, 0, 0), (_ALNUM + "_-", 20, 48, 0, 0),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 28, 0, 0), (_ALNUM, 18, 40, 3, 0), ("abcdefghijklmnopqrstuvwxyz0123456789", 20, 40, 2, 0), ("0123456789abcdef", 32, 36, 0, 8),
)


def distorted(rng: np.random.Generator) -> str:
    """A secret that the patterns miss, alone or after a cue that they don't know."""
    letters, least, most, prefix, group = VALUES[rng.integers(len(VALUES))]
    value = "".join(rng.choice(list(letters), rng.integers(least, most + 1)))
    if group:
        value = "-".join(value[k : k + group] for k in range(0, len(value), group))
    low = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    value = (low(prefix) + rng.choice(["_", "-"]) if prefix else "") + value
    cue = rng.choice(["", "", "", "=", ": ", ' = "', "word "])
    if cue == "":
        return value
    return (low(rng.integers(3, 9)) if cue != "word " else rng.choice(["token is ", "secret -> ", "password was ", "api key is "])) + ("" if cue == "word " else cue) + value + ('"' if '"' in cue else "")


def _tagged_words(words: Words, spans: list[tuple[int, int]]) -> np.ndarray:
    tags = np.zeros(len(words.starts), np.int64)
    for start, end in spans:
        lo = int(np.searchsorted(words.ends, start, side="right"))
        hi = int(np.searchsorted(words.starts, end, side="left"))
        tags[lo:hi] = 2
        tags[lo : lo + 1] = 1
    return tags


def ordinary(rng: np.random.Generator) -> str:
    """A text of a shape that secrets share and that is none: a time, date, DOI, ISBN, address, path, version, short commit id,
    number or name in code."""
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    low = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    part = lambda: str(rng.integers(0, 40))
    day = f"{rng.integers(1950, 2060)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    clock = f"{rng.integers(24):02d}:{rng.integers(60):02d}:{rng.integers(60):02d}"
    time = lambda: day + rng.choice(["T", "T", " "]) + clock + rng.choice(["", "Z", "Z", f".{digits(3)}Z", "+02:00"])
    kinds = [
        *[time] * 4,
        lambda: f"10.{digits(rng.integers(4, 6))}/{rng.choice([low(6), low(1)])}.{rng.choice([digits(4) + '.' + digits(5), digits(7), low(4) + digits(3)])}",
        lambda: f"97{rng.choice(['8', '9'])}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: f"https://{low(rng.integers(4, 10))}.{rng.choice(['com', 'org', 'net'])}/{low(5)}/{rng.choice([digits(6), low(8)])}" + rng.choice(["", f"?id={digits(5)}", ".html"]),
        lambda: "/" + "/".join(low(rng.integers(2, 9)) for _ in range(rng.integers(2, 5))) + rng.choice(["", ".txt", ".py", ".tar.gz"]),
        lambda: rng.choice(["", "v"]) + f"{part()}.{part()}.{part()}" + rng.choice(["", "-rc1", f"-beta.{part()}", "+build"]),
        lambda: "".join(rng.choice(list("0123456789abcdef"), rng.integers(7, 13))),
        lambda: rng.choice(["#", "", "No. "]) + digits(rng.integers(3, 12)),
        lambda: "_".join(low(rng.integers(3, 8)) for _ in range(rng.integers(2, 4))) + rng.choice(["", "()", digits(1)]),
        lambda: f"{low(5)}.{low(6)}@{low(6)}.com",
        lambda: f"+{digits(2)} {digits(3)} {digits(7)}",
    ]
    return rng.choice(["", "", "", "(", "date: ", "version = ", "id: ", "see "]) + kinds[rng.integers(len(kinds))]() + rng.choice(["", "", ",", ".", ")"])


def sequences_of(texts: pa.Array, around: int = 12, variants: int = VARIANTS, make=distorted, plainer: int = PLAINER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training stretches: words around each match, the same with a distorted match, and words around some that have a
    digit, quote or symbol or are long where there is no match."""
    data, offsets = raw(texts)
    words = words_of(data, offsets)
    rows = Field.rows(words)
    joined = data.tobytes()
    found = [[(int(offsets[t]) + start, int(offsets[t]) + end) for start, _, end in base_spans(joined[int(offsets[t]) : int(offsets[t + 1])])] for t in range(len(texts))]
    tags = _tagged_words(words, [span for own in found for span in own])
    ends = np.cumsum(words.counts)
    out = []
    odd = (words.features[:, 1] > 0) | (words.features[:, 5] > 0) | (words.features[:, 6] > 0) | (words.features[:, 0] > 4)
    for t in range(len(texts)):
        lo, hi = int(ends[t] - words.counts[t]), int(ends[t])
        seeds = np.flatnonzero(tags[lo:hi] == 1).tolist() or (np.flatnonzero(odd[lo:hi])[:: max(1, int(odd[lo:hi].sum()) // 3)]).tolist() or ([0] if hi > lo else [])
        for s in seeds:
            # never start inside a span
            a, b = max(lo, lo + s - around), min(hi, lo + s + around + 1)
            while a > lo and tags[a] == 2:
                a -= 1
            out.append((rows[a:b], tags[a:b]))
        if hi > lo:  # ordinary shapes among words of the text, none of which is a secret
            middle = lo + (hi - lo) // 2
            near = [k for k in range(max(lo, middle - around), min(hi, middle + around)) if tags[k] == 0]
            said = [joined[words.starts[k] : words.ends[k]] for k in near]
            rng = np.random.default_rng(zlib.crc32(b" ".join(said)))
            for _ in range(plainer):
                cut = int(rng.integers(len(said) + 1))
                mini = np.frombuffer(b" ".join([*said[:cut], ordinary(rng).encode(), *said[cut:]]), np.uint8)
                own = words_of(mini, np.array([0, len(mini)]))
                own.files = words.files[t : t + 1]
                out.append((Field.rows(own), _tagged_words(own, [])))
        for start, end in found[t]:
            rng = np.random.default_rng(zlib.crc32(joined[start:end]))
            first, last = int(np.searchsorted(words.ends, start, side="right")), int(np.searchsorted(words.starts, end, side="left"))
            # whole words around the match, other matches among them left out
            before = [k for k in range(max(lo, first - around), first) if tags[k] == 0]
            after = [k for k in range(last, min(hi, last + around)) if tags[k] == 0]
            said = lambda some: b"".join(joined[words.starts[k] : words.ends[k]] + b" " for k in some)
            for _ in range(variants):
                head, new = said(before), make(rng).encode()
                mini = np.frombuffer(head + new + b" " + said(after), np.uint8)
                own = words_of(mini, np.array([0, len(mini)]))
                own.files = words.files[t : t + 1]  # the whole text's
                out.append((Field.rows(own), _tagged_words(own, [(len(head), len(head) + len(new))])))
    return out


def train_field(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, stretches: int = STRETCHES) -> Field:
    """Trains on stretches of at most ``sample`` documents; executors cut them out."""
    ids = sampled_ids(docs.filter(F.col(text).isNotNull()), doc_id, sample).distinct()
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(ids.withColumnRenamed(doc_id, "_id")), "_id", "left_semi")
    width = len(SIZES) * len(PLACES) + len(FILE_SIZES)

    def run(batches):
        for _, texts in pieces(batches, "_t", 1 << 19):
            # all stretches with a secret; one in four of the others, by what they say and not by where they lie
            found = [(x, y) for x, y in sequences_of(texts) if y.any() or zlib.crc32(np.asarray(x, "<i2").tobytes()) % 4 == 0]
            if found:
                yield pa.record_batch([pa.array([np.asarray(z, "<i2").tobytes() for z in c], pa.binary()) for c in zip(*found, strict=True)], names=["x", "y"])

    # small numbers as bytes: what comes to the driver is a few MB; those with a secret, the fewer, first
    rows = base.select("_t").mapInArrow(lean(run), "x binary, y binary").distinct()
    plain_tags = F.length(F.replace(F.hex("y"), F.lit("0"), F.lit(""))) == 0
    rows = rows.orderBy(plain_tags, F.xxhash64("x", "y"), "x", "y").limit(stretches).toArrow()
    both = (rows["x"].to_pylist(), rows["y"].to_pylist())
    field = train([(np.frombuffer(x, "<i2").reshape(-1, width), np.frombuffer(y, "<i2")) for x, y in zip(*both, strict=True)])
    hand_back()
    return field


_TRIM = b"\"'`,;:.!?()[]{}<>|="
_BLANK = _TRIM + b"#*$%& \t\n\v\f\r"


def scan(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans, n_tagged) of every row: spans are (kind, start, end) by start, then kind; code points, end exclusive.
    n_tagged counts the field's spans, those among them that add nothing to a pattern's match too."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>, n_tagged long"
    out = arrow_type(schema)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch, texts in pieces(batches, "_t"):
            spans, n_tagged = tagged_spans(texts, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, out.field("spans").type), pa.array(n_tagged)], schema=out)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).mapInArrow(lean(run), schema)


def _beyond(part: bytes, matches: list[tuple[int, int]]) -> bool:
    """Whether a part holds more than the matches that touch it (by start), white space and punctuation."""
    at = 0
    for start, end in matches:
        if part[at : max(at, start)].strip(_BLANK):
            return True
        at = max(at, end)
    return bool(part[at:].strip(_BLANK))


def spans_of(texts: pa.Array, field: Field) -> list[list[dict]]:
    return tagged_spans(texts, field)[0]


def tagged_spans(texts: pa.Array, field: Field) -> tuple[list[list[dict]], np.ndarray]:
    """The spans of each text, and how many the field tags in it."""
    data, offsets = raw(texts)
    joined = data.tobytes()
    words = words_of(data, offsets)
    cuts = offsets.tolist()
    found = [base_spans(joined[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    n_tagged = np.zeros(len(texts), np.int64)
    for lo, hi in tagged(words, field):
        a, b = int(words.starts[lo]), int(words.ends[hi])
        t = int(np.searchsorted(offsets, a, side="right")) - 1
        n_tagged[t] += 1
        part = joined[a:b]
        a += len(part) - len(part.lstrip(_TRIM))
        b = a + len(part.strip(_TRIM))
        a, b = a - cuts[t], b - cuts[t]
        if _beyond(joined[cuts[t] + a : cuts[t] + b], [(s - a, e - a) for s, k, e in found[t] if k < 3 and s < b and e > a]):
            found[t].append((a, 3, b))
    out = []
    for t, spans in enumerate(found):
        if not spans:
            out.append([])
            continue
        # code points before each byte of the text: all bytes but those that go on with a character
        point = np.concatenate([[0], np.cumsum((data[cuts[t] : cuts[t + 1]] & 0xC0) != 0x80)])
        out.append([{"kind": KINDS[k], "start": int(point[s]), "end": int(point[e])} for s, k, e in sorted(spans)])
    return out, n_tagged


def redacted(docs: DataFrame, field: Field, text: str = "text", mark: str = "[SECRET]", extra: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``extra``, where there is such a column, holds the new length."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.schema
    out = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch, texts in pieces(batches, text):
            columns = [c.cast(f.type) for c, f in zip(batch.columns, out, strict=True)]
            spans = spans_of(texts, shared.value)
            if any(spans):
                values, sizes = batch.column(text).to_pylist(), batch.column(extra).to_pylist() if extra in out.names else None
                for i, own in enumerate(spans):
                    if own:
                        values[i] = _replaced(values[i], own, mark)
                        if sizes:
                            sizes[i] = len(values[i])
                columns[out.get_field_index(text)] = pa.array(values, out.field(text).type)
                if sizes:
                    columns[out.get_field_index(extra)] = pa.array(sizes, out.field(extra).type)
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.mapInArrow(lean(run), schema)


def _replaced(text: str, spans: list[dict], mark: str) -> str:
    parts, at = [], 0
    for s in spans:  # by start; spans of two kinds may overlap and then share a mark
        if s["start"] >= at:
            parts += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])
