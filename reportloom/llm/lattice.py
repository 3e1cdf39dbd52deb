"""Subword lattices of many words at once, over a given vocabulary of pieces.

A word is a row of code points; a lattice's arcs are the pieces found at its positions, and a single character always has
an arc of its own (its bytes, where it isn't a piece). Words of one length are handled together, an array operation for
each arc of the lattice: forward sums in log space, forward-backward counts, or the best path (max-plus). Words longer
than ``LONG`` go one by one through the same recursions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .common import ragged

MARK = 0x2581
#: Stands for a literal U+2581 of a text, which must not read as a space mark; no piece holds it.
LITERAL_MARK = 0x110000
LONG = 48
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@dataclass
class Words:
    """Code points of many units end to end; spaces are marks, and literal marks are kept apart."""

    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, units: list[str]) -> Words:
        flat = codes_of("".join(units)).copy()
        flat[flat == MARK] = LITERAL_MARK
        flat[flat == 32] = MARK
        return cls(flat, np.fromiter(map(len, units), np.int64, len(units)))

    @classmethod
    def plain(cls, units: list[str]) -> Words:
        """Code points as they are."""
        return cls(codes_of("".join(units)), np.fromiter(map(len, units), np.int64, len(units)))

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.sizes)


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray  # ids of the 256 byte pieces
    normal: np.ndarray  # ids that lattices use

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        other = [i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
        normal = np.setdiff1d(np.arange(n), other)
        return cls(pieces, scores, byte_ids, normal)

    @cached_property
    def tables(self) -> tuple:
        """Open addressing: a key lies in the first free slot from its own on; a table of an eighth filled at most."""
        normal = self.normal
        words = Words.plain([self.pieces[i] for i in normal])
        keys = _mix(np.concatenate([np.zeros(0, np.uint64), *(_prefixes(codes)[:, -1] for _, codes in by_length(words))]))
        normal = normal[np.concatenate([np.zeros(0, np.int64), *(some for some, _ in by_length(words))])]
        bits = max(4, (8 * len(keys)).bit_length())
        shift, last = np.uint64(64 - bits), (1 << bits) - 1
        slots, ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        at, left = (keys >> shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[slots[at[left]] == 0]
            spot, pick = np.unique(at[free], return_index=True)
            slots[spot], ids[spot] = keys[free[pick]], normal[free[pick]]
            left = np.setdiff1d(left, free[pick])
            at[left] = np.where(slots[at[left]] == 0, at[left], (at[left] + 1) & last)
        return slots, ids, shift

    @cached_property
    def longest(self) -> int:
        return max(len(self.pieces[i]) for i in self.normal)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        slots, ids, shift = self.tables
        at = (hashes >> shift).astype(np.int64)
        held = slots[at]
        out = np.full(hashes.shape, -1, np.int32)
        hit = held == hashes
        out[hit] = ids[at[hit]]
        left = np.flatnonzero((held != 0) & ~hit)
        at, want = at.ravel()[left], hashes.ravel()[left]
        flat = out.ravel()
        while len(left):
            at = (at + 1) & (len(slots) - 1)
            held = slots[at]
            hit = held == want
            flat[left[hit]] = ids[at[hit]]
            more = (held != 0) & ~hit
            left, at, want = left[more], at[more], want[more]
        return out


def _prefixes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
    return out


_POWER = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(64, _BASE, np.uint64)]))


def utf8_of(code: int) -> bytes:
    return chr(MARK if code == LITERAL_MARK else code).encode("utf-8", "surrogatepass")


def arcs(codes: np.ndarray, vocabulary: Vocabulary):
    """For words of one length (a row each): (j, lo, ids) of every end j; ids[:, i - lo] is the piece of i..j, or -1."""
    length = codes.shape[1]
    prefix = _prefixes(codes)
    for j in range(1, length + 1):
        lo = max(0, j - vocabulary.longest)
        yield j, lo, vocabulary.find(_mix(prefix[:, j, None] - prefix[:, lo:j] * _POWER[j - np.arange(lo, j)]))


def weights_of(ids: np.ndarray, wide: np.ndarray, alone) -> np.ndarray:
    """The weights of the arcs that end at one place; a last character that is no piece weighs ``alone``."""
    weight = wide[ids]
    weight[:, -1] = np.where(ids[:, -1] < 0, alone, weight[:, -1])
    return weight


def byte_scores(codes: np.ndarray, scores: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The sum of the scores of each code point's bytes."""
    own = scores[vocabulary.byte_ids]
    c = np.where(codes == LITERAL_MARK, MARK, codes).astype(np.int64)
    out = np.where(c < 0x80, own[c & 0x7F], 0.0)
    tail = own[0x80 | (c & 0x3F)]
    two = own[np.minimum(0xC0 | (c >> 6), 255)] + tail
    three = own[np.minimum(0xE0 | (c >> 12), 255)] + own[0x80 | ((c >> 6) & 0x3F)] + tail
    four = own[np.minimum(0xF0 | (c >> 18), 255)] + own[0x80 | ((c >> 12) & 0x3F)] + own[0x80 | ((c >> 6) & 0x3F)] + tail
    return np.select([c < 0x80, c < 0x800, c < 0x10000], [out, two, three], four)


def by_length(words: Words, most: int = 1 << 14):
    """(indexes, codes) of words of one length, at most ``most`` at a time (fewer long ones)."""
    order = np.argsort(words.sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(words.sizes[order])) + 1
    for part in np.split(order, cuts):
        if len(part) and (size := int(words.sizes[part[0]])) > 0:
            step = max(1, min(most, (most * 8) // size))
            for k in range(0, len(part), step):
                some = part[k : k + step]
                yield some, words.flat[words.starts[some][:, None] + np.arange(size)]


def forward(codes: np.ndarray, scores: np.ndarray, vocabulary: Vocabulary, found=None) -> np.ndarray:
    """Log of the summed weight of all segmentations up to each position, in log space; scores are natural logs."""
    n, length = codes.shape
    alone = byte_scores(codes, scores, vocabulary)
    alpha = np.full((n, length + 1), -np.inf)
    alpha[:, 0] = 0
    wide = np.concatenate([scores, [-np.inf]])
    for j, lo, ids in found or arcs(codes, vocabulary):
        x = alpha[:, lo:j] + weights_of(ids, wide, alone[:, j - 1])
        top = x.max(axis=1)
        alpha[:, j] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
    return alpha


def _long_forward(codes: np.ndarray, scores: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The same for one word of any length: the last ``longest`` sums are enough for each."""
    alone = byte_scores(codes, scores, vocabulary)
    wide = np.concatenate([scores, [-np.inf]])
    reach = vocabulary.longest
    alpha = np.full(len(codes) + 1, -np.inf)
    alpha[0] = 0
    for at, ids in windows(codes, vocabulary):
        for k in range(len(ids)):
            j = at + k + 1
            lo = max(0, j - reach)
            weight = wide[ids[k, reach - (j - lo) :]]
            if ids[k, -1] < 0:
                weight[-1] = alone[j - 1]
            x = alpha[lo:j] + weight
            top = x.max()
            alpha[j] = top + np.log(np.exp(x - top).sum())
    return alpha


def _long_expected(out: np.ndarray, codes: np.ndarray, times: float, scores: np.ndarray, vocabulary: Vocabulary, step: int = 1 << 12) -> None:
    """Adds the expected counts of one word of any length: forward sums are kept, then stretches go from last to first."""
    alone = byte_scores(codes, scores, vocabulary)
    wide = np.concatenate([scores, [-np.inf]])
    reach = vocabulary.longest
    alpha = _long_forward(codes, scores, vocabulary)
    beta = np.full(len(codes) + 1, -np.inf)
    beta[-1] = 0
    # row j: the sums up to the ``reach`` places before j
    before = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(reach, -np.inf), alpha]), reach)
    for at in reversed(range(0, len(codes), step)):
        upto = min(len(codes), at + step)
        ids = window(codes, vocabulary, at, upto)
        weight, odd = wide[ids], ids[:, -1] < 0
        weight[odd, -1] = alone[at:upto][odd]
        for k in reversed(range(len(ids))):
            j = at + k + 1
            lo = max(0, j - reach)
            beta[lo:j] = np.logaddexp(beta[lo:j], weight[k, reach - (j - lo) :] + beta[j])
        share = times * np.exp(before[at + 1 : upto + 1] + weight + beta[at + 1 : upto + 1, None] - alpha[-1])
        known = ids >= 0
        out += np.bincount(ids[known], share[known], len(out))
        _count_bytes(out, codes[at:upto][odd], share[odd, -1], vocabulary)


def windows(codes: np.ndarray, vocabulary: Vocabulary, step: int = 1 << 12):
    """(at, ids) by stretches: ids[k, -m] is the piece of the m characters that end with character at + k."""
    for at in range(0, len(codes), step):
        yield at, window(codes, vocabulary, at, min(len(codes), at + step))


def window(codes: np.ndarray, vocabulary: Vocabulary, at: int, upto: int) -> np.ndarray:
    """The ids of one stretch."""
    reach = vocabulary.longest
    lo = max(0, at - reach + 1)
    own = codes[lo:upto].astype(np.uint64) + np.uint64(1)
    ids = np.full((upto - at, reach), -1, np.int32)
    rolled = np.zeros(len(own), np.uint64)
    for m in range(1, reach + 1):
        if len(own) < m:
            break
        # hashes of the m characters from each start
        rolled = (rolled[: len(own) - m + 1] * _BASE) + own[m - 1 :]
        ends = lo + m - 1 + np.arange(len(rolled))
        ok = ends >= at
        ids[ends[ok] - at, reach - m] = vocabulary.find(_mix(rolled[ok]))
    return ids


def marginals(words: Words, scores: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The log of the summed weight of all segmentations of each word."""
    out = np.zeros(len(words))
    for some, codes in by_length(words):
        if codes.shape[1] > LONG:
            out[some] = [_long_forward(c, scores, vocabulary)[-1] for c in codes]
        else:
            out[some] = forward(codes, scores, vocabulary)[:, -1]
    return out


def expected(words: Words, weights: np.ndarray, scores: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Expected counts of pieces over all segmentations of the words, weighted."""
    out = np.zeros(len(scores))
    wide = np.concatenate([scores, [-np.inf]])
    for some, codes in by_length(words):
        times, length = weights[some], codes.shape[1]
        alone = byte_scores(codes, scores, vocabulary)
        if length > LONG:
            for word, n in zip(codes, times, strict=True):
                _long_expected(out, word, n, scores, vocabulary)
            continue
        found = list(arcs(codes, vocabulary))
        alpha = forward(codes, scores, vocabulary, found)
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0
        for j, lo, ids in reversed(found):
            weight = weights_of(ids, wide, alone[:, j - 1])
            back = weight + beta[:, j, None]
            share = times[:, None] * np.exp(alpha[:, lo:j] + back - alpha[:, -1:])
            known = ids >= 0
            out += np.bincount(ids[known], share[known], len(out))
            odd = ~known[:, -1]
            _count_bytes(out, codes[odd, j - 1], share[odd, -1], vocabulary)
            beta[:, lo:j] = np.logaddexp(beta[:, lo:j], back)
    return out


def _count_bytes(out: np.ndarray, codes: np.ndarray, share: np.ndarray, vocabulary: Vocabulary) -> None:
    for code, n in _summed(codes, share):
        for b in utf8_of(code):
            out[vocabulary.byte_ids[b]] += n


def _summed(codes: np.ndarray, share: np.ndarray):
    if len(codes) == 0:
        return []
    own, back = np.unique(codes, return_inverse=True)
    return zip(own.tolist(), np.bincount(back, share).tolist(), strict=True)


def best_paths(words: Words, scores: np.ndarray, vocabulary: Vocabulary, unknown: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each word's best segmentation, end to end, how many each has, and the paths' scores. Among equal sums the
    longer last piece wins. A character that is no piece costs ``unknown`` and gives its byte pieces."""
    sizes, totals = np.zeros(len(words), np.int64), np.zeros(len(words))
    found: list[tuple[np.ndarray, np.ndarray]] = []  # (words, their ids end to end)
    wide = np.concatenate([scores, [-np.inf]])
    for some, codes in by_length(words):
        n, length = codes.shape
        if length > LONG:
            for w, word in zip(some, codes, strict=True):
                totals[w], path = long_best(word, scores, vocabulary, unknown)
                ids = spelled(word, path, vocabulary)
                sizes[w] = len(ids)
                found.append((np.array([w]), ids))
            continue
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back_id, back_at = np.full((length + 1, n), -1, np.int32), np.zeros((length + 1, n), np.int32)
        rows = np.arange(n)
        for j, lo, ids in arcs(codes, vocabulary):
            total = best[:, lo:j] + weights_of(ids, wide, unknown)
            k = total.argmax(axis=1)  # the first: the longest last piece
            best[:, j], back_at[j], back_id[j] = total[rows, k], lo + k, ids[rows, k]
        totals[some] = best[:, -1]
        # backtrace of all words at once, from their ends
        at, steps = np.full(n, length), []
        while (at > 0).any():
            piece = back_id[at, rows].astype(np.int64)
            piece = np.where(piece < 0, -3 - codes[rows, np.maximum(at - 1, 0)].astype(np.int64), piece)
            steps.append(np.where(at > 0, piece, -1))
            at = np.where(at > 0, back_at[at, rows], 0)
        path = np.stack(steps[::-1], axis=1)
        count = (path != -1).sum(axis=1)
        ids = path[path != -1]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            lengths = np.ones(len(ids), np.int64)
            spelt = [vocabulary.byte_ids[list(utf8_of(int(-3 - ids[k])))] for k in odd]
            lengths[odd] = list(map(len, spelt))
            heads = np.cumsum(lengths) - lengths
            whole = np.repeat(ids, lengths)
            for k, own in zip(odd, spelt, strict=True):
                whole[heads[k] : heads[k] + len(own)] = own
            count = np.add.reduceat(lengths, np.cumsum(count) - count)
            ids = whole
        sizes[some] = count
        found.append((some, ids))
    out = np.zeros(int(sizes.sum()), np.int32)
    starts = np.cumsum(sizes) - sizes
    for some, ids in found:
        out[ragged(starts[some], sizes[some])] = ids
    return out, sizes, totals


def long_best(codes: np.ndarray, scores: np.ndarray, vocabulary: Vocabulary, unknown: float) -> tuple[float, list[tuple[int, int, int]]]:
    """Best path of one word of any length, as (start, end, id or -1)."""
    reach, wide = vocabulary.longest, np.concatenate([scores, [-np.inf]])
    best = np.full(len(codes) + 1, -np.inf)
    best[0] = 0
    from_, ids_ = np.zeros(len(codes) + 1, np.int64), np.full(len(codes) + 1, -1, np.int64)
    for at, ids in windows(codes, vocabulary):
        for k in range(len(ids)):
            j = at + k + 1
            lo = max(0, j - reach)
            row = ids[k, reach - (j - lo) :]
            weight = wide[row]
            if row[-1] < 0:
                weight[-1] = unknown
            x = best[lo:j] + weight
            m = int(x.argmax())
            best[j], from_[j], ids_[j] = x[m], lo + m, row[m]
    path, at = [], len(codes)
    while at > 0:
        path.append((int(from_[at]), at, int(ids_[at])))
        at = int(from_[at])
    return float(best[-1]), path[::-1]


def spelled(codes: np.ndarray, path: list[tuple[int, int, int]], vocabulary: Vocabulary) -> np.ndarray:
    """Ids of a path; byte pieces where it has no piece."""
    out: list[int] = []
    for i, _, piece in path:
        if piece >= 0:
            out.append(piece)
        else:
            out += vocabulary.byte_ids[list(utf8_of(int(codes[i])))].tolist()
    return np.array(out, np.int32)
