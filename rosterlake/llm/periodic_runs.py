"""Operator 11: maximal periodic runs of words by internal pattern matching.

A run with smallest period q repeats a stretch of at least q words, and so holds a
block of b words, b a power of two, at a multiple of b/2, whose next copy stands q
words on.  For each level b, blocks ask for their occurrences in the neighbouring
windows, those q = 1.5b - 1 to 3b - 2 words on (1 to 10 for the smallest b, 4).  All
occurrences of a block are an interval of the suffix array; a wavelet matrix over it
finds the first, last and number of those in a window by range successor.  In a window
of b/2 starts they form an arithmetic progression, whose members give the candidate
periods.  Candidates that lie in one periodic stretch with their block are multiples of
its period and are left out before the progression is written out.  The rest are
extended to both sides; what is long enough is a run.

The suffix array comes from prefix doubling, and its rounds' classes are kept: they
name the intervals of the blocks, and tell how far two places agree.  Only places whose
class has other members take part in a round.  Texts are handled side by side, the
words of different texts being different letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.llm.support import WORD_REGEX, text_of

#: Words that are handled side by side; a longer text stands alone.
SLAB = 1 << 18
#: Words of the smallest block, and least length of a run.
SMALL, LEAST = 4, 12
WORD = re.compile(WORD_REGEX)


class Runs(NamedTuple):
    """start, length and period of runs, by start and then period; text: the number of the text of each."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class Level(NamedTuple):
    """Places (rising) whose next 2^k words occur elsewhere too, the first rank of their class, and the class's size."""

    place: np.ndarray
    rank: np.ndarray
    size: np.ndarray


def doubling(letters: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """Rank of every suffix, and the levels of 1, 2, 4 ... letters up to the longest repeat."""
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    rank = np.empty(n, np.int64)
    levels: list[Level] = []

    def classes(places: np.ndarray, keys: list[np.ndarray], first: np.ndarray) -> Level:
        """Places in the order of their keys; first: the first rank of the old class.  Ranks are written, members returned."""
        new = np.ones(len(places), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(places)))
        old = np.ones(len(places), bool)
        old[1:] = first[1:] != first[:-1]
        at = np.flatnonzero(old)
        offset = begin - np.repeat(at, np.add.reduceat(new.astype(np.int64), at)) if len(places) else begin
        ranks = np.repeat((first[begin] if len(places) else first) + offset, size)
        rank[places] = ranks
        many = np.repeat(size, size) > 1
        held = places[many]
        up = np.argsort(held, kind="stable")
        return Level(held[up], ranks[many][up], np.repeat(size, size)[many][up])

    level = classes(order, [letters[order]], np.zeros(n, np.int64))
    width = 1
    while len(level.place):
        levels.append(level)
        after = level.place + width
        second = np.where(after < n, rank[np.minimum(after, max(n - 1, 0))], -1)
        order = np.lexsort((second, level.rank))
        level = classes(level.place[order], [level.rank[order], second[order]], level.rank[order])
        width *= 2
    return rank, levels


class Agreement:
    """How many letters agree from two places on, or before them, by the levels' classes."""

    def __init__(self, n: int, levels: list[Level]):
        self.n, self.levels, self.dense = n, levels, []
        for level in levels:
            table = None
            if len(level.place) * 4 > n:  # else a binary search saves the memory
                table = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
                table[level.place] = level.rank
            self.dense.append(table)

    def _same(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inside = (a >= 0) & (b >= 0) & (a < self.n) & (b < self.n)
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        if self.dense[k] is not None:
            x, y = self.dense[k][a], self.dense[k][b]
            return inside & (x == y) & (x >= 0)
        level = self.levels[k]
        i, j = (np.minimum(np.searchsorted(level.place, p), len(level.place) - 1) for p in (a, b))
        return inside & (level.place[i] == a) & (level.place[j] == b) & (level.rank[i] == level.rank[j])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, start = a.copy(), b.copy(), a
        for k in reversed(range(len(self.levels))):
            step = self._same(k, a, b).astype(np.int64) << k
            a += step
            b += step
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters that agree just before the places."""
        a, b, start = a.copy(), b.copy(), a
        for k in reversed(range(len(self.levels))):
            step = self._same(k, a - (1 << k), b - (1 << k)).astype(np.int64) << k
            a -= step
            b -= step
        return start - a


class Wavelet:
    """Bits of values, the highest first, each level ordered by the bits above; counts of ones by words of 64."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(values.max(initial=0)).bit_length(), 1)
        self.words, self.ones, self.zeros = [], [], []
        for b in reversed(range(self.bits)):
            bit = (values >> b & 1).astype(bool)
            packed = np.zeros(-(-(len(bit) + 1) // 64) * 8, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[: len(some)] = some
            words = packed.view("<u8")
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int((~bit).sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before the places."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.ones[level][word] + np.bitwise_count(below)

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values of each range [lo, hi) are less than value."""
        found = np.zeros(len(lo), np.int64)
        beyond = value >> self.bits > 0
        total = hi - lo
        value = np.maximum(value, 0)
        for level in range(self.bits):
            one = (value >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._rank(level, lo), self._rank(level, hi)
            found += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return np.where(beyond, total, found)

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range."""
        found = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            a, b = self._rank(level, lo), self._rank(level, hi)
            zeros = (hi - b) - (lo - a)
            one = k >= zeros
            k = np.where(one, k - zeros, k)
            found += one.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return found


def candidates(level: Level, block: int, base: np.ndarray, wavelet: Wavelet, agree: Agreement) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks and periods at which they occur again, of one level; base: the sorted ranks of the wavelet's places."""
    low, high = (1, 10) if block == SMALL else (3 * block // 2 - 1, 3 * block - 2)
    mine = level.place % (block // 2) == 0
    place, rank, size = level.place[mine], level.rank[mine], level.size[mine]
    lo = np.searchsorted(base, rank)
    hi = lo + size
    # The next occurrence: if it overlaps by half, the block is periodic, and so is what follows, for as long as the two agree.
    later = wavelet.below(lo, hi, place + 1)
    some = later < size
    place, lo, hi, size, later = (x[some] for x in (place, lo, hi, size, later))
    own = wavelet.nth(lo, hi, later) - place
    together = np.where(own <= block // 2, own + agree.forward(place, place + own) - block, 0)
    found, periods = [], []
    for start in range(low, high + 1, block // 2 + 1):
        end = min(start + block // 2, high)
        before, through = wavelet.below(lo, hi, place + start), wavelet.below(lo, hi, place + end + 1)
        at = np.flatnonzero(through > before)
        if not len(at):
            continue
        count = through[at] - before[at]
        first = wavelet.nth(lo[at], hi[at], before[at]) - place[at]
        last = wavelet.nth(lo[at], hi[at], through[at] - 1) - place[at]
        step = np.where(count > 1, (last - first) // np.maximum(count - 1, 1), 1)
        # Members after the block's own period that lie in its periodic stretch.
        skipped = np.where(together[at] >= first, np.minimum((together[at] - first) // step + 1, count), 0)
        kept = count - skipped
        itself = (skipped > 0) & (first == own[at])
        found.append(place[at[itself]])
        periods.append(own[at[itself]])
        member = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
        found.append(np.repeat(place[at], kept))
        periods.append(np.repeat(first + skipped * step, kept) + member * np.repeat(step, kept))
    none = np.zeros(0, np.int64)
    return (np.concatenate(found), np.concatenate(periods)) if found else (none, none)


def find_runs(letters: np.ndarray, bounds: np.ndarray) -> Runs:
    """All runs of texts that stand side by side in letters; text i has the places bounds[i] to bounds[i + 1].

    No letter may occur in two texts.  A run is as long as its period allows, at least
    LEAST and twice its smallest period.
    """
    n, none = len(letters), np.zeros(0, np.int64)
    rank, levels = doubling(letters)
    small = SMALL.bit_length() - 1
    if len(levels) <= small:
        return Runs(none, none, none, none)
    agree = Agreement(n, levels)
    # The suffix array of the places whose first SMALL words repeat: no other is in a class of a block.
    places = levels[small].place
    places = places[np.argsort(rank[places], kind="stable")]
    base, wavelet = rank[places], Wavelet(places)
    starts, ends, periods = [], [], []
    for k in range(small, len(levels)):
        at, q = candidates(levels[k], 1 << k, base, wavelet, agree)
        left = at - agree.backward(at, at + q)
        right = at + q + agree.forward(at, at + q)
        good = right - left >= np.maximum(LEAST, 2 * q)
        starts.append(left[good])
        ends.append(right[good])
        periods.append(q[good])
    start, end, q = map(np.concatenate, (starts, ends, periods))
    # Of equal stretches the smallest period counts; the others are its multiples.
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    start, end, q = start[order], end[order], q[order]
    text = np.searchsorted(bounds, start, side="right") - 1
    return Runs(text, start - bounds[text], end - start, q)


def _read(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word numbers of texts side by side, the distinct words, and the bounds of the texts."""
    table: dict[str, int] = {}
    parts = [np.fromiter((table.setdefault(m[0], len(table)) for m in WORD.finditer(t)), np.int64) for t in texts]
    return np.concatenate(parts), list(table), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _joined(numbers: np.ndarray, words: list[str]) -> str:
    return " ".join([" ".join([words[i] for i in numbers[at : at + 100_000].tolist()]) for at in range(0, len(numbers), 100_000)])


def _handled(texts: list[str]) -> tuple[Runs, list[str]]:
    """Runs and collapsed texts."""
    numbers, words, bounds = _read(texts)
    text_at = np.repeat(np.arange(len(texts)), np.diff(bounds))
    runs = find_runs(text_at * len(words) + numbers, bounds)
    # A word goes if it is in a run after the run's first period: +1 where such a part begins, -1 where it ends.
    gone = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(gone, bounds[runs.text] + runs.start + runs.period, 1)
    np.add.at(gone, bounds[runs.text] + runs.start + runs.length, -1)
    kept = np.cumsum(gone[:-1]) == 0
    return runs, [_joined(numbers[a:b][kept[a:b]], words) for a, b in zip(bounds, bounds[1:])]


def periodic_runs(docs: DataFrame, text: str | Column = "text", keep: list[str] = ()) -> DataFrame:
    """docs' columns keep, then runs and collapsed.

    runs: array<struct<start long, length long, period long>> of all runs of the whole
    text's words, by start and then period; collapsed: the words without those that a run
    holds after its first period, joined by one space.  A null text is an empty one: no
    words, no runs, an empty collapsed text.  Each row is handled by itself, so ties,
    repeated rows and null ids need no rule, and an empty table gives an empty one.  A
    text of any length is handled in one task, in memory in proportion to its words.
    """
    kept = len(keep)
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.utf8_length(batch.column(kept)))
            begin = 0
            while begin < len(batch):
                # As many texts as have SLAB words at most, at two characters a word, but one at least.
                fit = int(np.searchsorted(np.cumsum(sizes[begin : begin + 4096]), 2 * SLAB, side="right"))
                part = batch.slice(begin, max(fit, 1))
                runs, collapsed = _handled(part.column(kept).to_pylist())
                counts = np.bincount(runs.text, minlength=len(part))
                structs = pa.StructArray.from_arrays([pa.array(x) for x in runs[1:]], fields=list(item))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], lists, pa.array(collapsed, pa.string())], names=[*(f"k{i}" for i in range(kept)), "runs", "collapsed"])
                begin += max(fit, 1)

    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"])
    out = docs.select(*own, text_of(text).alias("text")).mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "runs", "collapsed")
