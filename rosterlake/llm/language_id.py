"""Operator 12: language identification of code-switched text by a linear-chain CRF.

Every word of a text gets a language.  A word's own evidence is the sum of learned
weights of its affixes, its character n-grams and the lexicons that hold it; learned
transitions between the languages of neighbouring words do the rest.  Forward-backward
gives each word its probabilities; a text's language is the one with the most expected
words.

A chain of any length is cut into blocks.  The transfer matrices of all blocks are
multiplied out side by side, the blocks' borders follow one another, and then all
blocks run forward and backward side by side from their borders: the same numbers as
a pass over the whole chain.  A text longer than PIECE characters goes piece by piece,
twice, so that memory is bounded by a piece.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rosterlake.llm.support import WORD_REGEX, text_of

#: Weights of hashed features, a power of two.
BUCKETS = 1 << 18
#: Words of a block; characters of a piece; characters that are handled at once.
BLOCK, PIECE, SLAB = 64, 1 << 20, 1 << 20
#: Longest affix and longest n-gram.
AFFIX, GRAM = 4, 4
SEED = 12
WORD = re.compile(WORD_REGEX)


class Crf(NamedTuple):
    """languages in code point order; weights (BUCKETS + languages, languages); log transitions; sorted lexicon words' hashes and their languages."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    lexicon_of: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _mix(h: np.ndarray) -> np.ndarray:
    """The last step of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def features(words: list[str], lexicon: np.ndarray, lexicon_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words: feature numbers one after the other, how many each word has, whether it has a letter, and its hash.

    Words are lower-cased and stand between two marks.  Features: n-grams of up to GRAM
    characters (those at the marks are the affixes), affixes of AFFIX characters and the
    whole word, hashed; and the number of its lexicon.
    """
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in map(str.lower, words)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w.lower()) for w in words], np.int64) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[word]
    lettered = np.logical_or.reduceat(_letters()[np.minimum(codes, 0x10FFFF)], starts) if len(words) else np.zeros(0, bool)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        one = _mix(codes.astype(np.uint64) * base)
        whole = _mix(np.add.reduceat(one * _mix(place.astype(np.uint64) + base), starts)) if len(words) else np.zeros(0, np.uint64)
        found, owner = [whole], [np.arange(len(words))]
        gram = np.zeros(len(codes), np.uint64)
        for n in range(1, GRAM + 1):
            gram = gram[: len(codes) - n + 1] * base + one[n - 1 :]
            inside = place[: len(gram)] + n <= sizes[word[: len(gram)]]
            if n == 1:
                inside &= codes > 3
            at = np.flatnonzero(inside)
            found.append(_mix(gram[at] + np.uint64(n)))
            owner.append(word[at])
        for end in (0, 1):  # affixes longer than the n-grams
            long = np.flatnonzero(sizes >= AFFIX + 3)
            first = starts[long] + (0 if end == 0 else sizes[long] - AFFIX - 1)
            h = np.zeros(len(long), np.uint64)
            for k in range(AFFIX + 1):
                h = h * base + one[first + k]
            found.append(_mix(h + np.uint64(17)))
            owner.append(long)
    hashed = [(h & np.uint64(BUCKETS - 1)).astype(np.int64) for h in found]
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == whole)
        hashed.append(BUCKETS + lexicon_of[at[known]])
        owner.append(known)
    numbers, owner = np.concatenate(hashed), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return numbers[order], np.bincount(owner, minlength=len(words)), lettered, whole


def emissions(words: list[str], model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of each word for each language, and whether it has a letter; equal words are worked out once."""
    table: dict[str, int] = {}
    at = np.array([table.setdefault(w, len(table)) for w in words], np.int64)
    score, lettered = [], []
    distinct = list(table)
    start = 0
    while start < len(distinct):  # n-grams of at most about SLAB characters at once
        end, size = start, 0
        while end < len(distinct) and size < SLAB // 8:
            size += len(distinct[end])
            end += 1
        numbers, counts, has, _ = features(distinct[start:end], model.lexicon, model.lexicon_of)
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sums = np.add.reduceat(model.weights[numbers], begins)
        score.append(sums / np.sqrt(counts)[:, None])
        lettered.append(has)
        start = end
    if not distinct:
        return np.zeros((0, len(model.languages))), np.zeros(0, bool)
    return np.concatenate(score)[at], np.concatenate(lettered)[at]


def _norm(m: np.ndarray) -> np.ndarray:
    """Rows scaled to the sum 1."""
    return m / m.reshape(len(m), -1).sum(1).reshape(-1, *[1] * (m.ndim - 1))


class _Blocks:
    """Chains of sizes words, one after the other in score, cut into blocks; longer blocks come first."""

    def __init__(self, score: np.ndarray, sizes: np.ndarray, transitions: np.ndarray):
        self.k, self.a = score.shape[1], np.exp(transitions)
        self.phi = np.exp(score - score.max(1, keepdims=True)) + 1e-30
        per = -(-sizes // BLOCK)
        chain = np.repeat(np.arange(len(sizes)), per)
        number = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(np.cumsum(sizes) - sizes, per) + number * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, per) - number * BLOCK)
        order = np.argsort(-length, kind="stable")
        self.chain, self.number, self.start, self.length = chain[order], number[order], start[order], length[order]
        self.active = [int((self.length > t).sum()) for t in range(int(self.length.max(initial=0)))]

    def products(self) -> np.ndarray:
        """The transfer matrix of each block: rows the label before it, columns that of its last word."""
        p = np.broadcast_to(np.eye(self.k), (len(self.start), self.k, self.k)).copy()
        for t, n in enumerate(self.active):
            p[:n] = _norm((p[:n].reshape(-1, self.k) @ self.a).reshape(n, self.k, self.k) * self.phi[self.start[:n] + t][:, None])
        return p

    def borders(self, p: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each block gets from its left and from its right; before and after: what each chain gets."""
        left, right = np.empty((2, len(self.start), self.k))
        at = np.argsort(self.number, kind="stable")
        parts = np.split(at, np.flatnonzero(np.diff(self.number[at])) + 1) if len(at) else []
        now = before.copy()
        for part in parts:
            left[part] = now[self.chain[part]]
            now[self.chain[part]] = _norm(np.einsum("bi,bij->bj", left[part], p[part]))
        now = after.copy()
        for part in reversed(parts):
            right[part] = now[self.chain[part]]
            now[self.chain[part]] = _norm(np.einsum("bij,bj->bi", p[part], right[part]))
        return left, right

    def marginals(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each word's probabilities."""
        out, now = np.empty_like(self.phi), left
        for t, n in enumerate(self.active):
            now = _norm((now[:n] @ self.a) * self.phi[self.start[:n] + t])
            out[self.start[:n] + t] = now
        now = right.copy()
        for t, n in reversed(list(enumerate(self.active))):
            at = self.start[:n] + t
            out[at] = _norm(out[at] * now[:n])
            now[:n] = _norm((self.phi[at] * now[:n]) @ self.a.T)
        return out


def marginals(score: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of the labels of each word of chains that stand one after the other.

    The weight of a labelling is exp of the sum of its words' scores and of the
    transitions between neighbours; before and after stand for words beyond the ends.
    """
    blocks = _Blocks(score, sizes, transitions)
    ends = np.ones((len(sizes), score.shape[1]))
    return blocks.marginals(*blocks.borders(blocks.products(), ends if before is None else before, ends if after is None else after))


def transfer(score: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The transfer matrix of one whole chain."""
    blocks = _Blocks(score, np.array([len(score)]), transitions)
    out = np.eye(score.shape[1])
    for p in blocks.products()[np.argsort(blocks.number)]:
        out = out @ p
        out /= out.sum()
    return out


def _pieces(text: str) -> Iterator[list[str]]:
    """The words of a long text, some PIECE characters at a time."""
    part, size = [], 0
    for found in WORD.finditer(text):
        part.append(found[0])
        size += len(found[0])
        if size >= PIECE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _long(text: str, model: Crf) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Words, probabilities and letters, piece by piece: a first pass for the borders, a second one for the words."""
    moves = [transfer(emissions(words, model)[0], model.transitions) for words in _pieces(text)]
    ends = [np.ones(len(model.languages))]
    for m in reversed(moves[1:]):
        ends.append(_norm((m @ ends[-1])[None])[0])
    before = np.ones(len(model.languages))
    for words, m, after in zip(_pieces(text), moves, reversed(ends)):
        score, lettered = emissions(words, model)
        yield words, marginals(score, np.array([len(words)]), model.transitions, before[None], after[None]), lettered
        before = _norm((before @ m)[None])[0]


def judged(texts: list[str], model: Crf) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(number of the text, some of its words, their probabilities, which have a letter), in order."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            for words, p, lettered in _long(texts[at], model):
                yield at, words, p, lettered
            at += 1
            continue
        end, size, words, sizes = at, 0, [], []
        while end < len(texts) and len(texts[end]) <= PIECE and size < SLAB:
            found = WORD.findall(texts[end])
            words += found
            sizes.append(len(found))
            size += len(texts[end])
            end += 1
        score, lettered = emissions(words, model)
        p = marginals(score, np.array(sizes), model.transitions)
        begin = 0
        for i, n in enumerate(sizes):
            yield at + i, words[begin : begin + n], p[begin : begin + n], lettered[begin : begin + n]
            begin += n
        at = end


def _lexicon(chains: list[tuple[list[str], int]], languages: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that one language has at least thrice and four times as often as the others together: hashes, sorted, and languages."""
    seen = [Counter() for _ in range(languages)]
    for words, label in chains:
        seen[label].update(w.lower() for w in words)
    all_words = sum(seen, Counter())
    own = [(c, w, k) for k, words in enumerate(seen) for w, c in words.items() if c >= 3 and c > 4 * (all_words[w] - c)]
    own = sorted(own, key=lambda x: (-x[0], x[1]))[:size]
    hashes = features([w for _, w, _ in own], np.zeros(0, np.uint64), np.zeros(0, np.int64))[3]
    order = np.argsort(hashes)
    return hashes[order], np.array([k for _, _, k in own], np.int64)[order]


def fit(chains: list[tuple[list[str], int]], languages: list[str], lexicon: int = 20_000, rounds: int = 6, rate: float = 0.25) -> Crf:
    """Weights and transitions of greatest conditional likelihood, by AdaGrad over batches of chains.

    chains: words of one language and its number.  Two chains in three are learned as
    they are; every third is cut at a random place and goes on with part of the next
    one, so that transitions between languages are learned too.
    """
    k, rng = len(languages), np.random.default_rng(SEED)
    hashes, of = _lexicon(chains, k, lexicon)
    weights, transitions = np.zeros((BUCKETS + k, k)), np.zeros((k, k))
    squares, moved = np.full_like(weights, 1e-3), np.full_like(transitions, 1.0)
    for _ in range(rounds):
        order = rng.permutation(len(chains))
        for begin in range(0, len(order), 256):
            words, labels, sizes = [], [], []
            batch = order[begin : begin + 256]
            for i, c in enumerate(batch):
                own, label = chains[c]
                parts = [(own, label)]
                if i % 3 == 2:
                    cut, (more, other) = rng.integers(1, len(own) + 1), chains[batch[i - 1]]
                    parts = [(own[:cut], label), (more[-rng.integers(1, len(more) + 1) :], other)]
                for w, y in parts:
                    words += w
                    labels += [y] * len(w)
                sizes.append(sum(len(w) for w, _ in parts))
            table: dict[str, int] = {}
            at = np.array([table.setdefault(w, len(table)) for w in words])
            numbers, counts, _, _ = features(list(table), hashes, of)
            root = np.sqrt(counts)[:, None]
            begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
            score = (np.add.reduceat(weights[numbers], begins) / root)[at]
            sizes, labels = np.array(sizes), np.array(labels)
            p = marginals(score, sizes, transitions)
            slope = np.eye(k)[labels] - p
            of_word = np.stack([np.bincount(at, slope[:, j], len(table)) for j in range(k)], 1) / root
            each = np.repeat(of_word, counts, axis=0)
            step = np.stack([np.bincount(numbers, each[:, j], len(weights)) for j in range(k)], 1)
            used = np.unique(numbers)
            squares[used] += step[used] ** 2
            weights[used] += rate * step[used] / np.sqrt(squares[used])
            # Neighbours within a chain: what is seen less what is expected.
            inner = np.setdiff1d(np.arange(1, len(words)), np.cumsum(sizes))
            seen = np.zeros((k, k))
            np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
            pull = (seen - _pairs(score, sizes, transitions, inner)) / len(sizes)
            moved += pull**2
            transitions += rate * pull / np.sqrt(moved)
    return Crf(languages, weights.astype(np.float32), transitions, hashes, of)


def _pairs(score: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected numbers of neighbouring labels: forward of the left word, transition, evidence and backward of the right one."""
    blocks = _Blocks(score, sizes, transitions)
    left, right = blocks.borders(blocks.products(), *np.ones((2, len(sizes), score.shape[1])))
    forward, backward, now = np.empty_like(blocks.phi), np.empty_like(blocks.phi), left
    for t, n in enumerate(blocks.active):
        now = _norm((now[:n] @ blocks.a) * blocks.phi[blocks.start[:n] + t])
        forward[blocks.start[:n] + t] = now
    now = right.copy()
    for t, n in reversed(list(enumerate(blocks.active))):
        backward[blocks.start[:n] + t] = now[:n]
        now[:n] = _norm((blocks.phi[blocks.start[:n] + t] * now[:n]) @ blocks.a.T)
    both = forward[inner - 1][:, :, None] * blocks.a * (blocks.phi * backward)[inner][:, None]
    return _norm(both).sum(0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", bound: int = 12_000, chain: int = 32, languages: int = 64) -> Crf | None:
    """A model from the texts of the rows whose lang is not null; None if no word can be learned from.

    bound: chains of at most chain words to learn from, dealt evenly over the languages;
    each is a stretch of one row's words, at a place that a hash of the text chooses, so
    what reaches the driver does not grow with the table.  Which rows, a hash of text and
    row decides.  languages: the most frequent values that are learned.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    share = max(bound // max(len(sizes), 1), 1)
    # A fifth more than the share, since the draw varies; languages with fewer rows give all.
    chance = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.2 * share / r["count"] + 1e-9, 1.0))]) if sizes else None
    if chance is None:
        return None
    drawn = known.where(F.rand(SEED) < F.coalesce(F.try_element_at(chance, "lang"), F.lit(0.0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            parts = []
            for t in texts:
                words = WORD.findall(t)
                first = int(_mix(np.array([len(words) * 31 + len(t)], np.uint64))[0] % np.uint64(max(len(words) - chain, 0) + 1))
                parts.append([w[:64] for w in words[first : first + chain]])
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.string())), batch.column(1)], names=["words", "lang"])

    rows = drawn.mapInArrow(cut, "words array<string>, lang string").where(F.size("words") > 0).toArrow()
    chains = sorted(zip(rows.column(1).to_pylist(), rows.column(0).to_pylist()))
    names = sorted({name for name, _ in chains})
    if not names:
        return None
    number = {name: i for i, name in enumerate(names)}
    return fit([(words, number[name]) for name, words in chains], names)


def predict(docs: DataFrame, model: Crf | None, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """docs' columns keep, then lang_pred, score and words_by_language (expected words of each language).

    Every word of a text of any length counts if it has a letter.  lang_pred is the
    language of most expected words (of equal ones the first in code point order), score
    its share of them.  A text that is null or has no letter, and any text where no model
    could be learned, is ``und`` with score 0.  Repeated rows are judged alike.
    """
    names = model.languages if model else []
    kept = len(keep)
    told = docs.sparkSession.sparkContext.broadcast(model)  # at most (BUCKETS + 64) x 64 floats, and the lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                sums = np.zeros((len(part), len(names)))
                if model:
                    for i, _, p, lettered in judged(part.column(kept).to_pylist(), model):
                        sums[i] += p[lettered].sum(0)
                total = sums.sum(1)
                best = sums.argmax(1) if names else np.zeros(len(part), int)
                found = total > 0
                score = np.where(found, sums[np.arange(len(part)), best] / np.where(found, total, 1), 0.0) if names else np.zeros(len(part))
                pred = [names[b] if f else "und" for b, f in zip(best, found)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:kept], pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(list(sums), pa.list_(pa.float64()))],
                    names=[*(f"k{i}" for i in range(kept)), "lang_pred", "score", "words_by_language"],
                )

    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "lang_pred string, score double, words_by_language array<double>"])
    out = docs.select(*own, text_of(text).alias("text")).mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "words_by_language")


def label_words(docs: DataFrame, model: Crf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per word: doc_id, position (from 0), word, lang, probability; words without a letter are labelled by their neighbours."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(told.value.languages, object)
        for batch in batches:
            texts, place = batch.column(1).to_pylist(), Counter()
            for i, words, p, _ in judged(texts, told.value):
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * n, pa.int64())), pa.array(np.arange(n) + place[i], pa.int64()), pa.array(words, pa.string()), pa.array(names[p.argmax(1)], pa.string()), pa.array(p.max(1))],
                    names=["doc_id", "position", "word", "lang", "probability"],
                )
                place[i] += n

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, f"doc_id {kind}, position long, word string, lang string, probability double")
