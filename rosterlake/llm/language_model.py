"""Operator 9: language-model scoring with a weighted backoff automaton.

The model interpolates n-grams up to an order (3 in the query).  A state is a
history of fewer words that training has at least twice; its arcs go to the words
seen after it and carry log10 of the interpolated probability; a failure arc leads
to the state of the history without its first word and carries log10(lambda).  The
root's arcs are the smoothed unigrams.  Lambda depends on the order and on how
often the history was seen (powers of two): the Good-Turing share of unseen mass,
of the tokens after such histories those whose n-gram is seen once.  A text is read
once from left to right: the state is carried, failure arcs are followed until the
state has an arc for the token, and the weights are added.

The model grows with the corpus and is never gathered in one place.  Tasks turn the
texts into blocks of some megabytes, written once as numbers: the text itself is
read once and never shuffled.  A block asks, for each distinct n-gram that it holds,
how often the training texts have it; the questions go to buckets of the key space,
packed in arrays, and each bucket answers every block.  Words and pairs are asked
first; an n-gram of three or more only where its history is a state and what it ends
in was seen.  Then each block has the part of the automaton that its texts can
reach.  A key is a 64-bit hash of a word; that of an n-gram is cut to 20 bits more than
number the corpus's tokens, so that an n-gram which training lacks is taken for
another with a probability of a millionth or less, and the arrays stay small.  A hot
word costs one number per block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from rosterlake.llm.support import materialize, text_of

#: Words of the longest n-gram.
ORDER = 3
#: Bytes of text in a block, about.
BLOCK_BYTES = 8_000_000
#: Tokens of the corpus for each bucket of the key space, about.
BUCKET_TOKENS = 1_500_000
#: Blocks that ask a bucket by themselves; more of them ask in pools of about so many.
POOL = 4096
#: Added to each unigram count.
ADD = 0.1
#: Histories fall into bins by the power of two of their count.
BINS = 48
#: A history is a state from so many occurrences on, two or more: after one occurrence all mass is unseen.
LEAST = 2
#: Tokens of a document that one lane of the traversal reads; the last words before it are read again.
LANE = 1024

QUESTION = "block long, bucket int, n int, keys binary, counts binary, bins binary, stats array<long>"
ANSWER = "block long, bucket int, n int, totals binary, stats array<long>"
_QUESTION = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("bins", pa.binary()), ("stats", pa.list_(pa.int64()))]
)
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("totals", pa.binary()), ("stats", pa.list_(pa.int64()))])


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers byte plane by byte plane, compressed: planes of equal or few values take little room."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.dtype.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def narrow(counts: np.ndarray) -> bytes:
    """Counts packed in the fewest bytes that hold the largest, up to eight."""
    return pack(counts.astype(np.min_scalar_type(int(counts.max(initial=0)))))


def widen(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel().astype(np.int64)


def key_mask(tokens: int) -> np.uint64:
    """The leading bits of an n-gram's hash that are its key: 20 more than number the tokens of the corpus, in whole bytes."""
    spare = 64 - min(64, -(-(tokens.bit_length() + 20) // 8) * 8)
    return np.uint64((1 << 64) - (1 << spare))


def bin_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1, BINS - 1).astype(np.uint8)


class Block:
    """Some documents' tokens: ids into the block's own vocabulary, 0 the end and 1 the start of a text."""

    #: Neither can be a word, as both are white space.
    MARKS = (b"\n", b"\r")

    def __init__(self, number: int, sizes: np.ndarray, held: np.ndarray, tokens: np.ndarray, hashes: np.ndarray, mask: np.uint64):
        self.mask = mask
        self.number, self.sizes, self.tokens, self.hashes = number, sizes, tokens.astype(np.int32), hashes
        self.words = len(hashes)
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.place = np.arange(len(tokens), dtype=np.int32) - np.repeat(self.first.astype(np.int32), sizes)
        self.history = np.empty_like(self.tokens)
        self.history[1:] = self.tokens[:-1]
        self.history[self.first] = 1
        self.trained = np.repeat(~held, sizes)

    @classmethod
    def of_row(cls, row: dict, mask: np.uint64) -> Block:
        return cls(
            row["block"], unpack(row["sizes"], 8).astype(np.int64), np.array(row["held"], bool),
            unpack(row["tokens"], 4), np.frombuffer(row["hashes"], "<u8"), mask,
        )

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """The values of the tokens before; at_start at a text's first token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_start
        return out

    def hash(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams that end at the tokens at."""
        last = self.hashes[self.tokens[at]]
        if n == 1:
            return last
        start = self.hashes[self.history[at]] if n == 2 else self.hash(n - 1, at - 1)
        with np.errstate(over="ignore"):
            keys = start * np.uint64(0x9E3779B97F4A7C15) + last
            keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return keys ^ (keys >> np.uint64(32))

    def unigrams(self) -> Grams:
        """The words of the vocabulary but the start, in the order of their hashes."""
        ids = np.delete(np.arange(self.words), 1)
        order = ids[np.argsort(self.hashes[ids], kind="stable")]
        rank = np.full(self.words, -1, np.int32)
        rank[order] = np.arange(len(order))
        counts = np.bincount(self.tokens[self.trained], minlength=self.words)[order]
        return Grams(rank[self.tokens], self.hashes[order], counts, order)

    def grams(self, n: int, prior: np.ndarray, asked: np.ndarray) -> Grams:
        """Distinct n-grams at the tokens asked; prior numbers their histories."""
        at = np.flatnonzero(asked)
        code = prior[at].astype(np.int64) * self.words + self.tokens[at]
        _, one, which = np.unique(code, return_index=True, return_inverse=True)
        del code
        counts = np.bincount(which[self.trained[at]], minlength=len(one))
        keys = self.hash(n, at[one]) & self.mask
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        of_token = np.full(len(self.tokens), -1, np.int32)
        of_token[at] = rank[which]
        return Grams(of_token, keys[order], counts[order], at[one][order])


@dataclass
class Grams:
    """Distinct n-grams of a block by sorted key: rank at each token (-1: none), keys, counts in the block's training texts,
    and a token where each ends (for words, their ids)."""

    of_token: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    one: np.ndarray

    def questions(self, block: int, n: int, buckets: int, bins: np.ndarray | None = None) -> list[dict]:
        """A row for each bucket that has keys."""
        bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        names, starts = np.unique(bucket, return_index=True)
        return [
            {
                "block": block, "bucket": b, "n": n, "keys": pack(np.diff(self.keys[x:y], prepend=np.uint64(0))),
                "counts": narrow(self.counts[x:y]), "bins": b"" if bins is None else pack(bins[x:y]), "stats": None,
            }
            for b, x, y in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(self.keys)])
        ]


def _together(asked: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with keys: each row's keys, all distinct keys in order, their counts added up, and their bins (empty without)."""
    keys = [np.cumsum(unpack(r["keys"], 8), dtype=np.uint64) for r in asked]
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(every), np.int64)
    np.add.at(totals, which, np.concatenate([widen(r["counts"], len(k)) for r, k in zip(asked, keys)]))
    bins = np.zeros(0, np.int64)
    if asked[0]["bins"]:
        bins = np.zeros(len(every), np.int64)
        bins[which] = np.concatenate([unpack(r["bins"], 1) for r in asked])
    return keys, every, totals, bins


def pooled(questions: pa.Table) -> pa.Table:
    """The questions of a pool of blocks to one bucket as one row, which asks in the pool's name."""
    rows = questions.to_pylist()
    asked, given = [r for r in rows if r["keys"]], [np.array(r["stats"]) for r in rows if r["stats"] is not None]
    row = {"block": rows[0]["pool"], "bucket": rows[0]["bucket"], "n": rows[0]["n"], "keys": b"", "counts": b"", "bins": b"", "stats": sum(given).tolist() if given else None}
    if asked:
        _, every, totals, bins = _together(asked)
        row |= {"keys": pack(np.diff(every, prepend=np.uint64(0))), "counts": narrow(totals), "bins": pack(bins.astype(np.uint8)) if len(bins) else b""}
    return pa.Table.from_pylist([row], schema=_QUESTION)


def handed(questions: pa.Table, told: pa.Table) -> pa.Table:
    """What a pool was told, for each of its blocks."""
    asked, out = [r for r in questions.to_pylist() if r["keys"]], []
    if asked:
        keys, every, _, _ = _together(asked)
        totals = widen(told.to_pylist()[0]["totals"], len(every))
        for r, k in zip(asked, keys):
            out.append({"block": r["block"], "bucket": r["bucket"], "n": r["n"], "totals": narrow(totals[np.searchsorted(every, k)]), "stats": [len(k)]})
    return pa.Table.from_pylist(out, schema=_ANSWER)


def answer(questions: pa.Table) -> pa.Table:
    """Adds up the counts of each key over all blocks and tells every block its keys' totals.

    Statistics, in a row of block -1: for words the distinct keys and their tokens
    that occur at all; for n-grams, by bin of their history, the tokens and those of
    n-grams seen once.  Statistics that blocks send are added.  The stats of any other
    row are the number of its totals.
    """
    rows = questions.to_pylist()
    n, bucket = rows[0]["n"], rows[0]["bucket"]
    asked = [r for r in rows if r["keys"]]
    stats = np.zeros(2 if n == 1 else 2 * BINS, np.int64)
    for r in rows:
        if r["stats"] is not None:
            stats += r["stats"]
    out = []
    if asked:
        keys = [np.cumsum(unpack(r["keys"], 8), dtype=np.uint64) for r in asked]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        counts = np.concatenate([widen(r["counts"], len(k)) for r, k in zip(asked, keys)])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every = every[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        totals = np.add.reduceat(counts[order], np.flatnonzero(new))
        which = np.empty_like(order)
        which[order] = np.cumsum(new) - 1
        if n == 1:
            stats += (totals > 0).sum(), totals.sum()
        elif asked[0]["bins"]:
            bins = np.zeros(len(totals), np.int64)
            bins[which] = np.concatenate([unpack(r["bins"], 1) for r in asked])
            np.add.at(stats, bins, totals)
            np.add.at(stats, BINS + bins[totals == 1], 1)
        told = totals[which]
        for r, k, end in zip(asked, keys, ends):
            out.append({"block": r["block"], "bucket": bucket, "n": n, "totals": narrow(told[end - len(k) : end]), "stats": [len(k)]})
    out.append({"block": -1, "bucket": bucket, "n": n, "totals": b"", "stats": stats.tolist()})
    return pa.Table.from_pylist(out, schema=_ANSWER)


class Counts:
    """What a block has been told up to some order: by order, the training count of the n-gram that ends at each token (at) and of its history (history)."""

    def __init__(self, block: Block, answers: pa.Table, order: int):
        self.block = block
        parts: dict[int, list[np.ndarray]] = defaultdict(list)
        for r in sorted(answers.to_pylist(), key=lambda r: r["bucket"]):
            parts[r["n"]].append(widen(r["totals"], r["stats"][0]))
        told = {n: np.concatenate(p) for n, p in parts.items()}
        del parts
        words = block.unigrams()
        self.grams, self.at = {1: words}, {1: told[1][words.of_token]}
        #: Training texts: each has one end.
        self.texts = int(told[1][words.of_token[block.sizes[0] - 1]])
        self.history = {2: block.before(self.at[1], self.texts)}
        for n in range(2, order + 1):
            self.ask(n)
            totals = np.zeros(len(block.tokens), np.int64)
            asked = self.grams[n].of_token >= 0
            totals[asked] = told.get(n, totals)[self.grams[n].of_token[asked]]
            self.at[n] = totals
            self.history[n + 1] = np.where(block.place >= n - 1, block.before(totals, 0), 0)

    def ask(self, n: int) -> Grams:
        """The n-grams to ask for: all pairs; of longer ones those whose history is a state and whose end was seen."""
        if n == 2:
            self.grams[2] = self.block.grams(2, self.block.history, np.ones(len(self.block.tokens), bool))
        else:
            seen = (self.history[n] >= LEAST) & (self.at[n - 1] > 0)
            self.grams[n] = self.block.grams(n, self.block.before(self.grams[n - 1].of_token, -1), seen)
        return self.grams[n]

    def pair_statistics(self) -> list[int]:
        """By bin of the word before, the number of training tokens after a state, and of those whose pair is seen once."""
        bins = bin_of(self.history[2])
        after = (self.history[2] >= LEAST) & self.block.trained
        tokens, once = (np.bincount(bins[x], minlength=BINS) for x in (after, after & (self.at[2] == 1)))
        return [*tokens.tolist(), *once.tolist()]


@dataclass(frozen=True)
class Smoothing:
    """What all blocks share: training tokens, distinct words, and by order the failure weight of each bin."""

    tokens: int
    distinct: int
    keep: dict[int, np.ndarray]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.tokens + ADD * (self.distinct + 1))


class Automaton:
    """The part of the backoff automaton that one block's texts can reach.

    A state is named by the number of words of its history; at each token stand the
    arcs that the histories before it have.  has[n]: whether the history of n - 1 words
    has an arc for the token; weight[n]: that arc's weight; goal[n]: the state that it
    leads to; failure[n]: the weight of the history's failure arc.
    """

    def __init__(self, counts: Counts, smoothing: Smoothing, order: int):
        self.block, self.order = counts.block, order
        share = smoothing.unigram(counts.at[1])
        everywhere = np.ones(len(share), bool)
        self.has, self.weight, self.failure = {1: everywhere}, {1: np.log10(share)}, {}
        self.base = self.weight[1]
        goal = np.where(counts.at[1] >= LEAST, 1, 0) if order > 1 else np.zeros(len(share), np.int64)
        self.goal = {1: goal}
        for n in range(2, order + 1):
            state = counts.history[n] >= LEAST
            keep = np.where(state, smoothing.keep[n][bin_of(counts.history[n])], 1.0)
            share = np.where(state, (1 - keep) * counts.at[n] / np.maximum(counts.history[n], 1) + keep * share, share)
            self.has[n] = state & (counts.at[n] > 0)
            self.weight[n] = np.log10(share)
            self.failure[n] = np.log10(keep)
            if n < order:
                goal = np.where(self.has[n] & (counts.at[n] >= LEAST), n, goal)
            self.goal[n] = goal
        self.start = 1 if order > 1 and counts.texts >= LEAST else 0

    def traverse(self) -> np.ndarray:
        """The weight added at each token, texts read from left to right with the state carried.

        Many lanes read at a time; a long text is cut, and a lane that begins inside a
        text first reads the order - 1 tokens before, after which its state is the same.
        """
        block, warm = self.block, self.order - 1
        cuts = (block.sizes - 1) // LANE + 1
        text = np.repeat(np.arange(len(cuts)), cuts)
        lane = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        skip = np.where(lane > 0, warm, 0)
        begin = block.first[text] + lane * LANE - skip
        steps = np.minimum(block.sizes[text] - lane * LANE, LANE) + skip
        longest = np.argsort(-steps, kind="stable")
        begin, steps, skip = begin[longest], steps[longest], skip[longest]
        state = np.where(skip > 0, 0, self.start) if warm else np.zeros(len(begin), np.int64)
        running = np.searchsorted(-steps, -np.arange(steps.max(initial=0)), side="left")
        out = np.zeros(len(block.tokens))
        for t, m in enumerate(running.tolist()):
            at = begin[:m] + t
            now, weight, after = state[:m], np.zeros(m), np.zeros(m, np.int64)
            open_ = np.ones(m, bool)
            for n in range(self.order, 0, -1):
                here = open_ & (now == n - 1)
                taken = here & self.has[n][at]
                weight += np.where(taken, self.weight[n][at], 0.0)
                after = np.where(taken, self.goal[n][at], after)
                open_ &= ~taken
                if n > 1:
                    failed = here & ~taken
                    weight += np.where(failed, self.failure[n][at], 0.0)
                    now = np.where(failed, n - 2, now)
            state[:m] = after
            ready = skip[:m] <= t
            out[at[ready]] = weight[ready]
        return out


def cut_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of the texts of rows (doc_id, held_out, text), written once: tokens as numbers, no text."""
    id_type = rows.schema["doc_id"].dataType
    spark_schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("held", T.ArrayType(T.BooleanType()))]
        + [T.StructField(n, T.BinaryType()) for n in ("sizes", "tokens", "hashes")]
        + [T.StructField("n_tokens", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, sizes, parts, room = [], [], [], [], block_bytes
        vocabulary = defaultdict()

        def clear() -> None:
            nonlocal vocabulary, room
            vocabulary = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            for mark in Block.MARKS:
                vocabulary[mark]
            room = block_bytes
            for part in (ids, held, sizes, parts):
                part.clear()

        def written() -> pa.RecordBatch:
            tokens = np.concatenate(parts).astype("<u4")
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
            values = [
                [number], [list(ids)], [list(held)], [pack(np.array(sizes, "<u8"))], [pack(tokens)], [hashes.tobytes()], [len(tokens)],
            ]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), *[pa.binary()] * 3, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=spark_schema.names)

        clear()
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, is_held, text in zip(*(batch.column(i) for i in range(3))):
                data = text.as_py().encode().lower()
                words = data.split()
                parts += [np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)), np.zeros(1, np.uint32)]
                ids.append(doc_id.as_py())
                held.append(is_held.as_py())
                sizes.append(len(words) + 1)
                room -= len(data) + 1
                if room <= 0:
                    yield written()
                    number += 1
                    clear()
        if ids:
            yield written()

    # Few blocks to a file: a reader takes up all rows of a file at once.
    return materialize(rows.select("doc_id", "held_out", "text").mapInArrow(run, spark_schema), "blocks", maxRecordsPerFile=4)


def score_texts(
    docs: DataFrame,
    held_out,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
    bucket_tokens: int = BUCKET_TOKENS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    held_out: a boolean Column (null: false); the model learns from the other rows.
    Tokens are the words, A-Z lower-cased, and one end; n_known counts tokens that occur
    in training; base_score is the smoothed unigram log10 probability and score the
    automaton's, with n-grams of up to order words.  A null text counts as empty: its
    only token is the end.  Repeated rows are rows of their own, and each counts; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    A text of any length is read whole, in one block: a task holds about two hundred
    bytes for each of its tokens.  Without training rows every token has the same
    share of an empty model.
    """
    spark_schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
    )
    blocks = cut_blocks(
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(text).alias("text")),
        block_bytes,
    )
    size = blocks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    buckets, mask = size // bucket_tokens + 1, key_mask(size)
    pools = -(-blocks.count() // POOL) or 1
    block_rows = blocks.select("block", "held", "sizes", "tokens", "hashes")

    def table(rows: list[dict]) -> pa.Table:
        return pa.Table.from_pylist(rows, schema=_QUESTION)

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block = Block.of_row(batch.slice(i, 1).to_pylist()[0], mask)
                rows = block.unigrams().questions(block.number, 1, buckets)
                if order > 1:
                    rows += block.grams(2, block.history, np.ones(len(block.tokens), bool)).questions(block.number, 2, buckets)
                yield from table(rows).to_batches()

    def ask(n: int):
        """Asks for n-grams of n words (none beyond order); with the first such questions go statistics of pairs."""

        def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
            if not len(rows):
                return table([])
            block = Block.of_row(rows.to_pylist()[0], mask)
            counts = Counts(block, answers, n - 1)
            out = []
            if n == 3:
                home = hash(block.number) % buckets
                out.append({"block": block.number, "bucket": home, "n": 2, "keys": b"", "counts": b"", "bins": b"", "stats": counts.pair_statistics()})
            if n <= order:
                grams = counts.ask(n)
                out += grams.questions(block.number, n, buckets, bin_of(counts.history[n][grams.one]))
            return table(out)

        return run

    def answered(questions: DataFrame, name: str) -> DataFrame:
        """Many blocks ask in pools, so that no task reads a row of every block, however common a word is; totals are the same."""
        if pools == 1:
            return materialize(questions.groupBy("n", "bucket").applyInArrow(answer, ANSWER), f"answers-{name}")
        by = ["n", "bucket", "pool"]
        asked = materialize(questions.withColumn("pool", F.pmod("block", F.lit(pools)).cast("long")), f"questions-{name}")
        one = asked.groupBy(*by).applyInArrow(pooled, QUESTION)
        told = materialize(one.groupBy("n", "bucket").applyInArrow(answer, ANSWER), f"pools-{name}")
        to_pools = told.where("block >= 0").withColumnRenamed("block", "pool")
        each = asked.groupBy(*by).cogroup(to_pools.groupBy(*by)).applyInArrow(handed, ANSWER)
        return materialize(told.where("block = -1").union(each), f"answers-{name}")

    found = answered(block_rows.mapInArrow(ask_first, QUESTION), "first")
    # The statistics of pairs need the counts of words, so pairs alone take a round more.
    for n in range(3, (max(order, 3) if order > 1 else 2) + 1):
        told = found.where("block >= 0")
        found = found.union(answered(block_rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask(n), QUESTION), f"{n}"))
    sums: dict[int, dict[int, int]] = defaultdict(dict)
    for r in found.where("block = -1").select("n", F.posexplode("stats").alias("i", "v")).groupBy("n", "i").agg(F.sum("v").alias("v")).collect():
        sums[r["n"]][r["i"]] = r["v"]
    keep = {
        n: np.array([min(max((sums[n].get(BINS + b, 0) + 1) / (sums[n].get(b, 0) + 2), 0.02), 1.0) for b in range(BINS)])
        for n in range(2, order + 1)
    }
    smoothing = Smoothing(sums[1].get(1, 0), sums[1].get(0, 0), keep)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return schema.empty_table()
        block = Block.of_row(rows.select(["block", "held", "sizes", "tokens", "hashes"]).to_pylist()[0], mask)
        counts = Counts(block, answers, order)
        automaton = Automaton(counts, smoothing, order)
        add = lambda x: np.add.reduceat(x, block.first)
        return pa.table(
            {
                "doc_id": rows["ids"].combine_chunks().flatten(),
                "held_out": rows["held"].combine_chunks().flatten(),
                "n_tokens": block.sizes,
                "n_known": add((counts.at[1] > 0).astype(np.int64)),
                "train_tokens": np.full(len(block.sizes), smoothing.tokens, np.int64),
                "base_score": add(automaton.base),
                "score": add(automaton.traverse()),
            },
            schema=schema,
        )

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark_schema)
    told = found.where("block >= 0")
    return blocks.drop("n_tokens").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, spark_schema)
