"""Many fixed terms found in texts, inside words too, by an automaton that is built once.

The automaton is a trie whose nodes fail over to their longest proper suffix in it, laid
out as arrays: it travels to the tasks as one file of bounded size, and a text is read
once, whatever the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of the arrays that may be broadcast; more terms are dealt to several automata, read one after the other.
WHOLE = 64 << 20
#: Bytes that a node takes in the arrays, and in the tables that a task makes of them.
NODE = 40


class Automaton(NamedTuple):
    """Edges sorted by (node, letter): start of each node's edges, letters and goals; failure, the longest term that ends at a node (-1: none), and the next node of a shorter one; the terms' lengths."""

    first: np.ndarray
    letters: np.ndarray
    goals: np.ndarray
    failure: np.ndarray
    term: np.ndarray
    shorter: np.ndarray
    length: np.ndarray


def build(terms: list[str]) -> Automaton:
    """An automaton of distinct terms that are not empty; a term's number is its place in the list."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for t, letters in enumerate(terms):
        node = 0
        for c in letters:
            found = children[node].get(c)
            if found is None:
                found = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = found
        ends[node] = t
    failure, shorter = [0] * len(children), [0] * len(children)
    level = list(children[0].values())
    while level:
        below = []
        for node in level:
            for c, goal in children[node].items():
                back = failure[node]
                while back and c not in children[back]:
                    back = failure[back]
                failure[goal] = children[back].get(c, 0)
                shorter[goal] = failure[goal] if ends[failure[goal]] >= 0 else shorter[failure[goal]]
                below.append(goal)
        level = below
    counts = [len(c) for c in children]
    edges = [(c, g) for node in children for c, g in sorted(node.items())]
    return Automaton(
        np.concatenate([[0], np.cumsum(counts)]).astype(np.int32),
        np.array([ord(c) for c, _ in edges], np.int32), np.array([g for _, g in edges], np.int32),
        np.array(failure, np.int32), np.array(ends, np.int32), np.array(shorter, np.int32),
        np.array([len(t) for t in terms], np.int32),
    )


class Reader:
    """The tables of an automaton inside a task: one dictionary of edges by node and letter."""

    def __init__(self, a: Automaton):
        node = np.repeat(np.arange(len(a.failure), dtype=np.int64), np.diff(a.first))
        self.edges = dict(zip((node << 21 | a.letters).tolist(), a.goals.tolist()))
        self.failure, self.term, self.shorter, self.length = a.failure.tolist(), a.term.tolist(), a.shorter.tolist(), a.length.tolist()

    def occurrences(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, term number) of every place where a term occurs, overlapping ones too, by end and then longest first."""
        edges, failure, term, shorter, length = self.edges, self.failure, self.term, self.shorter, self.length
        node = 0
        for at, c in enumerate(map(ord, text), 1):
            goal = edges.get(node << 21 | c)
            while goal is None and node:
                node = failure[node]
                goal = edges.get(node << 21 | c)
            node = goal or 0
            hit = node if term[node] >= 0 else shorter[node]
            while hit:
                yield at - length[term[hit]], term[hit]
                hit = shorter[hit]

    def longest(self, text: str) -> Iterator[tuple[int, int]]:
        """Occurrences from left to right without overlap: of those that begin first the longest, then on from its end."""
        best: list[tuple[int, int]] = []
        for start, t in self.occurrences(text):
            # Ends come in rising order, so it covers what is held and begins no sooner; that goes if it may have its place.
            held = len(best)
            while held and start <= best[held - 1][0]:
                held -= 1
            if not held or start >= best[held - 1][0] + self.length[best[held - 1][1]]:
                best[held:] = [(start, t)]
        yield from best


def spot(rows: DataFrame, key: str, text: str, terms: DataFrame, term: str, overlapping: bool = True) -> DataFrame:
    """key, term, start (from 0) of every place in the lower-cased text where a lower-cased term occurs, as part of a word too.

    overlapping: all occurrences; else those that a reader takes from left to right, the
    longest of those that begin first.  Terms are the distinct values of the column term
    of terms; an empty or null term, and a null text, has no occurrence.  Terms that need
    more than WHOLE bytes are dealt to several automata, each read over the texts in turn;
    then only overlapping occurrences can be asked for.
    """
    wanted = terms.select(F.lower(term).alias("t")).where("t <> ''").distinct().withColumn("size", F.length("t"))
    nodes = wanted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] + 1  # a node for each letter at most
    parts = max(1, -(-nodes * NODE // WHOLE))
    if parts > 1 and not overlapping:
        raise ValueError(f"{nodes} letters of terms need {parts} automata, which cannot tell the longest from left to right")
    kind = rows.schema[key].dataType.simpleString()
    texts = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text"))
    found = None
    for part in range(parts):
        names = sorted(r.t for r in wanted.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == part).select("t").collect())  # at most about WHOLE bytes
        told = rows.sparkSession.sparkContext.broadcast((build(names), names))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            automaton, names = told.value
            reader = Reader(automaton)
            for batch in batches:
                for at in range(0, len(batch), 256):
                    piece = batch.slice(at, 256)
                    which, starts, hits = [], [], []
                    for i, value in enumerate(piece.column(1).to_pylist()):
                        for start, t in reader.occurrences(value) if overlapping else reader.longest(value):
                            which.append(i)
                            starts.append(start)
                            hits.append(names[t])
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(which, pa.int64())), pa.array(hits, pa.string()), pa.array(starts, pa.int32())], names=["key", "term", "start"])

        one = texts.mapInArrow(run, f"key {kind}, term string, start int")
        found = one if found is None else found.unionByName(one)
    return found.select(F.col("key").alias(key), "term", "start")
