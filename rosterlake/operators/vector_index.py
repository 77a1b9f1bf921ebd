"""Approximate nearest vectors: an inverted file of k-means lists, residual codes, and an exact rerank.

Every vector belongs to the list of its nearest centroid and is kept there as what it
differs from the centroid by, a byte per dimension, with how far the code is from it.  A
query probes the lists whose centroids are nearest, compares codes, and only the best few
of those are compared by their whole vectors.  The number of lists to probe is measured,
not guessed: tune() finds the least that reaches a recall on a sample of the rows.  What
a search has found also bounds what can be better: surely() opens every list and vector
whose bounds allow that, and so gives the exact result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rosterlake.operators import retrieval
from rosterlake.sources.shared import kept

#: Numbers of all centroids together, which go to every task: 64 MB of doubles.
CENTRES = 1 << 23
#: Codes that one task compares at once with its queries; a longer list is cut in parts.
PART = 20_000
#: Queries that one task compares at once with its codes; more are cut in blocks.
ASKED = 20_000
#: Pairs of a query and a code that a task compares at once: 8 MB of floats.
COMPARED = 1 << 21
#: What rounding a score to six places (and floats in comparing codes) can hide.
ROUNDED, FLOATS = 1e-6, 2e-5
SEED = 7


class VectorIndex(NamedTuple):
    """centroids; codes: list, part, id, code, off, copy; vectors: id, v (unit vectors); part counts; lists to probe.

    off: the distance of a vector and its code; copy: its turn by id among equal vectors;
    radii: the greatest distance of a vector of each list from its centroid.
    """

    centroids: np.ndarray
    scale: float
    codes: DataFrame
    vectors: DataFrame
    parts: np.ndarray
    sizes: np.ndarray
    probes: int
    sample: np.ndarray
    radii: np.ndarray


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors; an empty list starts again from the vector worst served."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        at = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=k) == 0)
        sums[empty] = x[np.argsort(near.max(1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _unit(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """id, v of the rows that have a direction: unit vectors of the rows whose vector is not null, zero or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pandas()
            units = [u / n if (n := np.linalg.norm(u)) > 0 and np.isfinite(n) else None for u in ((np.zeros(1) if v is None else np.asarray(v, "float64")) for v in given)]
            keep = pa.array([u is not None for u in units])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([u for u in units if u is not None], pa.list_(pa.float64()))], names=["id", "v"])

    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, v array<double>")


def build(rows: DataFrame, row_id: str, vector: str, lists: int | None = None, sample: int = 20_000, probes: int | None = None) -> VectorIndex:
    """An index of all rows that have a direction, all of one length.

    sample: rows, by hash of the id, from which centroids are learned and probes tuned;
    every row is indexed.  lists: by default 1.5 times the root of the number of rows, but
    no more than the sample can teach or CENTRES numbers hold.  probes: lists to probe, by
    default as many as tune() finds for a recall of 0.95 on the sample.
    """
    vectors = kept(_unit(rows, row_id, vector), "unit-vectors")
    count = vectors.count()
    if not count:
        none = np.zeros((0, 0))
        return VectorIndex(none, 1.0, vectors.select(F.lit(0).alias("list"), F.lit(0).alias("part"), "id", F.lit(b"").alias("code"), F.lit(0.0).alias("off"), F.lit(1).alias("copy")), vectors, np.zeros(0, int), np.zeros(0, int), 0, none, np.zeros(0))
    drawn = np.array([r.v for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()])
    k = min(lists or max(1, int(1.5 * count**0.5)), max(1, len(drawn) // 8), max(1, CENTRES // drawn.shape[1]))
    centroids = kmeans(drawn, k)
    rest = drawn - centroids[(drawn @ centroids.T).argmax(1)]
    scale = float(np.abs(rest).max()) / 127 or 1.0
    centres = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most CENTRES doubles

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                x = np.asarray(part.column(1).flatten()).reshape(len(part), -1)
                own = (x @ centres.value.T).argmax(1)
                left = x - centres.value[own]
                code = np.clip(np.round(left / scale), -127, 127).astype(np.int8)
                off, far = np.linalg.norm(left - code * scale, axis=1), np.linalg.norm(left, axis=1)
                made = [pa.array(own.astype(np.int32)), part.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off), pa.array(far), part.column(2)]
                yield pa.RecordBatch.from_arrays(made, names=["list", "id", "code", "off", "far", "copy"])

    kind = vectors.schema["id"].dataType.simpleString()
    turn = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    coded = kept(vectors.select("id", "v", turn.alias("copy")).mapInArrow(assign, f"list int, id {kind}, code binary, off double, far double, copy int"), "vector-codes")
    sizes, radii = np.zeros(k, int), np.zeros(k)
    for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each list
        sizes[r.list], radii[r.list] = r.n, r.far
    parts = np.maximum(-(-sizes // PART), 1)
    count_of = F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("list")) if parts.max() > 1 else F.lit(1)
    codes = coded.drop("far").withColumn("part", F.pmod(F.xxhash64("id"), count_of).cast("int"))
    index = VectorIndex(centroids, scale, codes, vectors, parts, sizes, probes or k, drawn, radii)
    return index if probes else index._replace(probes=tune(index, drawn))


def tune(index: VectorIndex, sample: np.ndarray, k: int = 10, recall: float = 0.95, queries: int = 200) -> int:
    """The least number of lists whose probing finds a share recall of the k nearest in the sample, queries of it asking."""
    asked = sample[:: max(1, len(sample) // queries)][:queries]
    own = (sample @ index.centroids.T).argmax(1)
    best = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, : k + 1]
    place = np.argsort(np.argsort(-(asked @ index.centroids.T), axis=1, kind="stable"), axis=1)
    reached = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(reached[min(int(np.ceil(recall * len(reached))), len(reached)) - 1]) + 1


def search(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, k: int, row_id: str = "doc_id", probes: int | None = None, rerank: int = 4) -> DataFrame:
    """The k nearest rows of each query by cosine, as far as the probed lists hold them: query_id, row_id, score, rank (ties by row_id).

    The rerank * k best by code are compared by their whole vectors.  surely() gives the
    exact result from the same index; retrieval.nearest is the plainer way to it.  A query
    without a direction, and a row without one, is in no result.
    """
    n = min(probes or index.probes, len(index.centroids))
    kind, ids = queries.schema[query_id].dataType.simpleString(), index.vectors.schema["id"].dataType.simpleString()
    if not n:
        return queries.sparkSession.createDataFrame([], f"{query_id} {kind}, {row_id} {ids}, score double, rank int")
    asked = kept(_unit(queries, query_id, query_vector), "asked-vectors").select(F.col("id").alias("q"), "v")

    def near(batch: np.ndarray, centres: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = np.argsort(-(batch @ centres.T), axis=1, kind="stable")[:, :n]
        return np.repeat(np.arange(len(batch)), n), lists.ravel()

    def best(scores: np.ndarray, codes: pd.DataFrame, wanted: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        few = min(rerank * k, len(codes))
        return np.repeat(np.arange(len(scores)), few), np.argpartition(-scores, few - 1, axis=1)[:, :few].ravel()

    met = _compared_codes(index, index.codes, asked.withColumn("floor", F.lit(-1.0)), near, best)
    few = met.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))).where(F.col("r") <= rerank * k).select("q", "id")
    return _ranked(index, few, asked, k).select(F.col("q").alias(query_id), F.col("id").alias(row_id), "score", "rank")


def surely(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, k: int, row_id: str = "doc_id") -> DataFrame:
    """The k nearest rows of each query, exactly: what search gives, with nothing missed.

    The score of the k-th row that a search finds is a floor.  By the triangle inequality
    a list can hold a row of that score only if the query is no further from its centroid
    than the row may be and the list's radius together, and a code stands for such a row
    only if it lies within its own error of the floor; all those are compared by their
    whole vectors.  Of equal vectors the k first by id are compared, since no others can be
    in a result.  Vectors that lie around centres open few lists; on vectors in any
    direction all lists are opened, which compares all codes with all queries.
    """
    found = search(index, queries, query_id, query_vector, k, row_id)
    if not len(index.centroids):
        return found
    floors = found.groupBy(F.col(query_id).alias("q")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = _unit(queries, query_id, query_vector).select(F.col("id").alias("q"), "v")
    asked = kept(asked.join(floors, "q", "left").select("q", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor")), "floors")
    radii, squares = index.radii, (index.centroids**2).sum(1)

    def near(batch: np.ndarray, centres: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.sqrt(np.maximum(1 + squares - 2 * (batch @ centres.T), 0))
        least = np.maximum(far - radii - 1e-9, 0)
        return np.nonzero(1 - least**2 / 2 >= floor[:, None] - ROUNDED)

    def best(scores: np.ndarray, codes: pd.DataFrame, wanted: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        off, floor = codes["off"].to_numpy(np.float32) + np.float32(FLOATS), wanted["floor"].to_numpy(np.float32)
        if len(codes) >= k:
            # k rows of this part are at least as good as these scores less their errors.
            floor = np.maximum(floor, np.partition(scores - off, len(codes) - k, axis=1)[:, len(codes) - k])
        return np.nonzero(scores + off >= (floor - np.float32(ROUNDED))[:, None])

    pairs = _compared_codes(index, index.codes.where(F.col("copy") <= k), asked, near, best).select("q", "id")
    return _ranked(index, pairs, asked, k).select(F.col("q").alias(query_id), F.col("id").alias(row_id), "score", "rank")


def _compared_codes(index: VectorIndex, codes: DataFrame, asked: DataFrame, near, best) -> DataFrame:
    """q, id, near: which codes answer which queries (q, v, floor), as best chooses in each list that near names for a query.

    A task holds a part of a list's codes and ASKED queries at most.
    """
    kind, ids = asked.schema["q"].dataType.simpleString(), index.vectors.schema["id"].dataType.simpleString()
    centres = asked.sparkSession.sparkContext.broadcast(index.centroids)
    blocks = max(1, -(-asked.count() // ASKED))
    index_parts, scale = index.parts, index.scale

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                x = np.asarray(part.column(1).flatten()).reshape(len(part), -1)
                row, lists = near(x, centres.value, np.asarray(part.column(2)))
                row, piece = np.repeat(row, index_parts[lists]), np.concatenate([np.arange(0), *[np.arange(p) for p in index_parts[lists]]])
                lists, w = np.repeat(lists, index_parts[lists]), part.column(1).cast(pa.list_(pa.float32()))
                for i in range(0, len(row), 1 << 14):
                    r = pa.array(row[i : i + (1 << 14)])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(r), w.take(r), part.column(2).take(r), pa.array(lists[i : i + (1 << 14)].astype(np.int32)), pa.array(piece[i : i + (1 << 14)].astype(np.int32))], names=["q", "w", "floor", "list", "part"])

    def compare(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(wanted):
            return pd.DataFrame({"q": [], "id": [], "near": []})
        x = np.frombuffer(b"".join(held["code"]), np.int8).reshape(len(held), -1).astype(np.float32) * np.float32(scale) + centres.value[held["list"].iloc[0]].astype(np.float32)
        out, step, q, id_ = [], max(1, COMPARED // len(held)), wanted["q"].to_numpy(), held["id"].to_numpy()
        for at in range(0, len(wanted), step):
            some = wanted.iloc[at : at + step]
            scores = np.stack(some["w"].to_list()).astype(np.float32) @ x.T
            row, code = best(scores, held, some)
            out.append(pd.DataFrame({"q": q[at + row], "id": id_[code], "near": scores[row, code]}))
        return pd.concat(out)

    probed = asked.mapInArrow(probe, f"q {kind}, w array<float>, floor double, list int, part int").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    spread = codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long")) if blocks > 1 else codes.withColumn("block", F.lit(0).cast("long"))
    by = ("list", "part", "block")
    return spread.groupBy(*by).cogroup(probed.groupBy(*by)).applyInPandas(compare, f"q {kind}, id {ids}, near double")


def _ranked(index: VectorIndex, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q, id, score, rank: the k best of each query's pairs (q, id) by their whole vectors."""
    both = pairs.join(index.vectors, "id").join(asked.select("q", F.col("v").alias("w")), "q")
    cosine = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = both.select("q", "id", (F.round(cosine, 6) + 0.0).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def compared(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, probes: int | None = None) -> int:
    """How many codes a search compares, all queries together."""
    n = min(probes or index.probes, len(index.centroids))
    centres, sizes = queries.sparkSession.sparkContext.broadcast(index.centroids), index.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                x = np.asarray(batch.slice(at, 256).column(1).flatten()).reshape(len(batch.slice(at, 256)), -1)
                near = np.argsort(-(x @ centres.value.T), axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array([int(sizes[near].sum())])], names=["n"])

    return _unit(queries, query_id, query_vector).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def recall(found: DataFrame, exact: DataFrame, query_id: str, row_id: str) -> DataFrame:
    """query_id, wanted, found: of each query's exact neighbours, how many were found."""
    here = found.select(query_id, row_id, F.lit(1).alias("here"))
    return exact.join(here, [query_id, row_id], "left").groupBy(query_id).agg(F.count("*").alias("wanted"), F.count("here").alias("found"))


def exact(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
    """The exact way to what search gives."""
    return retrieval.nearest(rows, row_id, vector, queries, query_id, query_vector, k)
