"""Operator 8: embedding near-duplicates by lattice hashing with E8.

Equal vectors are first reduced to one class each.  In each table a class's unit
vector is projected onto random directions, scaled, and every 8 coordinates are
decoded to the nearest point of the lattice E8; the points together are the cell.
A vector is stored in its own cell and probes the neighbouring cells that the
next nearest points give, so that close vectors on either side of a border meet.
Every pair that meets is verified by its cosine in double precision.

The scale, the number of coordinates in a cell and the number of tables follow from
the number of vectors and the threshold (plan_for): unrelated vectors meet about
equally rarely at every size, while pairs at the threshold are found as often.

The tables hold ids only; vectors are joined to the distinct candidate pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rosterlake.llm.support import components, materialize

SEED = 11
#: Share of the pairs at the threshold that the tables may miss, were blocks of coordinates independent.
MISS = 0.02
#: What a candidate pair costs, in rows of a table.
PAIR_COST = 20
# Measured chance that two unrelated unit vectors meet in one block of 8 coordinates, by scale.
UNRELATED = {3.0: 0.156, 3.5: 0.054, 4.0: 0.0198, 4.5: 0.0089, 5.0: 0.0045, 5.5: 0.0023, 6.0: 0.0013, 7.0: 0.00045, 8.0: 0.00018}


class Plan(NamedTuple):
    """tables, blocks of 8 coordinates in a cell, and what the unit vector's projection is multiplied by."""

    tables: int
    blocks: int
    scale: float


def decode(x: np.ndarray) -> np.ndarray:
    """The four near points of E8 for rows of 8 coordinates, doubled to integers, nearest first.

    E8 is D8 and D8 shifted by one half; D8 has the integer points of even sum.  In
    each of the two, the nearest point rounds every coordinate and, if the sum is
    odd, moves the one with the largest error; the next one moves another.
    """
    found, far = [], []
    for shift in (0.0, 0.5):
        near = np.round(x - shift)
        error = x - shift - near
        order = np.argsort(-np.abs(error), axis=1)[:, :2]
        step = np.where(error >= 0, 1.0, -1.0)
        odd = near.sum(1) % 2 != 0
        first, second = near.copy(), near.copy()
        rows = np.arange(len(x))
        one, two = order[:, 0], order[:, 1]
        first[rows[odd], one[odd]] += step[rows[odd], one[odd]]
        second[rows[odd], two[odd]] += step[rows[odd], two[odd]]
        even = ~odd
        second[rows[even], one[even]] += step[rows[even], one[even]]
        second[rows[even], two[even]] += step[rows[even], two[even]]
        for point in (first, second):
            found.append((2 * (point + shift)).astype(np.int64))
            far.append(((x - shift - point) ** 2).sum(1))
    order = np.argsort(np.stack(far, 1), axis=1, kind="stable")
    return np.take_along_axis(np.stack(found, 1), order[:, :, None], axis=1)


@lru_cache(maxsize=16)
def _frames(dim: int, plan: Plan, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Orthonormal projections of each table, and multipliers that hash a cell."""
    rng = np.random.default_rng((seed, dim))
    width = 8 * plan.blocks
    frames = []
    for _ in range(plan.tables):
        gauss = rng.standard_normal((max(dim, width), width))
        frames.append(np.linalg.qr(gauss)[0][:dim] * plan.scale * np.sqrt(dim / 64))
    return frames, rng.integers(1, 1 << 62, (plan.tables, width)) * 2 + 1


def cells(vectors: np.ndarray, plan: Plan, seed: int) -> np.ndarray:
    """Hashes of cells, (vectors, tables, 4 ** blocks); the first of each table is the vector's own."""
    blocks = plan.blocks
    frames, multipliers = _frames(vectors.shape[1], plan, seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = []
    with np.errstate(over="ignore"):
        for t, frame in enumerate(frames):
            at = (unit @ frame).reshape(-1, 8)
            points = decode(at).reshape(len(vectors), blocks, 4, 8)
            part = (points * multipliers[t].reshape(blocks, 1, 8)).sum(3)
            ways = [sum(part[:, b, k] for b, k in enumerate(way)) for way in product(range(4), repeat=blocks)]
            out.append(np.stack(ways, 1) * 31 + t)
    return np.stack(out, 1)


@lru_cache(maxsize=16)
def meeting(scale: float, cosine: float, pairs: int = 6000) -> float:
    """The chance that two unit vectors of a cosine meet in one block, by simulation; it depends on nothing else."""
    rng = np.random.default_rng(SEED)
    u, other = (rng.standard_normal((pairs, 64)) for _ in range(2))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    other -= (other * u).sum(1, keepdims=True) * u
    other *= math.sqrt(max(1 - cosine * cosine, 0.0)) / np.linalg.norm(other, axis=1, keepdims=True)
    a, b = (decode(x[:, :8] * scale) for x in (u, cosine * u + other))
    return float(((a == b[:, :1]).all(2).any(1) | (b == a[:, :1]).all(2).any(1)).mean())


def plan_for(vectors: int, threshold: float) -> Plan:
    """The plan whose rows and candidate pairs per vector cost least, of those that miss MISS at the threshold."""
    plans = []
    for blocks in (1, 2, 3, 4):
        for scale, unrelated in UNRELATED.items():
            hit = min(meeting(scale, threshold) ** blocks, 1 - 1e-9)
            if hit < 0.01:
                continue
            tables = max(1, math.ceil(math.log(MISS) / math.log(1 - hit)))
            cost = tables * 4**blocks + PAIR_COST * vectors * tables * unrelated**blocks
            plans.append((cost, Plan(tables, blocks, scale)))
    return min(plans)[1]


def usable(vector: str):
    """Rows that can link: no null, no null or non-finite component, not zero."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids whose vectors (id, v) have a cosine of threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            keep = np.zeros(len(a), bool)
            nx, ny = (np.asarray(c.value_lengths()) for c in (x, y))
            for n in np.unique(nx[nx == ny]):
                at = np.flatnonzero((nx == n) & (ny == n))
                u, w = (np.asarray(c.take(pa.array(at)).flatten(), np.float64).reshape(-1, n) for c in (x, y))
                u, w = (m / np.abs(m).max(1, keepdims=True) for m in (u, w))  # no overflow in squares
                dot = np.einsum("ij,ij->i", u, w) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", w, w))
                keep[at] = dot >= threshold
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    left = vectors.select(F.col("id").alias("a"), F.col("v").alias("x"))
    right = vectors.select(F.col("id").alias("b"), F.col("v").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def candidates(classes: DataFrame, plan: Plan) -> DataFrame:
    """Distinct pairs a < b of ids of the rows (id, v) that meet in a cell of some table."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                ids, v = np.asarray(part.column(0)), part.column(1)
                sizes = np.asarray(v.value_lengths())
                for n in np.unique(sizes):
                    at = np.flatnonzero(sizes == n)
                    x = np.asarray(v.take(pa.array(at)).flatten(), np.float64).reshape(-1, n)
                    x = x / np.abs(x).max(1, keepdims=True)
                    keys = cells(x, plan, SEED) * 64 + n
                    own = np.zeros(keys.shape, bool)
                    own[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(ids[at], keys[0].size)), pa.array(own.ravel())],
                        names=["cell", "id", "own"],
                    )

    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("id", T.LongType()), T.StructField("own", T.BooleanType())])
    indexed = materialize(classes.select("id", "v").mapInArrow(index, schema), "cells")
    stored = indexed.where("own").select("cell", F.col("id").alias("other"))
    met = indexed.join(stored, "cell").where("id <> other")
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def near_vectors(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    plan: Plan | None = None,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when they are found as candidates and their cosine is threshold or
    more; vectors of different length never link.  n_links counts the other rows
    linked directly, equal vectors among them.  component_id is the smallest vec_id
    reachable.  A vector that is null, zero or has null or non-finite components
    links with nothing and is its own component.  Rows with a null id stand apart
    too: no links, a null component, not kept.  Rows that repeat an id are counted
    as rows.  plan: the tables to use instead of those that the number of vectors calls for.  An empty table gives an empty result; other columns are ignored.
    """
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = materialize(given.where(usable("v") & F.col("vec_id").isNotNull()), "vectors")
    classes = materialize(
        good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("members")), "classes"
    )

    pairs = candidates(classes, plan or plan_for(classes.count(), threshold))
    links = materialize(cosine_pairs(pairs, classes.select("id", "v"), threshold), "links")
    sizes = classes.select("id", "members")
    both = links.select("a", F.col("b").alias("id")).union(links.select(F.col("b").alias("a"), F.col("a").alias("id")))
    degrees = both.join(sizes, "id").groupBy(F.col("a").alias("id")).agg(F.sum("members").alias("linked"))
    roots = components(links).select(F.col("node").alias("id"), "root")
    told = materialize(
        classes.join(degrees, "id", "left").join(roots, "id", "left").select(
            "v",
            (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("root", "id").alias("component_id"),
        ),
        "told",
    )
    linked = good.join(told, "v").select("vec_id", "n_links", "component_id")
    rest = given.where(~(usable("v") & F.col("vec_id").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
