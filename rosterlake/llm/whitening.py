"""Operator 13: embedding whitening by mixed-precision refinement.

Entries become integers, whose sums are exact.  Spark sums the centred products of
all rows, each task its own, so that one matrix of dimension x dimension reaches the
driver.  Its eigenvectors are worked out in float32 and then corrected by the
iteration of Ogita and Aishima, which needs matrix products only, in float64 and at
last in the longest float that numpy has.  Eigenvalues closer than the iteration can
tell apart form a cluster, which is solved by itself: the matrix shifted by the
cluster's mean and projected on its vectors is small in norm, so an ordinary solver
tells its eigenvalues apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that numpy handles at once.
ROWS = 4096
#: Least and greatest integer of an entry.
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
#: Rounds of refinement in float64, and then in the longest float; three are the rule.
ROUNDS = 12


class Whitening(NamedTuple):
    """n rows; exact sums and spans (greatest less least) of the entries; the components' vectors (columns) and values; the trace."""

    n: int
    sums: list[int]
    spans: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def integers(c: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset; what a long cannot hold is held at its ends."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * c)
    high, low = x >= float(GREATEST - offset), x <= float(LEAST)
    out = np.where(high | low, 0, x).astype(np.int64) + offset
    return np.where(high, GREATEST, np.where(low, LEAST + offset, out))


def deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exact: as int64 if they and their sums of squares fit, else as Python integers."""
    fits = max([model.n * s for s in model.spans], default=0) ** 2 * max(len(model.sums), 1) < 1 << 62
    # Sums modulo 2^64 are right where the difference fits.
    if fits:
        n, s = np.uint64(model.n), np.array([v % (1 << 64) for v in model.sums], np.uint64)
        return (x.astype(np.uint64) * n - s).astype(np.int64)
    return x.astype(object) * model.n - np.array(model.sums, object)


def usable(vector: str):
    """Rows whose vector has entries, all of them finite."""
    v = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(v) > 0), F.lit(False))


def blocks(batches: Iterator[pa.RecordBatch], column: int, scale: int, offset: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ROWS rows with their integers."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            c = np.asarray(part.column(column).flatten(), np.float64).reshape(len(part), -1)
            yield part, integers(c, scale, offset)


def refine(a: np.ndarray, x: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step of the iteration: better eigenvectors, eigenvalues, the least gap that it can tell, and how far it went."""
    a, x = a.astype(kind), x.astype(kind)
    r = np.eye(len(a), dtype=kind) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.sqrt((np.abs(m).sum(0).max()) * (np.abs(m).sum(1).max())))  # noqa: E731  bounds the 2-norm
    least = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    gaps = values[None, :] - values[:, None]
    close = np.abs(gaps) <= least
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gaps))
    return x + x @ e, values, least, float(np.abs(e).max())


def clusters(values: np.ndarray, least: float) -> list[np.ndarray]:
    """Indices of eigenvalues no further than least from the next one, of two or more."""
    order = np.argsort(values)
    parts = np.split(order, np.flatnonzero(np.diff(values[order]) > least) + 1)
    return [p for p in parts if len(p) > 1]


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix; the largest entry of each is positive.

    Within equal eigenvalues any orthonormal basis is right and one of them is given.
    """
    size = float(np.abs(a).max(initial=0))
    if not len(a) or not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a + a.T) / 2 / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    for kind in (np.float64, np.longdouble):
        went = np.inf
        for _ in range(ROUNDS):
            x, values, least, step = refine(a, x, kind)
            for part in clusters(values, least):
                # A sub-solve: what is left of the matrix after the shift is as small as the cluster is wide.
                v = np.linalg.qr(x[:, part].astype(np.float64))[0].astype(kind)
                shifted = a.astype(kind) @ v - values[part].mean() * v
                inner = (v.T @ shifted).astype(np.float64)
                width = np.abs(inner).max()
                turn = np.linalg.eigh((inner + inner.T) / 2 / width)[1] if width else np.eye(len(part))
                x[:, part] = v @ turn.astype(kind)
            if step >= went / 2 or step < np.finfo(kind).eps:  # no nearer than the last time
                break
            went = step
    values = ((x * (a.astype(x.dtype) @ x)).sum(0) / (x * x).sum(0)).astype(np.float64) * size
    order = np.argsort(-values, kind="stable")
    x = (x / np.sqrt((x * x).sum(0))).astype(np.float64)[:, order]
    return values[order], x * np.where(x[np.abs(x).argmax(0), np.arange(len(a))] < 0, -1, 1)


def common_length(rows: DataFrame, vector: str) -> int:
    """The commonest length of the usable vectors; of equally common ones the smallest; 0 without any."""
    lengths = rows.where(usable(vector)).groupBy(F.size(vector).alias("d")).count()
    found = lengths.orderBy(F.desc("count"), "d").first()
    return found.d if found else 0


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, offset: int = 100_000, d: int | None = None) -> Whitening:
    """Means and the first components of all usable vectors of the commonest length (d, where it is known).

    A component whose eigenvalue is not above rounding, 1e-13 of the greatest, has no
    spread to divide by and is left out.  Without rows there is no component.
    """
    d = common_length(rows, vector) if d is None else d
    given = rows.where(usable(vector) & (F.size(vector) == d)).select(F.col(vector).cast("array<double>").alias("v"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * d, None, None
        for _, x in blocks(batches, 0, scale, offset):
            n += len(x)
            near = x - x[:1] if x.min() > -(1 << 40) and x.max() < 1 << 40 else x.astype(object) - int(x[0, 0])
            base = x[0].tolist() if near.dtype == np.int64 else [int(x[0, 0])] * d
            total = [t + int(s) + len(x) * b for t, s, b in zip(total, near.sum(0), base)]
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * d), pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(low), pa.array(high)],
                names=["n", "i", "total", "low", "high"],
            )

    sums = given.mapInArrow(totals, "n long, i int, total decimal(38,0), low long, high long")
    found = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect() if d else []
    if not found:
        return Whitening(0, [], [], np.zeros((0, 0)), np.zeros(0), 0.0)
    start = Whitening(found[0].n, [int(r.total) for r in found], [r.high - r.low for r in found], np.zeros((d, 0)), np.zeros(0), 0.0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for _, x in blocks(batches, 0, scale, offset):
            c = deviations(x, start).astype(np.float64) / start.n
            total += c.T @ c
        upper = np.triu_indices(d)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)) for u in upper] + [pa.array(total[upper])], names=["i", "j", "v"])

    entries = given.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    cov = np.zeros((d, d))
    cov[entries.i, entries.j] = cov[entries.j, entries.i] = entries.v / start.n
    values, vectors = eigenpairs(cov)
    kept = min(components, int((values > 1e-13 * max(values.max(initial=0), 0)).sum()))
    return start._replace(vectors=vectors[:, :kept], values=values[:kept], trace=float(np.trace(cov)))


def whiten(rows: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """A row per usable vector and component: id, component, deviation decimal(38,0), whitened.

    deviation is null where 38 digits do not hold it.
    """
    kept, d = len(model.values), len(model.sums)
    project = model.vectors / np.sqrt(model.values) if kept else model.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, 1, scale, offset):
            c = deviations(x, model)
            squares = (c * c).sum(1)
            if c.dtype == object:
                squares = pa.array([Decimal(v) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
            else:
                squares = pa.array(squares).cast(pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(len(part)), kept))
            w = (c.astype(np.float64) / model.n) @ project
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(part))), squares.take(at), pa.array(w.ravel())],
                names=["id", "component", "deviation", "whitened"],
            )

    given = rows.where(usable(vector) & (F.size(vector) == d)).select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return given.mapInArrow(run, f"id {rows.schema[vec_id].dataType.simpleString()}, component int, deviation decimal(38,0), whitened double")


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding", scale: int = 1024, offset: int = 100_000) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity, measured over all rows; null without components."""
    kept, d = len(model.values), len(model.sums)
    if not kept:
        return None
    project = model.vectors / np.sqrt(model.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept + 1))
        for _, x in blocks(batches, 0, scale, offset):
            w = (deviations(x, model).astype(np.float64) / model.n) @ project
            w = np.concatenate([w, np.ones((len(w), 1))], 1)
            total += w.T @ w
        i, j = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    given = rows.where(usable(vector) & (F.size(vector) == d)).select(F.col(vector).cast("array<double>").alias("v"))
    entries = given.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    found = np.zeros((kept + 1, kept + 1))
    found[entries.i, entries.j] = entries.v / model.n
    mean = found[:kept, kept]
    return float(np.abs(found[:kept, :kept] - np.outer(mean, mean) - np.eye(kept)).max())


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty or hold null or non-finite entries are dropped, and so
    are those of another length than the commonest (of equally common lengths the smallest
    counts).  A null vec_id stays null, repeated rows each count and are each returned.
    Entries beyond a long are held at its ends.  deviation is null where 38 digits do not
    hold it.  Equal eigenvalues are in any order; components without spread are left out,
    so that a table without rows, or of equal rows, gives an empty result.  Other columns
    are ignored.  The driver gets sums and matrices of the vectors' dimension only.
    """
    model = fit(rows, vector, components)
    error = identity_error(rows, model, vector)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values)).cast("array<double>")
    return whiten(rows, model, vec_id, vector).select(
        F.col("id").alias("vec_id"),
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
