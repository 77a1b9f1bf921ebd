"""Ranked retrieval: BM25 over tokens, exact vector neighbours, and rank fusion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rosterlake.functions import scoring
from rosterlake.functions.text import tokens
from rosterlake.sources.shared import kept

#: Pairs of a query and a row that a task scores at once: 8 MB of doubles.
SCORED = 1 << 20
#: Tokens of documents, of those that are asked for, that a task of a text search holds at once, on average.
ENTRIES = 1 << 18
#: Queries that one task scores against a block at once.
ASKED = 1000
#: Tokens of all queries up to which every task gets them all, some ten bytes each; with more of them all tokens are counted.
WANTED = 200_000


def counted(rows: DataFrame, text: str, analyse: Callable[[Column], Column] = tokens, wanted: list[str] | None = None) -> DataFrame:
    """rows with n, terms and tfs for the text: its number of tokens, its distinct tokens (of those wanted, if given) and how often each occurs.

    A null text has no tokens and a null for their number.  Each text is counted where it stands: no token is a row and nothing is shuffled.
    """
    listed = rows.select(*[c for c in rows.columns if c != text], analyse(F.col(text)).alias("terms"))
    keys = listed.columns[:-1]
    types = StructType([*(listed.schema[c] for c in keys), *StructType.fromDDL("n int, terms array<string>, tfs array<int>")])

    def count(batches):
        words = None if wanted is None else pa.array(wanted, pa.string())
        for batch in batches:
            lists = batch.column("terms")
            flat, n = lists.flatten(), lists.value_lengths()
            doc = np.repeat(np.arange(len(batch)), np.asarray(n.fill_null(0)))
            if wanted is None:
                flat = flat.dictionary_encode()
                words, codes = flat.dictionary, np.asarray(flat.indices)
            else:
                codes = pc.index_in(flat, words)
                doc, codes = doc[np.asarray(codes.is_valid())], np.asarray(codes.drop_null())
            pairs, tfs = np.unique(doc * max(len(words), 1) + codes, return_counts=True)
            doc, codes = np.divmod(pairs, max(len(words), 1))
            ends = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(ends, words.take(pa.array(codes)))
            columns = [*(batch.column(c) for c in keys), n, terms, pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "terms", "tfs"])

    return listed.mapInArrow(count, types)


def best_of_lists(lists: dict, size: int, tokens: list, idfs: list, k: int, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places and scores of the k best of size documents for one query, ties by place.

    lists: of each token, the places of its documents and what it adds to each but for its rarity.
    """
    total = np.zeros(size)
    for token, idf in zip(tokens, idfs):
        if token in lists:
            at, adds = lists[token]
            total[at] += idf * adds
    # A token adds more than 0 wherever it stands.
    at = np.flatnonzero(total if usable is None else total * usable)
    rounded = np.round(total[at], 6)
    if len(at) > k:
        good = np.flatnonzero(rounded >= np.partition(rounded, len(at) - k)[len(at) - k])
        at, rounded = at[good], rounded[good]
    at = at[np.argsort(-rounded, kind="stable")[:k]]
    return at, total[at]


def bm25(
    docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int, k1: float = 1.2, b: float = 0.75, where: Column | None = None,
) -> DataFrame:
    """The k best documents of each query: query_id, doc_id, score, rank (ties by id).

    where: only documents for which it is true are found; the weights of tokens come
    from all documents.

    The queries' tokens are counted in each text and written once to a shared folder.
    Blocks of documents then meet blocks of queries, each pair of blocks in one task that
    adds up lists of tokens and keeps k documents a query: what is shuffled again grows
    with queries and blocks, never with pairs of a query and a document.  For many
    searches over the same documents see text_index.
    """
    more = [] if where is None else ["is_open"]
    asked = queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(tokens(F.col(query)))).alias("token"))
    wanted = [r.token for r in asked.select("token").distinct().limit(WANTED + 1).collect()]
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), *[where.alias(c) for c in more])
    counts = kept(counted(rows, "t", wanted=wanted if len(wanted) <= WANTED else None), "counts")
    # A null text is a document, but has no size.
    n_docs, mean, entries = counts.agg(F.count("*"), F.avg("n"), F.sum(F.size("terms"))).first()
    keys = ["d", "n", *more]
    if not counts.groupBy(*keys).count().where("count > 1").isEmpty():
        # Rows that repeat an id and a size are one document.
        one = counts.select(*keys, F.explode(F.arrays_zip("terms", "tfs")).alias("e")).groupBy(*keys, F.col("e.terms").alias("term")).agg(F.sum("e.tfs").cast("int").alias("tf"))
        pairs = one.groupBy(*keys).agg(F.collect_list(F.struct("term", "tf")).alias("e"))
        counts = kept(pairs.select(*keys, F.col("e.term").alias("terms"), F.col("e.tf").alias("tfs")), "counts")
    df = counts.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    by_query = asked.join(df, "token").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("token", idf.alias("idf")))).alias("e"))
    n_rows, n_queries = max(1, -(-(entries or 0) // ENTRIES)), max(1, -(-queries.count() // ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = (counts.where("is_open") if more else counts).select("d", "n", "terms", "tfs", block("d", n_rows).alias("rb"), every(n_queries).alias("qb"))
    right = by_query.select("q", F.col("e.token").alias("tokens"), F.col("e.idf").alias("idfs"), block("q", n_queries).alias("qb"), every(n_rows).alias("rb"))

    def best(held: pa.Table, wanted: pa.Table) -> pa.Table:
        """Of one block of documents: the k best of each query of a block."""
        held = held.take(pc.sort_indices(held["d"]))
        ids = held["d"].combine_chunks().dictionary_encode(null_encoding="encode")
        found, size = held["terms"].combine_chunks(), len(ids.dictionary)
        row = np.repeat(np.arange(len(held)), np.asarray(found.value_lengths().fill_null(0)))
        flat = found.flatten().dictionary_encode()
        pairs = np.asarray(flat.indices).astype(np.int64) * size + np.asarray(ids.indices)[row]
        order = np.argsort(pairs, kind="stable")
        tf, n = np.asarray(held["tfs"].combine_chunks().flatten()), np.asarray(held["n"])[row]
        adds = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / (mean or 1.0))))[order]
        pairs = pairs[order]
        begins = np.flatnonzero(np.diff(pairs, prepend=-1))
        codes, at = np.divmod(pairs[begins], max(size, 1))
        adds = np.add.reduceat(adds, begins) if len(begins) else adds
        cuts = np.searchsorted(codes, np.arange(1, len(flat.dictionary)))
        lists = dict(zip(flat.dictionary.to_pylist(), zip(np.split(at, cuts), np.split(adds, cuts))))
        out = [best_of_lists(lists, size, e, f, k) for e, f in zip(wanted["tokens"].to_pylist(), wanted["idfs"].to_pylist())]
        places, scores = (np.concatenate([np.zeros(0), *x]) for x in zip(*out)) if out else (np.zeros(0), np.zeros(0))
        asker = np.repeat(np.arange(len(out)), [len(x) for x, _ in out]).astype(np.int64)
        return pa.table({"q": wanted["q"].take(pa.array(asker)), "d": ids.dictionary.take(pa.array(places.astype(np.int64))), "score": scores})

    types = StructType([StructField("q", right.schema["q"].dataType), StructField("d", left.schema["d"].dataType), StructField("score", DoubleType())])
    scores = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(best, types).withColumn("score", F.round("score", 6))
    place = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    ranked = scores.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("d").alias(doc_id), "score", "rank")


def matrix(vectors: pd.Series) -> np.ndarray:
    """Unit vectors as rows; zeros for vectors that are null, zero, or not finite throughout."""
    good = [None if v is None else np.asarray([np.nan if x is None else x for x in v] if isinstance(v, list) else v, dtype="float64") for v in vectors]
    width = max((len(v) for v in good if v is not None), default=0)
    out = np.zeros((len(good), width))
    for i, v in enumerate(good):
        norm = 0.0 if v is None or len(v) != width or not np.isfinite(v).all() else float(np.sqrt(v @ v))
        if norm > 0 and np.isfinite(norm):
            out[i] = v / norm
    return out


def first_of_each(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest of each row, greatest first, of equal ones the first."""
    if k >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    out = np.empty((len(scores), k), np.int64)
    for i, (row, x) in enumerate(zip(scores, least)):
        over = np.flatnonzero(row > x)
        at = np.concatenate([over, np.flatnonzero(row == x)[: k - len(over)]])
        out[i] = at[np.lexsort((at, -row[at]))]
    return out


def best_of_blocks(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows (r, v) of each query (q, w) of two blocks: q, r, score; SCORED pairs at a time."""
    if not len(a) or not len(b):
        return pd.DataFrame({"q": [], "r": [], "score": []})
    a = a.sort_values("r", kind="stable")
    x, y, ids = matrix(a["v"]), matrix(b["w"]), a["r"].to_numpy()
    width = min(x.shape[1], y.shape[1]) if x.shape[1] == y.shape[1] else 0
    x, out = x[:, :width].T, []
    step = max(1, SCORED // len(a))
    for at in range(0, len(b), step):
        scores = y[at : at + step, :width] @ x
        np.round(scores, 6, out=scores)
        scores += 0.0
        order = first_of_each(scores, min(k, len(a)))
        out.append(pd.DataFrame({"q": np.repeat(b["q"].to_numpy()[at : at + step], order.shape[1]), "r": ids[order].ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel()}))
    return pd.concat(out)


def nearest(
    rows: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, row_block: int = 20000, query_block: int = 1000
) -> DataFrame:
    """The k nearest rows of each query by cosine: query_id, row_id, score, rank (ties by row_id).

    Exact: blocks of queries meet blocks of rows, each pair of blocks in one task that
    keeps k rows a query; only those meet again.  No task holds more than one block of
    each side and the scores of SCORED pairs, and neither side is broadcast.  Vectors that are null, zero or not finite
    score 0.
    """
    n_rows, n_queries = max(1, -(-rows.count() // row_block)), max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.select(F.col(row_id).alias("r"), F.col(vector).alias("v"), block(row_id, n_rows).alias("rb"), every(n_queries).alias("qb"))
    right = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("w"), block(query_id, n_queries).alias("qb"), every(n_rows).alias("rb"))

    best = lambda a, b: best_of_blocks(a, b, k)
    types = f"q {queries.schema[query_id].dataType.simpleString()}, r {rows.schema[row_id].dataType.simpleString()}, score double"
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(best, types)
    place = Window.partitionBy("q").orderBy(F.desc("score"), "r")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "score", "rank")


def fused(first: DataFrame, second: DataFrame, keys: list[str], weights: tuple[float, float], k: int) -> DataFrame:
    """keys, rank_a, rank_b and the score, not rounded."""
    a, b = first.select(*keys, F.col("rank").alias("rank_a")), second.select(*keys, F.col("rank").alias("rank_b"))
    score = scoring.reciprocal_rank(F.col("rank_a"), weights[0], k) + scoring.reciprocal_rank(F.col("rank_b"), weights[1], k)
    return a.join(b, keys, "full_outer").withColumn("score", score)


def fuse(first: DataFrame, second: DataFrame, keys: list[str], weights: tuple[float, float] = (0.6, 0.4), k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: keys and score."""
    return fused(first, second, keys, weights, k).select(*keys, F.round("score", 6).alias("score"))


def hybrid(
    docs: DataFrame, doc_id: str, text: str, vector: str, queries: DataFrame, query_id: str, query: str, query_vector: str, k: int = 20,
    weights: tuple[float, float] = (0.6, 0.4), where: Column | None = None, rank_constant: int = 60, texts: DataFrame | None = None, vectors: DataFrame | None = None,
) -> DataFrame:
    """The k best documents of each query by both searches: query_id, doc_id, score, rank, vector_rank, text_rank.

    The 2k nearest vectors and the 2k best texts are fused by reciprocal rank, with
    weights for (vector, text), then cut to k; ties by doc_id.  A document needs to be
    in one list only; its rank in the other is null.  A document or a query without a
    vector has no part in the vector list.  where: both lists hold only documents for
    which it is true.  texts: the 2k best texts (query_id, doc_id, rank), where an index
    has found them already.  vectors: doc_id and vector, where docs has no vectors; only
    ids of docs are joined to them, so that no text is shuffled.
    """
    held = docs if where is None else docs.where(where)
    if vectors is not None:
        held = held.select(doc_id).join(vectors.select(doc_id, vector), doc_id)
    held = held.where(F.col(vector).isNotNull())
    asked = queries.where(F.col(query_vector).isNotNull())
    near = nearest(held, doc_id, vector, asked, query_id, query_vector, 2 * k)
    if texts is None:
        texts = bm25(docs, doc_id, text, queries, query_id, query, 2 * k, where=where)
    place = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    ranked = fused(near, texts, [query_id, doc_id], weights, rank_constant).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select(query_id, doc_id, F.round("score", 6).alias("score"), "rank", F.col("rank_a").alias("vector_rank"), F.col("rank_b").alias("text_rank"))
