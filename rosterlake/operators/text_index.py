"""A kept inverted index for ranked text search: documents are tokenised once, searches read postings.

The index is a folder of Parquet tables.  Every update is a segment with a number of its
own, in a folder of its own:

docs      a row per document: its number of tokens, its distinct tokens and their counts, which is
          what a later update needs to take it out
postings  a row per token and shelf, which is up to TOGETHER blocks of documents: the blocks that have
          the token, how many of its documents each has, and the most that the token adds to the
          score of any document of the block, but for its rarity; then ids, sorted by block and
          id, and the tokens' counts and the documents' sizes beside them
counts    how many documents of a token, by the postings of earlier segments, a segment replaced
          or removed: what the postings count, less this, is the number of its documents
dead      documents of earlier segments that this one replaced or removed
commits   one row, written last: a segment without it does not exist for a reader

A segment that is written again after a failure overwrites its own folders, so an update
can be replayed.  An update reads the ids of what is there and the tokens of the documents
that it replaces; postings of other documents stay as they are.

Texts are never shuffled.  A document's tokens are counted in its own row; rows of distinct
tokens go to their shelf, where lists are made and written in place.  Most lists of a block
hold a document or two, so a shelf has far fewer rows than its blocks have lists.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rosterlake.functions.text import tokens
from rosterlake.operators.retrieval import ASKED, WANTED, best_of_lists, counted
from rosterlake.sources.shared import kept

#: Blocks of a shelf at most: a row of the postings has a token's documents of all of them.
TOGETHER = 16
#: Distinct tokens of documents that a shelf holds, on average, unless one block holds more; it has fewer blocks where documents are long.
HELD = 1 << 21


class TextIndex:
    """An index in the folder path.

    buckets: parts by hash of the token, in whose order a shelf's rows stand, so that a search leaves out pages of others.
    per_block: documents of a block, on average.  analyse: text to array of tokens, the same
    for documents and searches.  k1, b: how a token's count and a document's size weigh.
    """

    def __init__(
        self, spark: SparkSession, path: str, buckets: int = 16, per_block: int = 256, analyse: Callable[[Column], Column] = tokens, k1: float = 1.2, b: float = 0.75
    ):
        self.spark, self.path, self.buckets, self.per_block, self.analyse, self.k1, self.b = spark, path.rstrip("/"), buckets, per_block, analyse, k1, b

    def _lists(self, kind: str) -> str:
        return f"bucket int, token string, shelf long, df int, blocks array<long>, docs array<int>, most array<double>, ids array<{kind}>, tfs array<int>, sizes array<int>"

    def _schema(self, name: str, kind: str) -> str:
        columns = {
            "docs": f"doc_id {kind}, n int, terms array<string>, tfs array<int>",
            "postings": self._lists(kind),
            "counts": "token string, df long, bucket int",
            "dead": f"doc_id {kind}, of_segment long",
            "commits": "docs long, words long, blocks long, together long, mean double, base boolean, id_type string",
        }
        return f"{columns[name]}, segment long"

    def _write(self, rows: DataFrame, name: str, segment: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/segment={segment}")

    def _commits(self) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.schema(self._schema("commits", "")).parquet(f"{self.path}/commits") if files.exists(folder) else None

    def commits(self, before: int | None = None) -> list:
        """The commits that count (below the segment before), in order: a row for each update since the last compaction."""
        told = self._commits()
        rows = [] if told is None else [r for r in told.collect() if before is None or r.segment < before]
        first = max((r.segment for r in rows if r.base), default=0)
        return sorted((r for r in rows if r.segment >= first), key=lambda r: r.segment)

    def state(self, before: int | None = None) -> tuple[list[int], str, int, int]:
        """The segments that count, the type of ids, and the numbers of documents and tokens."""
        rows = self.commits(before)
        return [r.segment for r in rows], rows[0].id_type if rows else "", sum(r.docs for r in rows), sum(r.words for r in rows)

    def _asked_for(self, lists: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows of lists (bucket, token ...) whose token some query has."""
        wanted = asked.select("bucket", "token").distinct()
        n, buckets = wanted.agg(F.count("*"), F.collect_set("bucket")).first()
        return lists.where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted) if n <= WANTED else wanted, ["bucket", "token"], "left_semi")

    def _read(self, name: str, segments: list[int], kind: str) -> DataFrame:
        return self.spark.read.schema(self._schema(name, kind)).parquet(f"{self.path}/{name}").where(F.col("segment").isin(segments))

    def _bucket(self) -> Column:
        return (F.crc32("token") % self.buckets).cast("int").alias("bucket")

    def _of_segment(self, name: str) -> Column:
        """What the commit of a row's segment says."""
        return F.element_at(F.create_map(*[F.lit(x) for r in self.commits() for x in (r.segment, r[name])]), F.col("segment"))

    def _shelf(self) -> Column:
        return F.floor(F.col("block") / self._of_segment("together")).alias("shelf")

    def _dead(self, segments: list[int], kind: str) -> DataFrame:
        return self._read("dead", segments, kind).select("doc_id", F.col("of_segment").alias("segment"))

    def _invert(self, segment: int, kind: str, base: bool, changes: DataFrame | None, gone: tuple[int, int]) -> None:
        """Postings, counts and the commit of a segment from its docs; changes: token and df to count off, gone: documents and tokens."""
        held = self._read("docs", [segment], kind)
        docs, words, entries = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        blocks = max(1, -(-docs // self.per_block))
        together = max(1, min(TOGETHER, HELD * blocks // max(entries, 1)))
        _, _, all_docs, all_words = ([], "", 0, 0) if base else self.state(before=segment)
        mean = (all_words + words - gone[1]) / max(all_docs + docs - gone[0], 1)
        k1, b, buckets = self.k1, self.b, self.buckets

        def lists_of(rows: pa.Table) -> pa.Table:
            """The lists of one shelf: its documents' tokens, sorted by bucket, token, block and then id."""
            rows = rows.take(pc.sort_indices(rows, [("block", "ascending"), ("doc_id", "ascending")]))
            held, ids = rows["terms"].combine_chunks(), rows["doc_id"].combine_chunks()
            doc = np.repeat(np.arange(len(rows)), np.asarray(held.value_lengths()))
            flat = held.flatten().dictionary_encode()
            each = map(zlib.crc32, flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False))
            bucket = (np.fromiter(each, np.int64, len(flat.dictionary)) % buckets).astype(np.int32)
            placed = np.argsort(bucket, kind="stable")
            words, codes = flat.dictionary.take(pa.array(placed)), np.argsort(placed)[np.asarray(flat.indices)]
            order = np.sort(codes << 32 | np.arange(len(codes))) & 0xFFFFFFFF  # by code, then place; faster than argsort
            doc, codes = doc[order], codes[order]
            tf = np.asarray(rows["tfs"].combine_chunks().flatten())[order]
            n, block = np.asarray(rows["n"])[doc], np.asarray(rows["block"])[doc]
            begins = np.flatnonzero(np.diff(codes, prepend=-1))
            parts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            adds = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / (mean or 1.0)))
            most = np.maximum.reduceat(adds, parts) if len(parts) else np.zeros(0)
            ends, part_ends = np.append(begins, len(codes)), np.append(parts, len(codes))
            as_list = lambda ends, x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
            by_part, by_doc = (lambda x: as_list(np.searchsorted(parts, ends), pa.array(x))), (lambda x: as_list(ends, x))
            return pa.table({
                "bucket": pa.array(bucket[placed]), "token": words, "shelf": pa.array(np.full(len(begins), rows["shelf"][0].as_py())), "df": pa.array(np.diff(ends).astype(np.int32)),
                "blocks": by_part(block[parts]), "docs": by_part(np.diff(part_ends).astype(np.int32)), "most": by_part(most),
                "ids": by_doc(ids.take(pa.array(doc))), "tfs": by_doc(pa.array(tf.astype(np.int32))), "sizes": by_doc(pa.array(n.astype(np.int32))),
            })

        # A group is a shelf, at most about TOGETHER times per_block documents.
        placed = held.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).select(F.floor(F.col("block") / together).alias("shelf"), "block", "doc_id", "n", "terms", "tfs")
        lists = placed.groupBy("shelf").applyInArrow(lists_of, self._lists(kind))
        self._write(lists, "postings", segment)
        if changes is None:
            changes = held.select(F.lit("").alias("token"), F.lit(0).cast("long").alias("df")).limit(0)
        self._write(changes.select("token", "df", self._bucket()).sortWithinPartitions("bucket"), "counts", segment)
        row = self.spark.createDataFrame([(docs - gone[0], words - gone[1], blocks, together, mean, base, kind)], "docs long, words long, blocks long, together long, mean double, base boolean, id_type string")
        self._write(row.coalesce(1), "commits", segment)

    def update(self, docs: DataFrame, segment: int, doc_id: str = "doc_id", text: str = "text", removed: DataFrame | None = None) -> None:
        """Index docs, which has one row per id, in place of what the index has of them; take out the ids of removed.

        segment: a number greater than those of all updates before; the same update with
        the same number again gives the same index.  A row without an id is left out; a
        null or empty text is a document without tokens.
        """
        kind = docs.schema[doc_id].dataType.simpleString()
        fresh = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        tokenised = lambda c: F.coalesce(self.analyse(c), F.array().cast("array<string>"))
        self._write(counted(fresh, "text", tokenised), "docs", segment)
        segments, _, _, _ = self.state(before=segment)
        changes, gone = None, (0, 0)
        ids = self._read("docs", [segment], kind).select("doc_id")
        if removed is not None:
            ids = ids.union(removed.select(F.col(doc_id).alias("doc_id")))
        if segments:
            living = self._read("docs", segments, kind).select("doc_id", "segment").join(self._dead(segments, kind), ["doc_id", "segment"], "left_anti")
            self._write(living.join(ids, "doc_id", "left_semi").select("doc_id", F.col("segment").alias("of_segment")), "dead", segment)
            lost = self._read("docs", segments, kind).join(self._dead([segment], kind), ["doc_id", "segment"], "left_semi")
            gone = lost.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            changes = lost.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        else:
            self._write(ids.select("doc_id", F.lit(0).cast("long").alias("of_segment")).limit(0), "dead", segment)
        self._invert(segment, kind, not segments, changes, tuple(gone))

    def compact(self, segment: int) -> None:
        """Write all living documents as one segment, from their tokens; no text is read."""
        segments, kind, _, _ = self.state(before=segment)
        living = self._read("docs", segments, kind).join(self._dead(segments, kind), ["doc_id", "segment"], "left_anti")
        self._write(living.drop("segment"), "docs", segment)
        self._write(living.select("doc_id", F.col("segment").alias("of_segment")).limit(0), "dead", segment)
        self._invert(segment, kind, True, None, (0, 0))

    def bounds(self, queries: DataFrame, query_id: str, query: str) -> tuple[DataFrame, DataFrame]:
        """query, token, idf, bucket of what is asked; and query, segment, block, bound: what a document of the block can score at most."""
        asked, _, found = self._opened(queries, query_id, query)
        return asked, found

    def _opened(self, queries: DataFrame, query_id: str, query: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What bounds() gives, and between them the postings of the tokens that are asked for, read from the index once."""
        commits = self.commits()
        segments, kind, docs, words = self.state()
        words_of = F.explode(F.array_distinct(self.analyse(F.col(query)))).alias("token")
        asked = kept(queries.select(F.col(query_id).alias("query"), words_of).withColumn("bucket", self._bucket()), "asked")
        columns = ["segment", "bucket", "token", "shelf", "df", "blocks", "docs", "most", "ids", "tfs", "sizes"]
        lists = kept(self._asked_for(self._read("postings", segments, kind).select(*columns), asked), "lists")
        lost = self._asked_for(self._read("counts", segments, kind), asked).select("token", (-F.col("df")).alias("df"))
        df = lists.select("token", F.col("df").cast("long").alias("df")).unionByName(lost).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = kept(asked.join(df, "token").select("query", "token", "bucket", idf.alias("idf")), "asked")
        # With a mean m times as large as when the segment was written, a weight is m times as large at most.
        grown = F.create_map(*[F.lit(x) for r in commits for x in (r.segment, max(1.0, words / max(docs, 1) / r.mean) if r.mean else 1.0)])
        part = F.col("idf") * F.col("most") * F.element_at(grown, F.col("segment"))
        heads = lists.select("segment", "bucket", "token", F.explode(F.arrays_zip("blocks", "most")).alias("e")).select("segment", "bucket", "token", F.col("e.blocks").alias("block"), "e.most")
        found = heads.join(asked, ["bucket", "token"]).groupBy("query", "segment", "block").agg(F.sum(part).alias("bound"))
        return asked, lists, found

    def _closed(self, among: DataFrame | None) -> DataFrame:
        """segment, shelf, ids of documents that no search may find: dead ones, and those not among the given."""
        segments, kind, _, _ = self.state()
        closed = self._dead(segments, kind).select("segment", "doc_id")
        if among is not None:
            closed = closed.union(self._read("docs", segments, kind).join(among, "doc_id", "left_anti").select("segment", "doc_id"))
        placed = closed.where(F.col("segment").isin(segments)).withColumn("block", F.pmod(F.xxhash64("doc_id"), self._of_segment("blocks")))
        return placed.groupBy("segment", self._shelf()).agg(F.collect_set("doc_id").alias("ids"))

    def _scored(self, asked: DataFrame, lists: DataFrame, closed: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
        """query, doc_id, score of the k best documents, without closed ones, of each chosen block (query, segment, block)."""
        segments, kind, docs, words = self.state()
        mean, k1, b = words / max(docs, 1) or 1.0, self.k1, self.b
        parts = max(1, -(-asked.select("query").distinct().count() // ASKED))
        # In the order of tokens, as retrieval.bm25 adds them up.
        by_query = asked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("token", "idf"))).alias("e")).select("query", F.col("e.token").alias("tokens"), F.col("e.idf").alias("idfs"))
        shelf = self._shelf()
        places = chosen.groupBy("query", "segment", shelf).agg(F.collect_list("block").alias("open"))
        right = places.join(by_query, "query").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
        lists = lists.select("segment", "shelf", "token", "blocks", "docs", "ids", "tfs", "sizes").unionByName(closed.select("segment", "shelf", "ids"), allowMissingColumns=True)
        # Lists of shelves that no search has chosen go to no task.
        lists = lists.join(chosen.select("segment", shelf).distinct(), ["segment", "shelf"], "left_semi")
        left = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        types = StructType([StructField("query", asked.schema["query"].dataType), *StructType.fromDDL(f"doc_id {kind}"), StructField("score", DoubleType())])

        def best(held: pa.Table, wanted: pa.Table) -> pa.Table:
            """Of one shelf: each query's lists added up, and its k best documents of the blocks that it opens."""
            flat = lambda rows, c: rows[c].combine_chunks().flatten()
            closed, held = held.filter(pc.is_null(held["token"])), held.filter(pc.is_valid(held["token"]))
            ids = flat(held, "ids").dictionary_encode()
            order = pc.sort_indices(ids.dictionary)
            place = np.argsort(np.asarray(order))[np.asarray(ids.indices)]
            ids = ids.dictionary.take(order)
            tf, n = (np.asarray(flat(held, c)).astype(float) for c in ("tfs", "sizes"))
            adds = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
            cuts = np.cumsum(np.asarray(held["ids"].combine_chunks().value_lengths()))[:-1]
            list_of = dict(zip(held["token"].to_pylist(), zip(np.split(place, cuts), np.split(adds, cuts))))
            block = np.zeros(len(ids), np.int64)
            block[place] = np.repeat(np.asarray(flat(held, "blocks")), np.asarray(flat(held, "docs")))
            usable = np.asarray(pc.invert(pc.is_in(ids, flat(closed, "ids"))))
            asked = zip(*(wanted[c].to_pylist() for c in ("open", "tokens", "idfs")))
            out = [best_of_lists(list_of, len(ids), tokens, idfs, k, usable & np.isin(block, opened)) for opened, tokens, idfs in asked]
            asker = np.repeat(np.arange(len(out)), [len(at) for at, _ in out]).astype(np.int64)
            at, scores = (np.concatenate([np.zeros(0), *x]) for x in zip(*out)) if out else (np.zeros(0), np.zeros(0))
            return pa.table({"query": wanted["query"].take(pa.array(asker)), "doc_id": ids.take(pa.array(at.astype(np.int64))), "score": scores})

        found = left.groupBy("segment", "shelf", "part").cogroup(right.groupBy("segment", "shelf", "part"))
        return found.applyInArrow(best, types).withColumn("score", F.round("score", 6))

    def search(self, queries: DataFrame, query_id: str, query: str, k: int, doc_id: str = "doc_id", among: DataFrame | None = None, seeds: int = 2) -> DataFrame:
        """The k best documents of each query: query_id, doc_id, score, rank (ties by id); the same as retrieval.bm25 gives.

        among: a table whose column doc_id lists the documents that may be found.  The seeds
        blocks of the highest bounds are scored first; their k-th best score is the least
        that counts, and of the other blocks only those whose bound reaches it are opened.
        """
        segments, kind, *_ = self.state()
        if not segments:
            return queries.select(query_id, F.lit(None).cast("long").alias(doc_id), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        closed = kept(self._closed(None if among is None else among.select(F.col(doc_id).alias("doc_id"))), "closed")
        asked, lists, bounds = self._opened(queries, query_id, query)
        best = Window.partitionBy("query").orderBy(F.desc("bound"), "segment", "block")
        bounds = kept(bounds.withColumn("r", F.row_number().over(best)), "bounds")
        place = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        top = lambda scores: scores.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        first = kept(top(self._scored(asked, lists, closed, bounds.where(F.col("r") <= seeds).select("query", "segment", "block"), k)), "best-so-far")
        least = first.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
        # Scores are rounded to six digits, so a bound may be lower than a score by half a unit of the last one.
        rest = bounds.where(F.col("r") > seeds).join(least, "query", "left").where("least is null or bound >= least - 0.000001").select("query", "segment", "block")
        found = top(first.drop("rank").unionByName(self._scored(asked, lists, closed, rest, k)))
        return found.select(F.col("query").alias(query_id), F.col("doc_id").alias(doc_id), "score", "rank")


def weight(tf: Column, n: Column, mean: float, k1: float, b: float) -> Column:
    """What a token adds to a score, but for its rarity: more with its count, less with the document's size."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / F.lit(float(mean) or 1.0)))
