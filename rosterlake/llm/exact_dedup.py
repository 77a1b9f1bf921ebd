"""Operator 6: exact deduplication through a log-structured merge index.

The index is a folder of sorted tables.  A flush reads the documents once: each task
fills memtables of a bounded number of rows in the order in which rows arrive, and
writes each as a run (run, digest, doc_id, n_points) sorted by digest.  A compaction
merges a bounded number of runs at a time, level by level, into one row per digest that
keeps the best identifier (most code points, then smallest id) and the number of rows;
runs that were merged once are not merged again, so an index can take more flushes.
The last level has a filter, a bitmap over digests that occur more than once, sized by
their number; it is probed with every document, and the bytes of the documents that hit
it are compared within each digest.  Should two different texts share a digest, the
rows of that digest are grouped by the text itself.

Only built-in functions run.  Groups are reduced by grouped aggregates with
map-side combination, so that a digest which a third of all rows share costs one
row per task; the join back goes over two written tables, which adaptive
execution splits when one digest is large.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterlake.llm.support import SPACES, discard, materialize, shared_dir, text_of

#: Rows of a memtable at most.
MEMTABLE = 1 << 20
#: Runs that one merge takes.
FAN_IN = 256
#: Bits of the filter for each digest in it, about: one in sixteen others passes at most.
FILTER_BITS = 16
#: Bytes of a filter up to which every task gets it whole; a larger one is joined piece by piece.
WHOLE_FILTER = 64 << 20
#: Bits of a piece of the filter.
_PIECE = 32768


def normalised(text: str | Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; a null counts as empty."""
    return F.translate(text_of(text), SPACES, "")


class MergeIndex:
    """A log-structured merge index of text digests in one folder.

    digest: from a Column of normalised text to a binary Column; SHA-256 unless a
    test wants collisions.  row: a column of unique numbers, if a verdict on rows
    rather than ids is wanted; results then also have row and keep_row.  memtable: rows
    of a run at most.  fan_in: runs that one merge takes.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, digest=None, row: str | None = None, memtable: int = MEMTABLE, fan_in: int = FAN_IN):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
        self.digest = digest or (lambda t: F.unhex(F.sha2(t.cast("binary"), 256)))
        self.row, self.memtable, self.fan_in = row, memtable, fan_in
        self.flushed: list[DataFrame] = []
        self.fresh: list[DataFrame] = []
        self.level: DataFrame | None = None
        self.columns = ["doc_id", "digest", "keep_id", "group_size", *(["row", "keep_row"] if row else [])]

    def _keyed(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        norm = normalised(text)
        return docs.select(
            self.digest(norm).alias("digest"),
            F.col(doc_id).alias("doc_id"),
            F.length(text_of(text)).cast("long").alias("n_points"),
            norm.alias("norm"),
            *([F.col(self.row).alias("row")] if self.row else []),
        )

    def _entries(self, rows: DataFrame) -> DataFrame:
        """Rows as entries of a level: the order in which identifiers are kept, and how many rows an entry stands for."""
        order = [(-F.col("n_points")).alias("minus_points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *(["row"] if self.row else [])]
        return rows.withColumns({"best": F.struct(*order), "n_rows": F.lit(1).cast("long")})

    @staticmethod
    def _merged(entries: DataFrame, *by: str) -> DataFrame:
        return entries.groupBy(*by).agg(F.min("best").alias("best"), F.sum("n_rows").alias("n_rows"))

    def _kept(self, merged: DataFrame) -> DataFrame:
        """The key columns, keep_id, group_size and, with rows, keep_row."""
        kept = [F.col("best.row").alias("keep_row")] if self.row else []
        return merged.select(*[c for c in merged.columns if c not in ("best", "n_rows")], F.col("best.doc_id").alias("keep_id"), F.col("n_rows").alias("group_size"), *kept)

    def _write(self, rows: DataFrame, *order: str) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.sortWithinPartitions(*order).write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def flush(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Write the documents' digests as sorted runs of at most memtable rows."""
        arrived = F.monotonically_increasing_id()  # the task, then the row in it
        number = F.shiftright(arrived, 33) * 8192 + F.floor(arrived.bitwiseAND(F.lit((1 << 33) - 1)) / self.memtable)
        run = F.concat_ws("-", F.lit(str(len(self.flushed))), number)
        written = self._write(self._keyed(docs, doc_id, text).drop("norm").withColumn("run", run), "run", "digest")
        self.flushed.append(written)
        self.fresh.append(written)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, self.flushed)

    def runs(self) -> DataFrame:
        """run, n_rows of every run."""
        return self.rows().groupBy("run").agg(F.count("*").alias("n_rows"))

    def compact(self) -> DataFrame:
        """One row per digest over all runs: digest, best, n_rows."""
        if self.fresh:
            entries = self._entries(reduce(DataFrame.union, self.fresh)).select("run", "digest", "best", "n_rows")
            count = entries.agg(F.count_distinct("run").alias("n")).first()["n"]
            while count > self.fan_in:
                # Each of the groups gets about fan_in runs.
                count = -(-count // self.fan_in)
                group = F.pmod(F.xxhash64("run"), F.lit(count)).cast("string")
                lower, entries = entries, self._write(self._merged(entries.withColumn("run", group), "run", "digest"), "run", "digest")
                discard(lower, self.folder, keep=self.flushed)
            entries = entries.select("digest", "best", "n_rows")
            above, self.level = self.level, self._write(self._merged(entries if self.level is None else entries.union(self.level), "digest"), "digest")
            discard(entries, self.folder, keep=self.flushed)
            if above is not None:
                discard(above, self.folder, keep=self.flushed)
            self.fresh = []
        return self.level

    def _hits(self, docs: DataFrame, merged: DataFrame, doc_id: str, text: str) -> DataFrame:
        """The documents whose digest may occur more than once, by the filter."""
        repeated = merged.where("n_rows > 1").select("digest")
        bits = max(_PIECE, 1 << (FILTER_BITS * repeated.count()).bit_length())
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
        pieces = (
            repeated.select(place("digest").alias("at"))
            .groupBy(F.floor(F.col("at") / _PIECE).alias("piece"))
            .agg(F.bitmap_construct_agg(F.col("at") % _PIECE).alias("bits"))
        )
        keyed = self._keyed(docs, doc_id, text)
        at = place("digest")
        keyed = keyed.withColumns({"piece": F.floor(at / _PIECE), "bit": at % _PIECE})
        found = keyed.join(F.broadcast(pieces) if bits // 8 <= WHOLE_FILTER else pieces, "piece")
        return found.where(
            F.expr("getbit(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as bigint), cast(bit % 8 as int)) = 1")
        ).drop("piece", "bit", "bits")

    def resolve(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, digest, keep_id, group_size of each row of the flushed documents."""
        merged = self.compact()
        hits = self._hits(docs, merged, doc_id, text)
        mixed = materialize(
            hits.groupBy("digest")
            .agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
            .where("low <> high")
            .select("digest"),
            "mixed",
        )
        rows = self.rows()
        kept = self._kept(merged)
        if mixed.isEmpty():
            return rows.join(kept, "digest").select(self.columns)
        # Different texts share a digest: group those rows by their bytes.
        sure = rows.join(mixed, "digest", "left_anti").join(kept, "digest")
        unsure = materialize(self._keyed(docs, doc_id, text).join(mixed, "digest", "left_semi"), "unsure")
        groups = materialize(self._kept(self._merged(self._entries(unsure), "digest", "norm")), "groups")
        return sure.select(self.columns).union(unsure.join(groups, ["digest", "norm"]).select(self.columns))


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=None, row: str | None = None, memtable: int = MEMTABLE, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after [\\x20\\x09-\\x0D] is deleted; a
    null text counts as empty.  Of equal texts the row with the most code points
    stays, then the smallest doc_id; ids are numbers or strings.  Rows that share the id that stays are all
    marked kept (an id names one document); a null id counts as larger than all
    others, and where only null ids exist keep_id is null and the rows are kept.
    A text of any length is compared whole.  An empty table gives an empty result;
    other columns are ignored.  row: a column
    of unique numbers; the result then has row, too, and exactly one row of equal
    texts is kept, of rows with the same id that with the smallest number.
    """
    index = MergeIndex(docs.sparkSession, digest=digest, row=row, memtable=memtable, fan_in=fan_in)
    index.flush(docs, doc_id, text)
    found = index.resolve(docs, doc_id, text)
    sha = F.lower(F.hex("digest"))
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep_row") if row else F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        sha.alias("text_sha256"),
        *(["row"] if row else []),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, max(n_points) AS n_points FROM t GROUP BY norm),
k AS (
  SELECT t.norm, min(t.doc_id) AS keep_id
  FROM t JOIN g ON t.norm = g.norm AND t.n_points = g.n_points GROUP BY t.norm)
SELECT t.doc_id, k.keep_id, g.group_size, t.doc_id = k.keep_id AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm JOIN k ON t.norm = k.norm
"""
