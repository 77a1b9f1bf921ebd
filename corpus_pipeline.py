"""A training corpus from documents: filter, deduplicate, mix, tokenise.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame that run() writes as Parquet and reads again as the next stage's docs.
All stages but the last return the columns of documents.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows
and ids, and columns of any further names, which it hands on untouched; an empty table
gives an empty one.  A row is judged by itself: what becomes of one row of an id says
nothing of the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlake.llm import byte_bpe, exact_dedup, mixing, quality, simhash
from rosterlake.llm.support import materialize, shared_dir, table
from rosterlake.llm.queries import VOCABULARY, quality_model


#: The column of row numbers inside a stage.
ROW = "pipeline_row"
#: Row numbers to a bitmap, and bytes of bitmaps up to which every task gets them all.
PIECE, WHOLE = 32768, 64 << 20
#: The columns that stages read.
READ = ("doc_id", "text", "source")


def covered(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with neutral names for the columns that no stage reads, so that none clashes, and what gives the names back."""
    names = {c: f"further_{i}" for i, c in enumerate(docs.columns) if c not in READ}
    return docs.withColumnsRenamed(names), lambda df: df.select([F.col(names.get(c, c)).alias(c) for c in docs.columns])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a unique number for each row, written once so that it stays the same."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def without_rows(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """numbered rows without those whose number is dropped's row.

    The dropped numbers become bitmaps, one for each range of PIECE numbers, so that the
    texts need not be shuffled: all bitmaps go to every task while they are small.
    """
    bitmaps = dropped.groupBy(F.floor(F.col("row") / PIECE).alias("piece")).agg(F.bitmap_construct_agg(F.col("row") % PIECE).alias("bits"))
    bitmaps = materialize(bitmaps, "dropped")
    whole = bitmaps.count() * PIECE // 8 <= WHOLE
    placed = rows.withColumns({"piece": F.floor(F.col(ROW) / PIECE), "bit": F.col(ROW) % PIECE})
    found = placed.join(F.broadcast(bitmaps) if whole else bitmaps, "piece", "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("bit") / 8) + 1).cast("int"), 1)), 16, 10).cast("long")
    gone = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    return found.where(~F.coalesce(gone, F.lit(False))).select(rows.columns)


def repeated_rows(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """numbered rows as often as copies (row, copies) says, those that it lacks not at all.

    The binary digits of the copies become bitmaps, as for dropped rows, so that the texts
    need not be shuffled.
    """
    most = copies.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0]
    digits = range(max(int(most).bit_length(), 1))
    set_bit = lambda d: F.when(F.shiftright("copies", d).bitwiseAND(F.lit(1)) == 1, F.col("row") % PIECE)
    bitmaps = copies.groupBy(F.floor(F.col("row") / PIECE).alias("piece")).agg(*[F.bitmap_construct_agg(set_bit(d)).alias(f"bits_{d}") for d in digits])
    bitmaps = materialize(bitmaps, "copies")
    whole = bitmaps.count() * len(digits) * PIECE // 8 <= WHOLE
    placed = rows.withColumns({"piece": F.floor(F.col(ROW) / PIECE), "bit": F.col(ROW) % PIECE})
    found = placed.join(F.broadcast(bitmaps) if whole else bitmaps, "piece")

    def digit(d: int):
        byte = F.conv(F.hex(F.substring(F.col(f"bits_{d}"), (F.floor(F.col("bit") / 8) + 1).cast("int"), 1)), 16, 10).cast("long")
        return F.getbit(byte, (F.col("bit") % 8).cast("int")).cast("int") * (1 << d)

    counted = found.withColumn("copies", reduce(lambda a, b: a + b, map(digit, digits))).where("copies > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(rows.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents that the classifier accepts.

    A null text is scored like an empty one.  Without labels every score is the same,
    0.5, and all documents stay.
    """
    rows, restored = covered(docs)
    scored = quality.score(rows, quality_model(rows, table(spark, sf_dir, "labels")))
    return restored(scored.where("quality_predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts one row stays: that with the most code points, then the smallest id (null last).

    A null text equals the empty one.
    """
    rows, restored = covered(docs)
    rows = numbered(rows)
    return restored(without_rows(rows, exact_dedup.exact_dedup(rows, row=ROW).where("not kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each component one row stays, that with its smallest id (null last).

    Texts without words are one component.
    """
    rows, restored = covered(docs)
    rows = numbered(rows)
    return restored(without_rows(rows, simhash.near_duplicates(rows, row=ROW).where("row <> first_row")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each row as often as the mix takes it.

    A null source is a source of its own.
    """
    rows, restored = covered(docs)
    rows = numbered(rows)
    sized = materialize(rows.select(F.col(ROW).alias("row"), "doc_id", "source", mixing.words("text").alias("size")), "sizes")
    mixed = mixing.mix(sized, size="size").where("mix_copies > 0")
    return restored(repeated_rows(rows, materialize(mixed.select("row", F.col("mix_copies").alias("copies")), "mixed")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids of each row, with the digests of ids and decoded bytes.

    A null text has no tokens.  Further columns end here.
    """
    encoded = byte_bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return byte_bpe.digests(encoded)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mix_sources", mix),
    ("byte_bpe", tokens),
]

#: Rules, fingerprints and byte pairs are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
