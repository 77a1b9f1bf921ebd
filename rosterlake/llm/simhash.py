"""Operator 3: SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits from the words' shingles.  Two halves of 32 bits index
the distinct fingerprints: of two fingerprints at a distance of 3 or less, one
half differs in at most one bit.  Each fingerprint is stored under its halves and
probes the Hamming ball of radius one around them; a flip is enumerated only
where the bit is 0, since the other side of the pair has it at 1.  Matches are
verified over all 64 bits.

A half that very many distinct fingerprints share would give all pairs of them.
Beyond HEAVY fingerprints, the pairs of such a bucket are not formed: each member
goes to the points around its other half (radius 1 and 2), and the members that
meet at a point which is within radius 1 of one of them are connected.  That is
exact for connectivity, and its rows grow in proportion to the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rosterlake.llm.support import components, materialize, text_of

#: Fingerprints in one exact bucket from which on pairs are not formed.
HEAVY = 1500
#: Shingles hashed at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.encode().lower().split()  # of bytes: A-Z, and ASCII white space
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], ">u8"
        )
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, row: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer) of each row, and its row if one is named."""
    kept = ["row"] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64), pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *kept]
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())])
    if row:
        schema.add("row", docs.schema[row].dataType)
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"), *[F.col(row).alias(k) for k in kept]).mapInArrow(run, schema)


def _half(fp: Column, part: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if part == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))).cast("long")


def _exact(fps: DataFrame) -> DataFrame:
    """part, key, rest, fp: each fingerprint under both halves."""
    halves = [
        F.struct(F.lit(p).cast("byte").alias("part"), _half(F.col("fp"), p).alias("key"), _half(F.col("fp"), 1 - p).alias("rest"))
        for p in (0, 1)
    ]
    return fps.select("fp", F.explode(F.array(*halves)).alias("h")).select("h.part", "h.key", "h.rest", "fp")


def _flipped(exact: DataFrame) -> DataFrame:
    """The same with one zero bit of the key set, for each such bit."""
    flips = F.filter(
        F.transform(F.array(*[F.lit(1 << b).cast("long") for b in range(32)]), lambda m: F.col("key").bitwiseOR(m)),
        lambda k: k != F.col("key"),
    )
    return exact.select("part", F.explode(flips).alias("key"), "rest", "fp")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _balls(rows: DataFrame, radius: int) -> DataFrame:
    """rows with point: the values within radius of rest (32 bits)."""
    masks = [0] + [1 << b for b in range(32)]
    if radius == 2:
        masks += [1 << a | 1 << b for a in range(32) for b in range(a)]
    near = F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")
    return rows.select("*", near).select(
        "part", "key", "fp", F.col("rest").bitwiseXOR(F.col("mask")).alias("point"), F.bit_count("mask").alias("away")
    )


def _heavy_links(exact: DataFrame, flipped: DataFrame, heavy: DataFrame) -> DataFrame:
    on = ["part", "key"]
    own = _balls(exact.join(heavy, on, "left_semi"), 2)
    met = _balls(flipped.join(heavy, on, "left_semi"), 1).withColumn("away", F.lit(2))
    points = materialize(own.union(met), "points")
    hubs = materialize(
        points.groupBy("part", "key", "point").agg(F.min(F.when(F.col("away") < 2, F.col("fp"))).alias("hub")).where("hub is not null"),
        "hubs",
    )
    return points.join(hubs, ["part", "key", "point"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def link(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose graph has the components of all pairs at distance 3 or less.

    Outside heavy buckets these are all such pairs, each once or more.
    """
    exact = materialize(_exact(fps), "halves")
    flipped = _flipped(exact)
    large = materialize(
        exact.groupBy("part", "key").count().where(F.col("count") > heavy).select("part", "key"), "heavy"
    )
    light, light_flipped = exact, flipped
    if any_heavy := not large.isEmpty():
        light = exact.join(large, ["part", "key"], "left_anti")
        light_flipped = flipped.join(large, ["part", "key"], "left_anti")
    other = light.select("part", "key", F.col("fp").alias("b"))
    same = light.withColumnRenamed("fp", "a").join(other, ["part", "key"]).where("a < b")
    near = light_flipped.withColumnRenamed("fp", "a").join(other, ["part", "key"])
    pairs = same.select("a", "b").union(near.select("a", "b")).where(_distance("a", "b") <= 3)
    return pairs.union(_heavy_links(exact, flipped, large)) if any_heavy else pairs


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    Fingerprints at 3 or fewer differing bits are linked; component_id is the
    smallest doc_id reachable through links, itself included.  A null text counts
    as empty and, like every text without words, has fingerprint 0, which links
    like any other.  Rows with a null doc_id take part, and get the smallest id of
    their component (null if it has none).  Repeated rows are returned as often as
    given.  A text of any length is read whole, its shingles some at a time.  An empty
    table gives an empty result; other columns are ignored.  row: a column of unique numbers; the result then has row and first_row, that of
    the component's row with the smallest id (null ids last), then the smallest number.
    """
    rows = materialize(fingerprints(docs, doc_id, text, row=row), "fingerprints")
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")] if row else []
    least_first = [F.min("first").alias("first")] if row else []
    named = ["first"] if row else []
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), *first), "distinct")
    found = components(link(distinct.select("fp"), heavy).where("a <> b"))
    rooted = materialize(
        distinct.join(found, distinct["fp"] == found["node"], "left").select(
            "fp", "first_id", *named, F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), *least_first), "least")
    labels = materialize(rooted.drop(*named).join(least, "root").select("fp", "component_id", *named), "labels")
    found = rows.join(labels, "fp")
    return found.select("doc_id", "fp", "component_id", *([F.col("row"), F.col("first.row").alias("first_row")] if row else []))


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
