"""Operator 4: mixing sources to target weights by systematic sampling.

Within a source each document expects target / size-of-source copies.  The
documents are put in an order, the expected copies are summed along it, one random
offset is added, and a document is emitted once for each integer that the sum
crosses at it.  Sums are kept as integers (2^-24 of a copy), so that they do not
depend on the order of additions.

The prefix sum runs in three levels.  Documents are dealt to blocks (source, size
class, hash bucket); the number of buckets follows the number of documents, so
that a block stays small even if one source holds a third of all rows, but there are
many blocks: up to half as many as documents, where sources and classes are many.  So
SPAN buckets of a class make a span.  Counts of spans are summed along each source,
those of blocks inside a span, and inside a block the rank is a window: no window has
more than a five-hundredth of the rows of its source.  As size classes come in order, a
source's sample has nearly the sizes of the source.

Only built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterlake.llm.support import WORD_REGEX, text_of

WEIGHTS = (5, 2, 1)
#: No target beyond so many times the size of its source.
LIMIT = 3
#: Documents for each hash bucket, of all sources together.
PER_BUCKET = 2048
#: Buckets of a span.
SPAN = 1024
#: Parts of a copy.
UNIT = 1 << 24


def _hash(column: Column, digits: int = 8) -> Column:
    """The first hex digits of the MD5 of a column's text, as a number; any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")


#: The size class, in quarter octaves: 4 times the binary length of size, plus its next two bits.
SIZE_CLASS = "length(bin(mix_size)) * 4 + if(mix_size >= 4, shiftright(mix_size, length(bin(mix_size)) - 3) & 3L, 0L)"


def words(text: str | Column) -> Column:
    """The size of a text: its number of words, 0 for null."""
    return F.regexp_count(text_of(text), F.lit(WORD_REGEX)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size -> with target: a share of the total by weight, at most limit times the size.

    Weights repeat over the sources in code point order, null last.  Excess over a
    limit is shared again by weight, until none is above; that fixes one level
    such that each target is the smaller of limit * size and level * weight.  The
    source whose limit is smallest against its weight reaches it first, so a sum
    along that order gives the level.  One row per source is all that is windowed.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    listed = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(limit))
    reach = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = reach.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = listed.withColumn("level", level)
    # The first source that stays under its limit has the level of all that stay under.
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(whole)
    free = F.coalesce(first["level"], F.lit(float("inf")))
    return levelled.select("source", "source_size", F.least("most", free * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple = WEIGHTS,
    limit: int = LIMIT,
    seed: str = "mix",
    size: str | None = None,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_copies of each row.

    Size: the number of words of the text, a null text has none.  A null source is
    a source of its own.  A source without words has target 0 and no copies.
    Repeated rows are rows of their own, each with its copies; ties of size are
    ordered by the hash of the id, then by id.  Reruns agree: all draws come from
    hashes of ids and of seed.  An empty table gives an empty result.  Columns of
    docs named mix_* are replaced.  A very long text is counted like any other.
    size: a column that holds the sizes already (long, not null); then no text is read.
    """
    buckets = max(1, docs.select(doc_id).count() // PER_BUCKET)
    keys = {
        "mix_size": F.col(size) if size else words(text),
        "mix_class": F.expr(SIZE_CLASS),
        "mix_hash": _hash(F.col(doc_id)),
        "mix_source": F.col(source),
    }
    rows = docs
    for name, value in keys.items():
        rows = rows.withColumn(name, value)
    rows = rows.withColumn("mix_bucket", F.col("mix_hash") % buckets)
    block = ["mix_source", "mix_class", "mix_bucket"]
    counts = rows.groupBy(*block).agg(F.count("*").alias("n"), F.sum("mix_size").alias("block_size"))
    counts = counts.withColumn("span", F.floor(F.col("mix_bucket") / SPAN))
    along = Window.partitionBy("span_source").orderBy("span_class", "span_of")
    spans = counts.groupBy(F.col("mix_source").alias("span_source"), F.col("mix_class").alias("span_class"), F.col("span").alias("span_of")).agg(F.sum("n").alias("span_n"))
    spans = spans.withColumn("span_before", F.sum("span_n").over(along) - F.col("span_n"))
    within = Window.partitionBy("mix_source", "mix_class", "span").orderBy("mix_bucket")
    inner = counts.withColumn("inner_before", F.sum("n").over(within) - F.col("n"))
    same = inner["mix_source"].eqNullSafe(spans["span_source"]) & (inner["mix_class"] == spans["span_class"]) & (inner["span"] == spans["span_of"])
    offsets = inner.join(spans, same).withColumn("mix_before", F.col("span_before") + F.col("inner_before"))
    per_source = counts.groupBy(F.col("mix_source").alias("source")).agg(F.sum("block_size").alias("source_size"))
    aims = targets(per_source, weights, limit)
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0)
    start = _hash(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))) % UNIT
    aims = aims.withColumns({"mix_expected": expected.cast("long"), "mix_start": start})
    plan = offsets.join(aims, offsets["mix_source"].eqNullSafe(aims["source"])).select(
        F.col("mix_source").alias("of_source"), F.col("mix_class").alias("of_class"), F.col("mix_bucket").alias("of_bucket"),
        "mix_before", "mix_expected", "mix_start",
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
    )
    inside = Window.partitionBy(*block).orderBy("mix_size", "mix_hash", doc_id)
    ranked = rows.drop("mix_before", "mix_expected", "mix_start", "mix_source_size", "mix_target").withColumn("mix_rank", F.row_number().over(inside))
    placed = ranked.join(
        plan,
        ranked["mix_source"].eqNullSafe(plan["of_source"])
        & (ranked["mix_class"] == plan["of_class"])
        & (ranked["mix_bucket"] == plan["of_bucket"]),
    )
    last = F.col("mix_before") + F.col("mix_rank")
    copies = F.shiftright(F.col("mix_start") + F.col("mix_expected") * last, 24) - F.shiftright(
        F.col("mix_start") + F.col("mix_expected") * (last - 1), 24
    )
    kept = [c for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]
    return placed.select(*[ranked[c] for c in kept], "mix_size", "mix_source_size", "mix_target", copies.alias("mix_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed rows as often as they are taken, without the mix_ columns."""
    repeated = mixed.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return repeated.drop("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_copy")


def oracle_sql(weights: tuple = WEIGHTS, limit: int = LIMIT, seed: str = "mix") -> str:
    cases = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return rf"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
c AS (
  SELECT *, length(bin(size)) * 4 + CASE WHEN size >= 4 THEN (size >> (length(bin(size)) - 3)) & 3 ELSE 0 END AS cl,
         h % greatest(1, (SELECT count(*) FROM documents) // {PER_BUCKET}) AS b
  FROM d),
s0 AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS w, source_size * {float(limit)} AS most
  FROM s0),
s2 AS (
  SELECT *, ((SELECT sum(source_size) FROM s0) - coalesce(sum(most) OVER p, 0.0))
            / ((SELECT sum(w) FROM s1) - coalesce(sum(w) OVER p, 0.0)) AS lev
  FROM s1 WINDOW p AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (
  SELECT source, source_size, least(most, w * coalesce(
    (SELECT arg_min(lev, most / w) FROM s2 WHERE lev * w < most), 'infinity'::DOUBLE)) AS target
  FROM s2),
s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT} + 0.5) ELSE 0 END::BIGINT AS e,
         ('0x' || substr(md5('{seed}' || coalesce(source, '')), 1, 8))::BIGINT % {UNIT} AS u
  FROM s3),
r AS (
  SELECT c.doc_id, c.size, s4.source_size, s4.target, s4.e, s4.u,
         row_number() OVER (PARTITION BY c.source ORDER BY c.cl, c.b, c.size, c.h, c.doc_id) AS k
  FROM c JOIN s4 ON c.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (((u + e * k) >> 24) - ((u + e * (k - 1)) >> 24)) * size AS taken
FROM r
"""
