"""Several readings of one document made into one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterlake.functions.contact import sequence_ratio


def shares(rows: DataFrame, key: str, value: str, out: str = "share") -> DataFrame:
    """rows with value over its sum per key; null where the sum is 0."""
    sums = rows.groupBy(key).agg(F.sum(value).alias("value_sum"))
    return rows.join(sums, key).withColumn(out, F.try_divide(F.col(value), F.nullif(F.col("value_sum"), F.lit(0.0)))).drop("value_sum")


def fuse_readings(readings: DataFrame, key: str, strong: float = 0.9, fair: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(key, text, confidence, agreement, arbitrate) and (key, engine, share).

    readings: key, engine, text, confidence; a few engines per document.  The most
    confident text wins (then the first engine).  Agreement is the mean sequence ratio
    of all pairs of engines, case ignored: from strong on the confidence is 0.95, from
    fair on 0.80, below 0.70 with a call for arbitration.  One reading alone keeps 0.7
    of its own confidence; without any the text is empty.  Share: the ratio with the
    winner, over their sum.
    """
    good = readings.where("text is not null and text <> ''").select(key, "engine", "text", "confidence")
    first = F.min_by(F.struct("text", "confidence"), F.struct(-F.coalesce("confidence", F.lit(0.0)), F.col("engine")))
    best = good.groupBy(key).agg(first.alias("best"), F.count("*").alias("n"))
    other = good.select(key, F.col("engine").alias("other"), F.col("text").alias("other_text"))
    pairs = good.join(other, key).where("engine < other").select(key, sequence_ratio(F.lower("text"), F.lower("other_text")).alias("ratio"))
    agreed = pairs.groupBy(key).agg(F.avg("ratio").alias("agreement"))
    a = F.coalesce("agreement", F.lit(0.0))
    sure = F.when(F.col("n").isNull(), 0.0).when(F.col("n") == 1, F.col("best.confidence") * 0.7).when(a >= strong, 0.95).when(a >= fair, 0.80).otherwise(0.70)
    joined = readings.select(key).distinct().join(best, key, "left").join(agreed, key, "left")
    fused = joined.select(
        key, F.coalesce("best.text", F.lit("")).alias("text"), F.round(sure, 4).alias("confidence"), F.round(a, 4).alias("agreement"),
        F.coalesce((F.col("n") > 1) & (a < fair), F.lit(False)).alias("arbitrate"),
    )
    ratios = good.join(best.select(key, F.col("best.text").alias("winner")), key).withColumn("ratio", sequence_ratio(F.lower("text"), F.lower("winner")))
    return fused, shares(ratios, key, "ratio").select(key, "engine", F.round("share", 4).alias("share"))
