"""Dashboards kept up to date: a day's counts, sums and distinct members, added to as rows come.

A partial is a row per day, group and measure.  Counts and sums add up; distinct members are
bitmaps, which unite exactly however often a member comes.  So increments, and rows that are
late by any time, change their own day's partials, and a window of days is read from
partials alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterlake.sources.bucketed import BucketedTable

#: The part of a row that holds no bitmap.
PLAIN = -1


class DailyRollup:
    """Partials in the folder path; groups: columns by which measures are kept apart; all in strings, null as itself."""

    def __init__(self, spark: SparkSession, path: str, groups: list[str], buckets: int = 16):
        self.groups = groups
        keys = ["day", *groups, "measure", "part"]
        schema = ", ".join(["day date", *(f"{g} string" for g in groups), "measure string", "part long, n long, total decimal(38,6), bits binary"])
        self.table = BucketedTable(spark, path, keys, schema, buckets)

    def partials(self, rows: DataFrame, stamp: Column, sums: dict[str, Column], members: dict[str, Column]) -> DataFrame:
        """Partials of rows: for each measure of sums its count and sum where it is not null, for each of members a bitmap of its numbers (0 or more)."""
        day = F.to_date(stamp).alias("day")
        groups = [F.col(g).cast("string").alias(g) for g in self.groups]
        base = rows.where(stamp.isNotNull()).select(day, *groups, *[c.cast("decimal(38,6)").alias(f"sum_{m}") for m, c in sums.items()], *[c.cast("long").alias(f"of_{m}") for m, c in members.items()])
        by = ["day", *self.groups]
        made = []
        if sums:
            once = base.groupBy(*by).agg(*[F.struct(F.lit(m).alias("measure"), F.count(f"sum_{m}").alias("n"), F.coalesce(F.sum(f"sum_{m}"), F.lit(0)).cast("decimal(38,6)").alias("total")).alias(m) for m in sums])
            each = once.select(*by, F.explode(F.array(*sums)).alias("s"))
            made.append(each.select(*by, "s.measure", F.lit(PLAIN).cast("long").alias("part"), "s.n", "s.total", F.lit(None).cast("binary").alias("bits")))
        for m in members:
            held = base.where(F.col(f"of_{m}") >= 0).groupBy(*by, F.bitmap_bucket_number(f"of_{m}").alias("part"))
            bits = held.agg(F.count("*").alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(f"of_{m}")).alias("bits"))
            made.append(bits.select(*by, F.lit(m).alias("measure"), "part", "n", F.lit(0).cast("decimal(38,6)").alias("total"), "bits"))
        out = made[0]
        for more in made[1:]:
            out = out.unionByName(more)
        return out

    def add(self, rows: DataFrame, stamp: Column, sums: dict[str, Column], members: dict[str, Column], batch: int) -> None:
        """New rows, of whatever days; the same batch number again changes nothing."""
        new = self.partials(rows, stamp, sums, members)
        self.table.merge(new, {"n": F.sum("n"), "total": F.sum("total").cast("decimal(38,6)"), "bits": F.bitmap_or_agg("bits")}, batch)

    def window(self, as_of: str, days: int) -> DataFrame:
        """groups, measure, n, total, members: over the last days days, the day as_of among them."""
        day = F.lit(as_of).cast("date")
        held = self.table.read().where((F.col("day") > F.date_sub(day, days)) & (F.col("day") <= day))
        # First each bitmap's days, then the bitmaps of a measure: no row holds more than one bitmap.
        united = held.groupBy(*self.groups, "measure", "part").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bitmap_or_agg("bits").alias("bits"))
        counted = F.when(F.col("part") != PLAIN, F.bitmap_count("bits"))
        return united.groupBy(*self.groups, "measure").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"), F.sum(counted).alias("members"))
