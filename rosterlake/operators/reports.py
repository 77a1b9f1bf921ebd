"""Reporting aggregates: per-child aggregates are joined to their parent, never correlated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_totals(parent: DataFrame, key: str, parts: list[DataFrame], zero: list[str]) -> DataFrame:
    """parent left-joined with aggregates by key; the columns in zero become 0 where there are none."""
    out = reduce(lambda a, b: a.join(b, key, "left"), parts, parent)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def ordered_values(value: Column, order: list[Column]) -> Column:
    """An aggregate: values as an array in the given order."""
    names = [c.alias(f"o{i}") for i, c in enumerate(order)]
    return F.transform(F.sort_array(F.collect_list(F.struct(*names, value.alias("v")))), lambda s: s["v"])


def first_values(rows: DataFrame, key: str, value: Column, order: list[Column], most: int, name: str) -> DataFrame:
    """key, and an array of the first values in the given order; no more than these are collected."""
    first = top(rows.select(key, value.alias("v"), *[c.alias(f"o{i}") for i, c in enumerate(order)]), key, [F.col(f"o{i}") for i in range(len(order))], most)
    return first.groupBy(key).agg(ordered_values(F.col("v"), [F.col("place")]).alias(name))


def coverage(rows: DataFrame, column: str) -> DataFrame:
    """present, missing, total and percent of one column; null percent for an empty table."""
    present, total = F.count(column), F.count("*")
    return rows.agg(
        present.alias("present"), (total - present).alias("missing"), total.alias("total"),
        F.round(F.try_divide(present * F.lit(100.0), total), 2).alias("percent"),
    )


def top(rows: DataFrame, partition: str, order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each partition, with their place."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where(F.col(name) <= k)


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, expected, actual, ratio and status of two frames of counts (key, n)."""
    both = expected.withColumnRenamed("n", "expected").join(actual.withColumnRenamed("n", "actual"), key, "full_outer")
    e, a = F.coalesce("expected", F.lit(0)), F.coalesce("actual", F.lit(0))
    status = F.when(a == e, "ok").when(a < e, "missing").otherwise("extra")
    ratio = F.when(e == 0, 1.0).otherwise(F.round(F.least(a / F.nullif(e, F.lit(0)), F.lit(1.0)), 4))
    return both.select(key, e.alias("expected"), a.alias("actual"), ratio.alias("ratio"), status.alias("status"))
