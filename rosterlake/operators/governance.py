"""Constraints, orphans, erasure and retention over sets of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def repeats(table: DataFrame, key: str, unique: dict[str, list[str]]) -> DataFrame:
    """rule, key, n: one row for each group of rows that repeats unique columns, with its smallest key and its size."""
    parts = [
        table.groupBy(*columns).agg(F.min(key).alias("key"), F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("rule"), "key", "n")
        for name, columns in unique.items()
    ]
    return reduce(DataFrame.union, parts)


def violations(table: DataFrame, key: str, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """rule, key of each row that breaks a rule (true means broken) or repeats unique columns; nulls repeat one another.

    Repeated values are counted before they meet the rows again.
    """
    named = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    out = table.select(named.alias("rule"), F.col(key).alias("key"))
    for name, columns in (unique or {}).items():
        renamed = {c: f"repeated_{i}" for i, c in enumerate(columns)}
        repeated = table.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(r) for c, r in renamed.items()])
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(r)) for c, r in renamed.items()])
        out = out.union(table.join(repeated, same, "left_semi").select(F.lit(name).alias("rule"), F.col(key).alias("key")))
    return out


def orphans(pairs: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """reason, key of keys in the first table that the second lacks."""
    parts = [
        a.select(F.col(k).alias("key")).distinct().join(b.select(F.col(k).alias("key")).distinct(), "key", "left_anti").select(F.lit(n).alias("reason"), "key")
        for n, (a, b, k) in pairs.items()
    ]
    return reduce(DataFrame.union, parts)


def erase(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the given keys."""
    doomed = keys.select(F.col(key).alias("doomed_key")).distinct()
    return {n: df.join(doomed, F.col(c) == F.col("doomed_key"), "left_anti") for n, (df, c) in tables.items()}


def erase_dry_run(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> DataFrame:
    """table_name, n_rows that erase() would remove."""
    doomed = keys.select(F.col(key).alias("doomed_key")).distinct()
    parts = [
        df.join(doomed, F.col(c) == F.col("doomed_key"), "left_semi").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n, (df, c) in tables.items()
    ]
    return reduce(DataFrame.union, parts)


def retention(rows: DataFrame, stamp: str, kind: str, policies: dict[str, tuple[int, str]], as_of: str) -> DataFrame:
    """rows with action: that of its kind's policy (days, action) if older, else keep."""
    action = F.lit("keep")
    for name, (days, what) in policies.items():
        old = F.col(stamp) < F.expr(f"timestamp_ntz '{as_of}' - INTERVAL {days} DAYS")
        action = F.when((F.col(kind) == name) & old, what).otherwise(action)
    return rows.withColumn("action", action)


def hidden(column: Column, salt: str) -> Column:
    """A digest in place of a value that must not be read: equal values stay equal; null stays null."""
    return F.sha2(F.concat(F.lit(salt), column.cast("string")), 256)


def enforce(judged: DataFrame, key: str, personal: list[str], salt: str, action: str = "action") -> dict[str, DataFrame]:
    """What becomes of rows that retention() judged: kept, archived, anonymised, and the keys of the deleted.

    kept: rows as they are, and anonymised ones in their place with digests in the
    personal columns; archived: rows that leave the table for the archive; deleted: keys
    alone, so that the rows can be taken out elsewhere too (erase).  An action that is none of
    archive, delete and anonymise keeps the row, so no row is lost.
    """
    plain = [c for c in judged.columns if c != action]
    masked = judged.where(F.col(action) == "anonymise").select(*[hidden(F.col(c), salt).alias(c) if c in personal else F.col(c) for c in plain])
    stay = judged.where(F.col(action).isNull() | ~F.col(action).isin("archive", "delete", "anonymise")).select(*[F.col(c).cast("string").alias(c) if c in personal else F.col(c) for c in plain])
    return {
        "kept": stay.unionByName(masked),
        "archived": judged.where(F.col(action) == "archive").select(plain),
        "anonymised": masked,
        "deleted": judged.where(F.col(action) == "delete").select(key),
    }
