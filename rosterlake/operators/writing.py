"""Nested records written as flat tables: upserts, replaced children, new versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.functions.contact import without_nuls
from rosterlake.functions.text import normalise

#: How a column changes where a key is in both states.
RULES = {
    "replace": lambda new, old: new,
    "fill": lambda new, old: F.coalesce(new, old),
    "keep": lambda new, old: F.coalesce(old, new),
    "greatest": lambda new, old: F.greatest(new, old),
    "add": lambda new, old: F.coalesce(new, F.lit(0)) + F.coalesce(old, F.lit(0)),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """The state after new rows meet old ones: keys and the columns of rules, one row per key.

    Columns without a value on the one side count as null there, so a rule also serves
    for rows that are only in one state; replace keeps what was there for keys that are
    not new.
    """
    tag = lambda df, side: df.select(*keys, F.lit(True).alias(f"{side}_here"), *[F.col(c).alias(f"{side}_{c}") for c in rules])
    both = tag(old, "old").join(tag(new, "new"), keys, "full_outer")
    def made(c, r):
        n, o = F.col(f"new_{c}"), F.col(f"old_{c}")
        return F.when(F.col("new_here").isNull(), o).otherwise(RULES[r](n, o))
    return both.select(*keys, *[made(c, r).alias(c) for c, r in rules.items()])


def fan_out(records: DataFrame, key: str, parent: dict[str, Column], children: dict[str, dict[str, Column]], raw: str = "raw_json") -> dict[str, DataFrame]:
    """The flat tables of nested records: parents, and one per array of structs.

    parent: column -> expression over the record.  children: array column -> (column ->
    expression over item, one struct of it); an item without any value is left out,
    place is its turn in the array.  The parent keeps the whole record as JSON, without NULs.
    """
    whole = without_nuls(F.to_json(F.struct(*[F.col(c) for c in records.columns])))
    tables = {"parents": records.select(key, *[e.alias(c) for c, e in parent.items()], whole.alias(raw))}
    for name, columns in children.items():
        rows = records.select(key, F.posexplode(name).alias("place", "item")).select(key, "place", *[e.alias(c) for c, e in columns.items()])
        tables[name] = rows.dropna("all", subset=list(columns))
    return tables


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Old child rows of parents that were not written again, and all new ones."""
    return old.join(parents.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_version(tables: dict[str, DataFrame], path: str, version: str, by: dict[str, str] | None = None) -> dict[str, str]:
    """Writes each table to its own new folder and returns the folders; a reader swaps to them when all are there.

    by: table -> column whose values should lie together in files.
    """
    folders = {}
    for name, table in tables.items():
        folders[name] = f"{path}/{name}/version={version}"
        rows = table.repartition(F.col(by[name])) if by and name in by else table
        rows.write.mode("overwrite").parquet(folders[name])
    return folders


def on_write(rows: DataFrame, now: Column, normalised: dict[str, str], stamp: str = "updated_at") -> DataFrame:
    """rows with what every write sets: stamp as now, and for each column of normalised its plain text under the given name."""
    return rows.withColumns({new: normalise(F.col(c)) for c, new in normalised.items()} | {stamp: now})


def indexed(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The documents of an index after new ones came: one row per key, of several new ones the last by order.

    A document without a key is left out, as nothing could replace it.
    """
    rest = [c for c in new.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return replace_children(old, new.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, "last.*"), new, key)


def write_index(docs: DataFrame, path: str, key: str, batch: int = 500) -> None:
    """JSON files of at most batch documents; all documents of a key lie in one partition."""
    docs.repartition(F.col(key)).write.option("maxRecordsPerFile", batch).mode("overwrite").json(path)


def unmapped(records: DataFrame, key: str, column: str) -> DataFrame:
    """key, field, value, normalised: one row for each entry of a map of fields that no table has."""
    return records.select(key, F.explode(column).alias("field", "value")).where("value is not null").withColumn("normalised", F.lower(F.trim("value")))
