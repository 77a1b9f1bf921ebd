"""Search by a map of filters: field -> {"operator": ..., "value": ...}.

A catalogue says where a field lives.  Filters become predicates on the base table,
or semi joins with a child table that is filtered or aggregated first, so that
Catalyst can push them into the scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.functions import temporal


@dataclass(frozen=True)
class Field:
    """A column of the base table, of a child (table, key), a sum over a child, or an age in years on a day."""

    column: str
    child: str | None = None
    key: str | None = None
    total: bool = False
    divisor: float = 1.0
    as_of: str | None = None


COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "contains": lambda c, v: c.ilike(f"%{v}%"),
    "in": lambda c, v: c.isin(*as_list(v)),
    "not_in": lambda c, v: ~c.isin(*as_list(v)),
    "between": lambda c, v: c.between(*v),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


#: Values of the operator all that are flags of their own in one pass.
FLAGS = 16


def as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def predicate(column: Column, operator: str, value) -> Column:
    """An unknown operator means equality."""
    return COMPARE.get(operator, COMPARE["eq"])(column, value)


def has_all(child: DataFrame, key: str, column: str, values) -> DataFrame:
    """Keys whose rows hold every one of the values."""
    values = sorted(set(as_list(values)))
    held = child.where(F.col(column).isin(*values)).groupBy(key).agg(F.count_distinct(column).alias("n"))
    return held.where(F.col("n") == len(values)).select(key)


def apply_filters(
    base: DataFrame, key: str, filters: dict, fields: dict[str, Field], tables: dict[str, DataFrame]
) -> tuple[DataFrame, list[str]]:
    """The rows of base that meet every filter, and warnings.

    A bare value means equality; a filter whose value is null is dropped unless the
    operator needs none; an unknown field is skipped with a warning.  In a child
    table a filter asks for some row, the operator all for a row of each value; a
    sum over no rows is 0.  Several filters on one child table are one pass over it: a
    row for each key says which of them are met, so its rows are not shuffled for each.
    """
    warnings, out = [], base
    together: dict[str, list[tuple[Field, str, object]]] = {}
    for name, given in filters.items():
        if name not in fields:
            warnings.append(f"unknown field: {name}")
            continue
        given = given if isinstance(given, dict) else {"operator": "eq", "value": given}
        operator, value = given.get("operator", "eq"), given.get("value")
        if value is None and operator not in ("is_null", "is_not_null"):
            continue
        field = fields[name]
        if field.child is None:
            column = F.col(field.column)
            if field.as_of:
                column = temporal.age_years(column.cast("date"), F.lit(field.as_of).cast("date"))
            out = out.where(predicate(column, operator, value))
            continue
        if operator != "all" or 0 < len(as_list(value)) <= FLAGS:
            together.setdefault(f"{field.child}/{field.key}", []).append((field, operator, value))
        else:
            child = tables[field.child].withColumnRenamed(field.key, key).select(key, field.column)
            out = out.join(has_all(child, key, field.column, value), key, "left_semi")
    for asked in together.values():
        field, operator, value = asked[0]
        child = tables[field.child].withColumnRenamed(field.key, key)
        if len(asked) > 1 and not all(f.total for f, _, _ in asked):
            out = out.join(meeting(child, key, asked), key, "left_semi")
            continue
        for field, operator, value in asked:
            out = by_child(out, child.select(key, field.column), key, field, operator, value)
    return out, warnings


def by_child(out: DataFrame, child: DataFrame, key: str, field: Field, operator: str, value) -> DataFrame:
    """The rows of out that meet one filter on a child table."""
    if field.total:
        sums = child.groupBy(key).agg((F.sum(field.column) / field.divisor).alias("filter_total"))
        return out.join(sums, key, "left").where(predicate(F.coalesce("filter_total", F.lit(0.0)), operator, value)).drop("filter_total")
    if operator == "all":
        return out.join(has_all(child, key, field.column, value), key, "left_semi")
    return out.join(child.where(predicate(F.col(field.column), some(operator), value)), key, "left_semi")


def some(operator: str) -> str:
    return "in" if operator in ("any", "eq") else operator


def meeting(child: DataFrame, key: str, asked: list[tuple[Field, str, object]]) -> DataFrame:
    """Keys whose rows meet every one of several filters, of which one at least asks for a row."""
    told, wanted = [], F.lit(True)
    for i, (field, operator, value) in enumerate(asked):
        column = F.col(field.column)
        if field.total:
            told.append((F.sum(column) / field.divisor).alias(f"t{i}"))
            wanted = wanted & predicate(F.coalesce(f"t{i}", F.lit(0.0)), operator, value)
            continue
        tests = [column == v for v in as_list(value)] if operator == "all" else [predicate(column, some(operator), value)]
        for j, test in enumerate(tests):
            told.append(F.bool_or(F.coalesce(test, F.lit(False))).alias(f"t{i}_{j}"))
            wanted = wanted & F.col(f"t{i}_{j}")
    return child.groupBy(key).agg(*told).where(wanted).select(key)


def ordered_page(rows: DataFrame, sort: str | None, sorts: dict[str, Column], default: str, key: str, limit: int, offset: int = 0, cap: int = 100) -> DataFrame:
    """Sorted by a named order (the default if unknown), ties by key, at most cap rows."""
    page = rows.orderBy(sorts.get(sort, sorts[default]), F.col(key))
    return (page.offset(offset) if offset else page).limit(min(limit, cap))


def free_text(rows: DataFrame, columns: list[str], asked: str, exact: dict | None = None) -> DataFrame:
    """Rows whose columns, joined by spaces, contain the text (case ignored) and that equal every exact value; an empty text fits all."""
    joined = F.lower(F.concat_ws(" ", *columns))
    out = rows.where(F.contains(joined, F.lit(asked.strip().lower())))
    for column, value in (exact or {}).items():
        out = out.where(F.col(column) == value)
    return out
