"""Columns over nested records: arrays of structs of one person."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterlake.functions.scoring import clamp
from rosterlake.functions.text import normalise

filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
some = lambda c: size(c) > 0
either = lambda a, b: F.when(some(a), a).otherwise(b)


def split_name(name: Column) -> Column:
    """struct(first, last): up to the first space, and the rest; empty strings where there is none."""
    parts = F.split(F.coalesce(name, F.lit("")), " ", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("first"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("last"))


def names(items: Column, *fields: str) -> Column:
    """The first filled field of each item, items without one left out; empty for null."""
    pick = lambda x: F.coalesce(*[F.nullif(x[f], F.lit("")) for f in fields])
    return F.coalesce(F.array_compact(F.transform(items, pick)), F.array().cast("array<string>"))


def distinct_names(items: Column, *fields: str) -> Column:
    """names() without repeats, in the order of first appearance."""
    return F.array_distinct(names(items, *fields))


def merged(new: Column, old: Column, is_array: bool = False) -> Column:
    """new where it holds something, else old."""
    return either(new, old) if is_array else F.coalesce(F.nullif(new, F.lit("")), old)


def summary_text(name: Column, parts: list[tuple[str, Column, int, str]]) -> Column:
    """name and the parts joined by " | ".

    parts: (label, array of strings, most, separator); at most that many items count,
    and a part without any is left out.
    """
    part = lambda label, a, most, sep: F.when(some(a), F.concat(F.lit(label), F.array_join(F.slice(a, 1, most), sep)))
    return F.concat_ws(" | ", F.nullif(F.trim(name), F.lit("")), *[part(*p) for p in parts])


def total_months(items: Column) -> Column:
    return F.coalesce(F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["months"].cast("long"), F.lit(0))), F.lit(0).cast("long"))


def first_where(items: Column, flag: str) -> Column:
    """The first item whose flag is true."""
    return F.get(F.filter(items, lambda x: F.coalesce(x[flag], F.lit(False))), F.lit(0))


def search_document(name: Column, jobs: Column, skills: Column, raw: Column, most: int = 10000) -> Column:
    """struct for a search table: names, totals, current job, flat skill names, the text cut at so many characters.

    jobs: title, company, months, is_current; skills: name.
    """
    current = first_where(jobs, "is_current")
    months = total_months(jobs)
    return F.struct(
        name.alias("full_name"), normalise(name).alias("plain_name"), months.alias("total_months"), (months / 12).alias("total_years"),
        current["title"].alias("current_title"), current["company"].alias("current_company"),
        names(skills, "name").alias("skills"), F.substring(raw, 1, most).alias("text"),
    )


def whole_search_document(name: Column, jobs: Column, skills: Column, education: Column, levels: list[str], lists: dict[str, Column], raw: Column, most: int = 10000) -> Column:
    """search_document with the highest education, by the order of levels (the last is the highest), and further flat lists of names."""
    base = search_document(name, jobs, skills, raw, most)
    rank = lambda e: F.array_position(F.array(*map(F.lit, levels)), e["level"])
    ranked = F.transform(education, lambda e: F.struct(rank(e).alias("rank"), e["level"].alias("level")))
    fields = ("full_name", "plain_name", "total_months", "total_years", "current_title", "current_company", "skills", "text")
    more = [F.coalesce(a, F.array().cast("array<string>")).alias(n) for n, a in lists.items()]
    return F.struct(*[base[f].alias(f) for f in fields], F.array_max(ranked)["level"].alias("highest_education"), F.size(jobs).alias("n_jobs"), *more)


def list_row(name: Column, jobs: Column, skills: Column) -> Column:
    """struct(name, role, n_jobs, n_skills) for a list; the role is that of the first job, or Unknown Role."""
    role = F.coalesce(F.nullif(F.get(jobs, F.lit(0))["title"], F.lit("")), F.lit("Unknown Role"))
    return F.struct(name.alias("name"), role.alias("role"), size(jobs).alias("n_jobs"), size(skills).alias("n_skills"))


def section_completeness(first: Column, last: Column, email: Column, phone: Column, city: Column, education: Column, jobs: Column, skills: Column, languages: Column) -> Column:
    """0 to 1: personal data to 0.25, then education 0.20, jobs 0.30, skills 0.15 and languages 0.10, each capped.

    The last four are counts.
    """
    worth = lambda test, w: F.when(test, w).otherwise(0.0)
    upto = lambda n, each, most: F.least(F.coalesce(n, F.lit(0)) * each, F.lit(most))
    personal = worth(filled(first) & filled(last), 0.05) + worth(filled(email), 0.10) + worth(filled(phone), 0.05) + worth(filled(city), 0.05)
    return F.round(clamp(personal + upto(education, 0.10, 0.20) + upto(jobs, 0.10, 0.30) + upto(skills, 0.03, 0.15) + upto(languages, 0.05, 0.10)), 4)


def share_true(tests: list[Column]) -> Column:
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)) / len(tests)


def audit_score(critical: list[Column], optional: list[Column]) -> Column:
    """70 % for the critical tests that hold, 30 % for the optional ones."""
    return F.round(share_true(critical) * 0.7 + share_true(optional) * 0.3, 4)


def mean_filled(values: Column) -> Column:
    """The mean of the values that are neither null nor 0; null without any."""
    held = F.filter(values, lambda x: x.isNotNull() & (x != 0))
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda s, x: s + x), F.nullif(F.size(held), F.lit(0)))


def confidence(sections: dict[str, Column]) -> Column:
    """struct(average, lowest_section, lowest_value) of sections' means; ties go to the earlier section."""
    made = [F.struct(c.alias("value"), F.lit(i).alias("place"), F.lit(n).alias("name")) for i, (n, c) in enumerate(sections.items())]
    held = F.filter(F.array(*made), lambda s: s["value"].isNotNull())
    low = F.array_min(held)
    return F.struct(mean_filled(F.transform(held, lambda s: s["value"])).alias("average"), low["name"].alias("lowest_section"), low["value"].alias("lowest_value"))


def tally(warnings: Column, severities: list[str]) -> Column:
    """struct of counts of an array of warnings by severity, and of those fixed."""
    count = lambda test: size(F.filter(warnings, test))
    of = lambda s: count(lambda w: w["severity"] == s).alias(s)
    by = [of(s) for s in severities]
    return F.struct(*by, count(lambda w: F.coalesce(w["fixed"], F.lit(False))).alias("fixed"))


def swapped(start: Column, end: Column) -> Column:
    """struct(start, end, swapped): reversed dates change places; an open side stays open."""
    wrong = F.coalesce(start > end, F.lit(False))
    return F.struct(F.when(wrong, end).otherwise(start).alias("start"), F.when(wrong, start).otherwise(end).alias("end"), wrong.alias("swapped"))


def iso_date(c: Column) -> Column:
    """struct(day, bad): bad where there is a text that is no ISO date."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.struct(day.alias("day"), (c.isNotNull() & day.isNull()).alias("bad"))


def enum(c: Column, allowed: list[str], default: str) -> Column:
    """struct(value, bad): the value in lower case if allowed, else the default; bad where there was another."""
    low = F.lower(F.trim(c))
    good = F.coalesce(low.isin(*allowed), F.lit(False))
    return F.struct(F.when(good, low).otherwise(default).alias("value"), (c.isNotNull() & ~good).alias("bad"))


def progress(step: Column, steps: list[str]) -> Column:
    """Percent of the ordered steps done: 0 for failed or unknown, 100 for completed, else the step's place, rounded down."""
    place = F.array_position(F.array(*map(F.lit, steps)), step) - 1
    return F.when(step == "completed", 100).when(place >= 0, F.floor(place * 100 / (len(steps) - 1))).otherwise(0).cast("int")


def suitability(rank: Column, label: Column, percent: Column) -> Column:
    """interview for the first five, for high ones and from 70 %; else consider."""
    good = (rank <= 5) | F.lower(label).isin("high", "υψηλή") | (percent >= 70)
    return F.when(F.coalesce(good, F.lit(False)), "interview").otherwise("consider")
