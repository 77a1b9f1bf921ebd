"""Audits and warnings of nested person records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.functions import records as R
from rosterlake.functions.scoring import QUALITY, level

WARNING = "struct<category:string,severity:string,message:string,field:string,section:string,original:string,suggested:string,fixed:boolean>"


def audit(people: DataFrame, key: str) -> DataFrame:
    """One row per person: key, score, level, coverage, average, lowest_section, lowest_value, missing_critical, missing_optional, issues.

    people: first, last, email, phone, city (strings); education, jobs, skills,
    languages, certificates, software (arrays of structs).  skills, certificates and
    software carry matched_id, the first three and personal (a number) confidence.
    """
    has = {n: R.some(F.col(n)) for n in ("education", "jobs", "skills", "languages", "certificates", "software")}
    name, contact = R.filled(F.col("first")) & R.filled(F.col("last")), R.filled(F.col("email")) | R.filled(F.col("phone"))
    city, history = R.filled(F.col("city")), has["education"] | has["jobs"]
    score = R.audit_score([name, contact, history], [has["skills"], has["languages"], city, has["certificates"], has["software"]])
    kinds = ("skills", "certificates", "software")
    total = sum((R.size(F.col(k)) for k in kinds), F.lit(0))
    matched = sum((R.size(F.filter(F.col(k), lambda x: x["matched_id"].isNotNull())) for k in kinds), F.lit(0))
    coverage = F.coalesce(F.try_divide(matched, total), F.lit(1.0))
    means = {"personal": F.nullif(F.col("personal"), F.lit(0.0))} | {n: R.mean_filled(F.transform(F.col(n), lambda x: x["confidence"])) for n in ("education", "jobs", "skills")}
    sure = R.confidence(means)
    lacking = lambda tests: F.array_compact(F.array(*[F.when(~t, F.lit(n)) for n, t in tests.items()]))
    issues = F.array_compact(F.array(
        F.when(has["skills"] & (F.col("coverage") < 0.5), F.lit("low_taxonomy_coverage")),
        F.when(F.col("sure.lowest_value") < 0.6, F.concat(F.lit("low_confidence_"), F.col("sure.lowest_section"))),
    ))
    wide = people.select("*", score.alias("score"), coverage.alias("coverage"), sure.alias("sure"))
    return wide.select(
        key, "score", level(F.col("score"), QUALITY, "insufficient").alias("level"), F.round("coverage", 4).alias("coverage"),
        F.round("sure.average", 4).alias("average"), "sure.lowest_section", F.round("sure.lowest_value", 4).alias("lowest_value"),
        lacking({"name": name, "contact_info": contact, "work_or_education_history": history}).alias("missing_critical"),
        lacking({"skills": has["skills"], "languages": has["languages"], "location": city}).alias("missing_optional"), issues.alias("issues"),
    )


def warning(test: Column, category: str, severity: str, message, field, section, original=None, suggested=None, fixed: bool = False) -> Column:
    """A warning struct where the test holds, else null."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    values = (category, severity, message, field, section, original, suggested, fixed)
    return F.when(F.coalesce(test, F.lit(False)), F.struct(*map(as_column, values)).cast(WARNING))


def contact_warnings(check: Column, field: str, original: Column) -> Column:
    """Warnings of an e-mail check: one for each of its warnings, with the suggestion of the same place."""
    pair = F.arrays_zip(check["warnings"].alias("w"), check["suggestions"].alias("s"))
    return F.transform(pair, lambda p: warning(F.lit(True), "contact_issue", "warning", F.concat(F.lit(f"{field}: "), p["w"]), field, "personal", original, p["s"]))


def quality_warnings(people: DataFrame, key: str) -> DataFrame:
    """One row per warning: key and the fields of WARNING.

    people: first, last, email, phone, city; email_check and phone_check; education and
    jobs (title, start, end: strings of ISO dates); detected (kind, field, section,
    original, suggested: found while reading); unmatched (name of a vocabulary, count).
    """
    name, city = R.filled(F.col("first")) & R.filled(F.col("last")), R.filled(F.col("city"))
    contact, history = R.filled(F.col("email")) | R.filled(F.col("phone")), R.some(F.col("education")) | R.some(F.col("jobs"))
    single = F.array_compact(F.array(
        warning(~name, "missing_critical", "error", "name (first or last) is missing", "name", "personal"),
        warning(~contact, "missing_critical", "error", "no contact information", "contact", "personal"),
        warning(~city, "missing_optional", "info", "location not specified", "city", "personal"),
        warning(~history, "missing_optional", "warning", "no education or work experience", "history", "general"),
        warning(~F.col("phone_check.valid"), "contact_issue", "warning", F.concat(F.lit("phone: "), F.col("phone_check.warning")), "phone", "personal", F.col("phone")),
    ))
    span = lambda a, b: F.concat_ws(" - ", a, b)
    reversed_dates = lambda items, section: F.array_compact(F.transform(items, lambda x: warning(
        x["start"] > x["end"], "date_error", "warning", F.concat(F.lit("dates exchanged: "), F.coalesce(x["title"], F.lit(""))),
        "date_range", section, span(x["start"], x["end"]), span(x["end"], x["start"]), True,
    )))
    is_scan = lambda x: F.coalesce(x["kind"] == "ocr_artifact", F.lit(False))
    found = F.transform("detected", lambda x: F.coalesce(
        warning(is_scan(x), "ocr_artifact", "info", F.concat(F.lit("possible reading error in "), x["field"]), x["field"], x["section"], x["original"], x["suggested"]),
        warning(F.lit(True), "spelling_suspect", "info", F.concat(F.lit("possible spelling error: "), x["original"]), x["field"], x["section"], x["original"], x["suggested"]),
    ))
    unknown = F.transform("unmatched", lambda x: warning(
        F.lit(True), "taxonomy_mismatch", "info", F.concat(x["count"].cast("string"), F.lit(" not in the vocabulary of "), x["name"]), x["name"], "taxonomy"
    ))
    groups = [single, contact_warnings(F.col("email_check"), "email", F.col("email")), reversed_dates(F.col("education"), "education"), reversed_dates(F.col("jobs"), "jobs"), found, unknown]
    empty = F.array().cast(f"array<{WARNING}>")
    every = F.concat(*[F.coalesce(g, empty) for g in groups])
    return people.select(key, F.inline(every))
