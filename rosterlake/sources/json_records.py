"""JSON texts as typed records with defaults and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.functions.nested import json_in_text, repaired
from rosterlake.functions.records import enum, iso_date

PERSON = """personal struct<first:string,last:string,email:string,phone:string,city:string>,
  jobs array<struct<title:string,company:string,start:string,end:string,is_current:boolean,kind:string>>,
  skills array<struct<name:string,level:string>>, languages array<struct<name:string,level:string>>"""
REQUIREMENT = """detected_language string, roles array<string>, role_priority string, min_experience_years double, max_experience_years double,
  experience_priority string, software array<string>, software_priority string, certifications array<string>, certifications_priority string,
  skills array<string>, skills_priority string, languages array<struct<language_code:string,language_name:string,min_level:string,is_required:boolean>>,
  locations array<string>, remote_acceptable boolean, education_level string, education_fields array<string>"""
DEFAULTS = {
    "detected_language": "en", "role_priority": "must", "experience_priority": "should", "software_priority": "should",
    "certifications_priority": "nice", "skills_priority": "should", "remote_acceptable": True,
}
EVIDENCE = "criterion:string,candidate_value:string,source:string,confidence:string"
GAP = "criterion:string,gap_description:string,severity:string,mitigation:string"
REPORT = f"""analysis_language string, query_outcome struct<direct_matches:int,total_matches:int,relaxation_applied:boolean,zero_results_reason:string>,
  ranked_candidates array<struct<rank:int,candidate_id:string,candidate_name:string,overall_suitability:string,match_percentage:double,
    strengths:array<struct<{EVIDENCE}>>,gaps:array<struct<{GAP}>>,risks:array<string>>>,
  hr_recommendation struct<top_candidates:array<string>,recommendation_summary:string>"""
KINDS = ["full_time", "part_time", "contract", "internship", "freelance"]


def parsed(text: Column, schema: str) -> Column:
    """The record in a noisy text by schema; what fits nowhere is null."""
    clean = F.coalesce(json_in_text(text), json_in_text(repaired(text)))
    return F.from_json(clean, schema)


def with_defaults(record: Column, schema: str, defaults: dict) -> list[Column]:
    """The fields of a record, each with its default; arrays become empty ones."""
    from pyspark.sql.types import ArrayType, StructType

    out = []
    for field in StructType.fromDDL(schema).fields:
        value = record[field.name]
        if isinstance(field.dataType, ArrayType):
            value = F.coalesce(value, F.array().cast(field.dataType))
        elif field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        out.append(value.alias(field.name))
    return out


def requirements(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and the fields of REQUIREMENT; a language without a word on it is required."""
    made = rows.select(key, parsed(F.col(text), REQUIREMENT).alias("r")).select(key, *with_defaults(F.col("r"), REQUIREMENT, DEFAULTS))
    must = lambda x: x.withField("is_required", F.coalesce(x["is_required"], F.lit(True)))
    return made.withColumn("languages", F.transform("languages", must))


def reports(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row per ranked candidate of a report: key, rank, candidate_id, candidate_name, suitability, percent, strengths, gaps, risks."""
    made = rows.select(key, F.inline(parsed(F.col(text), REPORT)["ranked_candidates"]))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    strengths = F.transform("strengths", lambda s: s.withField("confidence", F.coalesce(s["confidence"], F.lit("Confirmed"))))
    gaps = F.transform("gaps", lambda g: g.withField("severity", F.coalesce(g["severity"], F.lit("Moderate"))))
    return made.select(
        key, F.coalesce("rank", F.lit(0)).alias("rank"), blank("candidate_id").alias("candidate_id"), blank("candidate_name").alias("candidate_name"),
        F.coalesce("overall_suitability", F.lit("Medium")).alias("suitability"), F.coalesce("match_percentage", F.lit(0.0)).alias("percent"),
        F.coalesce(strengths, F.array().cast(f"array<struct<{EVIDENCE}>>")).alias("strengths"), F.coalesce(gaps, F.array().cast(f"array<struct<{GAP}>>")).alias("gaps"),
        F.coalesce("risks", F.array().cast("array<string>")).alias("risks"),
    )


def people(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, the sections of PERSON, and warnings: dates and kinds of work that cannot be read become null and other.

    A job without a title is left out.
    """
    record = parsed(F.col(text), PERSON).alias("r")
    none = lambda kind: F.array().cast(kind)
    held = F.coalesce(F.filter("r.jobs", lambda j: F.coalesce(j["title"] != "", F.lit(False))), none("array<struct<title:string,company:string,start:string,end:string,is_current:boolean,kind:string>>"))
    read = F.transform(held, lambda j: F.struct(
        j["title"].alias("title"), j["company"].alias("company"), iso_date(j["start"]).alias("start"), iso_date(j["end"]).alias("end"),
        F.coalesce(j["is_current"], F.lit(False)).alias("is_current"), enum(j["kind"], KINDS, "other").alias("kind"),
    ))
    made = rows.select(key, record).select(key, "r.personal", "r.skills", "r.languages", read.alias("read"))
    bad = lambda j, what: F.concat(F.lit(f"bad {what}: "), j["title"])
    notes = F.transform("read", lambda j: F.array_compact(F.array(
        F.when(j["start"]["bad"], bad(j, "start")), F.when(j["end"]["bad"], bad(j, "end")), F.when(j["kind"]["bad"], bad(j, "kind"))
    )))
    jobs = F.transform("read", lambda j: F.struct(
        j["title"].alias("title"), j["company"].alias("company"), j["start"]["day"].alias("start"), j["end"]["day"].alias("end"),
        j["is_current"].alias("is_current"), j["kind"]["value"].alias("kind"),
    ))
    return made.select(
        key, "personal", jobs.alias("jobs"), F.coalesce("skills", none("array<struct<name:string,level:string>>")).alias("skills"),
        F.coalesce("languages", none("array<struct<name:string,level:string>>")).alias("languages"), F.flatten(notes).alias("warnings"),
    )
