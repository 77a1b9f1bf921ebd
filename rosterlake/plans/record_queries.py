"""Queries on nested records: customers as people, orders as their jobs, part types as skills."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from rosterlake.functions import contact, records as R, synonyms, temporal
from rosterlake.operators import aliases, audit, filters, matching, readings, training, writing
from rosterlake.plans.queries import HELD, held_parts, query
from rosterlake.sources import files, json_records


def people(t):
    """key, name, jobs (title, company, months, is_current: by date), skills (name: sorted)."""
    jobs = t("orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("company"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("months"), (F.col("o_orderstatus") == "O").alias("is_current"),
    )
    skills = held_parts(t).select(F.col("o_custkey").alias("c_custkey"), F.col("p_type").alias("name")).distinct()
    base = t("customer").select("c_custkey", F.col("c_name").alias("name"))
    return files.nest(base, "c_custkey", {"jobs": (jobs, ["o_orderdate", "o_orderkey"]), "skills": (skills, ["name"])})


JOBS = """j AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) titles, list(o_orderpriority || ' at ' || o_orderstatus ORDER BY o_orderdate, o_orderkey) spans,
  list(o_orderpriority ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'O') open_titles, sum(floor(o_totalprice / 1000))::BIGINT AS months, count(*) n FROM orders GROUP BY 1)"""
SKILLS = f"k AS (SELECT o_custkey, list(DISTINCT p_type ORDER BY p_type) types FROM {HELD} GROUP BY 1)"
JOINED = "FROM customer LEFT JOIN j ON j.o_custkey = c_custkey LEFT JOIN k ON k.o_custkey = c_custkey"


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'r#0000000') AND c_mktsegment = 'BUILDING'""")
def free_text_filter(t):
    return filters.free_text(t("customer"), ["c_name", "c_mktsegment"], " R#0000000", {"c_mktsegment": "BUILDING"}).select("c_custkey", "c_name")


MATCHED = "SELECT *, row_number() OVER (ORDER BY score DESC, c_custkey) AS rank FROM (SELECT c_custkey, round(greatest(c_acctbal, 0) / 10000, 4) AS score FROM customer) WHERE round(score * 100, 1) >= 50 ORDER BY rank LIMIT 20"


def scored(t):
    return t("customer").select("c_custkey", F.round(F.greatest("c_acctbal", F.lit(0.0)) / 10000, 4).alias("score"))


@query(f"""SELECT c_custkey, rank, round(score * 100, 1) AS percent, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN rank <= 5 OR score >= 0.7 OR round(score * 100, 1) >= 70 THEN 'interview' ELSE 'consider' END AS recommendation FROM ({MATCHED})""")
def match_report(t):
    return matching.report(scored(t), "c_custkey", 20, 50.0)


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE score >= 0.7) AS high, count(*) FILTER (WHERE score >= 0.4 AND score < 0.7) AS medium, least(count(*) FILTER (WHERE score >= 0.7), 3) AS to_interview FROM ({MATCHED})""")
def match_summary(t):
    return matching.summary(matching.report(scored(t), "c_custkey", 20, 50.0))


@query("""SELECT c_custkey, split_part(c_name, '#', 1) AS first, split_part(c_name, '#', 2) AS last, coalesce(roles, '') AS roles FROM customer LEFT JOIN
  (SELECT o_custkey, string_agg(p, '|' ORDER BY f) roles FROM (SELECT o_custkey, o_orderpriority p, min(struct_pack(d := o_orderdate, k := o_orderkey)) f FROM orders GROUP BY 1, 2) GROUP BY 1) ON o_custkey = c_custkey""")
def profile_flat(t):
    name = R.split_name(F.replace("name", F.lit("#"), F.lit(" ")))
    roles = F.array_join(R.distinct_names(F.col("jobs"), "title"), "|")
    return people(t).select("c_custkey", name["first"].alias("first"), name["last"].alias("last"), roles.alias("roles"))


@query("""SELECT c_custkey, coalesce(p, c_mktsegment) AS role, CASE WHEN len(l) > 0 THEN len(l) ELSE 1 END AS n FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderpriority) p, list(o_orderkey) l FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey""")
def coalescing_merge(t):
    rich = t("orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("p"), F.count("*").alias("n"))
    # Of the arrays only the size is asked for: that of the orders, or of the one key in their place.
    role, n = R.merged(F.col("p"), F.col("c_mktsegment")), F.coalesce("n", F.lit(1))
    return t("customer").join(rich, "c_custkey", "left").select("c_custkey", role.alias("role"), n.cast("long").alias("n"))


@query(f"""WITH {JOBS}, {SKILLS} SELECT c_custkey, lower(c_name) AS plain_name, coalesce(months, 0) AS total_months, round(coalesce(months, 0) / 12, 4) AS total_years, open_titles[1] AS current_title,
  coalesce(array_to_string(types, ','), '') AS skills, c_name[1:5] AS text {JOINED}""")
def search_documents(t):
    made = R.search_document(F.col("name"), F.col("jobs"), F.col("skills"), F.col("name"), 5)
    return people(t).select("c_custkey", made.alias("d")).select(
        "c_custkey", "d.plain_name", "d.total_months", F.round("d.total_years", 4).alias("total_years"), "d.current_title", F.array_join("d.skills", ",").alias("skills"), "d.text"
    )


@query(f"""WITH {JOBS}, {SKILLS} SELECT c_custkey, concat_ws(' | ', c_name, 'Skills: ' || array_to_string(types[1:3], ', '), array_to_string(spans[1:5], ' | ')) AS summary {JOINED}""")
def summary_texts(t):
    spans = F.transform("jobs", lambda j: F.concat_ws(" at ", j["title"], j["company"]))
    text = R.summary_text(F.col("name"), [("Skills: ", R.names(F.col("skills"), "name"), 3, ", "), ("", spans, 5, " | ")])
    return people(t).select("c_custkey", text.alias("summary"))


@query(f"""WITH {JOBS}, {SKILLS} SELECT c_custkey, c_name AS name, coalesce(titles[1], 'Unknown Role') AS role, coalesce(n, 0) AS n_jobs, coalesce(len(types), 0) AS n_skills {JOINED}""")
def list_rows(t):
    row = people(t).select("c_custkey", R.list_row(F.col("name"), F.col("jobs"), F.col("skills")).alias("r"))
    return row.select("c_custkey", "r.name", "r.role", F.col("r.n_jobs").cast("long").alias("n_jobs"), F.col("r.n_skills").cast("long").alias("n_skills"))


@query(f"""WITH {JOBS}, {SKILLS} SELECT c_custkey, round(least(1.0, 0.10 + CASE WHEN c_acctbal > 0 THEN 0.10 ELSE 0 END + least(coalesce(n, 0) * 0.10, 0.30) + least(coalesce(len(types), 0) * 0.03, 0.15)), 4)::DOUBLE AS score,
  round(0.7 * (1 + (coalesce(n, 0) > 0)::INT + (c_acctbal > 0)::INT) / 3 + 0.3 * (coalesce(len(types), 0) > 0)::INT / 2, 4)::DOUBLE AS audit {JOINED}""")
def record_scores(t):
    rows = people(t).join(t("customer").select("c_custkey", "c_acctbal"), "c_custkey")
    email, jobs, skills, none = F.when(F.col("c_acctbal") > 0, F.col("name")), R.size(F.col("jobs")), R.size(F.col("skills")), F.lit(None).cast("string")
    score = R.section_completeness(F.col("name"), F.col("name"), email, F.col("name"), none, F.lit(0), jobs, skills, F.lit(0))
    check = R.audit_score([R.filled(F.col("name")), jobs > 0, R.filled(email)], [skills > 0, R.filled(none)])
    return rows.select("c_custkey", score.alias("score"), check.alias("audit"))


@query("""SELECT event_id, c_name, event_type, value FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'error' ORDER BY ts DESC""")
def unmatched_detail(t):
    errors = t("events").where("event_type = 'error'").join(t("customer"), F.col("user_id") == F.col("c_custkey"))
    return errors.orderBy(F.desc("ts"), "event_id").select("event_id", "c_name", "event_type", "value")


@query("""SELECT p_brand, string_agg(v, ',' ORDER BY v) AS terms FROM (SELECT p_brand, p_name v FROM part UNION SELECT p_brand, p_type FROM part) GROUP BY 1""")
def category_terms(t):
    made = aliases.expanded(t("part").withColumn("variants", F.array("p_type")), "p_name", "variants", "p_brand")
    return made.select("p_brand", F.array_join("terms", ",").alias("terms"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE value > 100) AS fixed FROM events GROUP BY 1""")
def warning_tally(t):
    by = [F.count_if(F.col("event_type") == s).alias(s) for s in ("error", "view")]
    return t("events").groupBy("user_id").agg(*by, F.count_if(F.col("value") > 100).alias("fixed"))


@query("""WITH s AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view' AND value <> 0) a, avg(value) FILTER (WHERE event_type = 'click' AND value <> 0) b FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 9) AS average, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NULL OR a <= b THEN 'view' ELSE 'click' END AS lowest_section, round(least(a, b), 9) AS lowest_value FROM s""")
def section_confidence(t):
    mean = lambda kind: F.avg(F.when((F.col("event_type") == kind) & (F.col("value") != 0), F.col("value"))).alias(kind)
    means = t("events").groupBy("user_id").agg(mean("view"), mean("click"))
    made = means.select("user_id", R.confidence({k: F.col(k) for k in ("view", "click")}).alias("c"))
    return made.select("user_id", F.round("c.average", 9).alias("average"), "c.lowest_section", F.round("c.lowest_value", 9).alias("lowest_value"))


@query("""SELECT count(*) AS total, count(value) AS filled, count(*) - count(value) AS missing, round(avg(value), 1) AS mean, count(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS numbers FROM events""")
def fill_stats(t):
    number = F.get_json_object("props", "$.k").try_cast("double")
    return t("events").agg(F.count("*").alias("total"), F.count("value").alias("filled"), F.count_if(F.col("value").isNull()).alias("missing"), F.round(F.avg("value"), 1).alias("mean"), F.count(number).alias("numbers"))


@query("""SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders""")
def order_shares(t):
    return readings.shares(t("orders"), "o_custkey", "o_totalprice").select("o_orderkey", F.round("share", 6).alias("share"))


WORDS = ["Άριστο", "Βασικό", "expert user", "Native", "b2", "Αγγλικά", "MSc", "ΤΕΙ"]


@query("""SELECT o_orderkey, ['expert', 'beginner', 'expert', NULL, NULL, NULL, NULL, NULL][w + 1] AS skill, ['C2', 'A2', 'unknown', 'native', 'B2', 'unknown', 'unknown', 'unknown'][w + 1] AS level,
  ['άρ', 'βα', 'ex', 'na', 'b2', 'en', 'ms', 'τε'][w + 1] AS code, ['άριστο', 'βασικό', 'expert user', 'native', 'b2', 'en', 'msc', 'τει'][w + 1] AS search_code,
  ['άριστο', 'βασικό', 'expert user', 'native', 'b2', 'αγγλικά', 'master', 'tei,bachelor'][w + 1] AS degrees FROM (SELECT o_orderkey, o_orderkey % 8 w FROM orders)""")
def synonym_codes(t):
    word = F.get(F.array(*map(F.lit, WORDS)), F.col("o_orderkey") % 8)
    return t("orders").select(
        "o_orderkey", synonyms.skill_level(word).alias("skill"), synonyms.language_level(word).alias("level"), synonyms.language_code(word).alias("code"),
        synonyms.search_language(word).alias("search_code"), F.array_join(synonyms.degrees(word), ",").alias("degrees"),
    )


@query("""WITH c AS (SELECT c_custkey, lower(replace(c_name, '#', '.')) AS n, c_nationkey % 5 AS d FROM customer)
SELECT c_custkey, n || ['@gmail.com', '@gmial.com', '@yahoo.com', '@hotmail.gr', '@example.org'][d + 1] AS email, d NOT IN (1, 3) AS valid,
  CASE WHEN regexp_matches(n, '000|111|222|333|444|555|666|777|888|999') THEN 1 ELSE 0 END + (d IN (1, 3))::INT AS n_warnings, CASE d WHEN 1 THEN n || '@gmail.com' WHEN 3 THEN n || '@hotmail.com' END AS last_suggestion FROM c""")
def email_report(t):
    ends = F.array(*map(F.lit, ["@gmailcom", "@gmial.com", "@yahoocom", "@hotmail.gr", "@example.org"]))
    raw = F.concat(F.lit(" "), F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.get(ends, F.col("c_nationkey") % 5))
    rows = t("customer").select("c_custkey", contact.repaired_email(raw).alias("email"))
    check = F.col("email_check")
    last = F.when(~check["valid"], F.try_element_at(check["suggestions"], F.lit(-1)))
    return contact.email_checks(rows, "email").select("c_custkey", "email", check["valid"].alias("valid"), F.size(check["warnings"]).alias("n_warnings"), last.alias("last_suggestion"))


@query("""SELECT p_partkey, p_type AS role, coalesce(p_size > 25, true) AS must, 'nice' AS priority, 0 AS n_skills, p_retailprice AS years FROM part""")
def json_requirements(t):
    language = F.struct(F.lit("en").alias("language_code"), (F.col("p_size") > 25).alias("is_required"))
    given = F.to_json(F.struct(F.array("p_type").alias("roles"), F.array(language).alias("languages"), F.col("p_retailprice").alias("min_experience_years")))
    rows = t("part").select("p_partkey", F.concat(F.lit("Answer:\n```json\n"), given, F.lit("\n```")).alias("text"))
    made = json_records.requirements(rows, "p_partkey", "text")
    return made.select(
        "p_partkey", F.get("roles", F.lit(0)).alias("role"), F.get("languages", F.lit(0))["is_required"].alias("must"), F.col("certifications_priority").alias("priority"),
        F.size("skills").alias("n_skills"), F.col("min_experience_years").alias("years"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate::DATE END AS start, CASE WHEN o_orderstatus = 'O' THEN 'contract' ELSE 'other' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'bad start: ' || o_orderpriority || ',bad kind: ' || o_orderpriority WHEN 'O' THEN '' ELSE 'bad kind: ' || o_orderpriority END AS warnings FROM orders""")
def json_people(t):
    start = F.when(F.col("o_orderstatus") == "F", "1999-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    job = F.struct(F.col("o_orderpriority").alias("title"), start.alias("start"), F.when(F.col("o_orderstatus") == "O", "Contract").otherwise("Odd").alias("kind"))
    made = json_records.people(t("orders").select("o_orderkey", F.to_json(F.struct(F.array(job).alias("jobs"))).alias("text")), "o_orderkey", "text")
    first = F.get("jobs", F.lit(0))
    return made.select("o_orderkey", first["start"].alias("start"), first["kind"].alias("kind"), F.array_join("warnings", ",").alias("warnings"))


#: Part keys to one report text.
REPORT_KEYS = 1000


def report_texts(parts):
    """p_brand, page, text: a brand's parts by key as ranked candidates, ranks running on from page to page.

    A page holds the keys of one range of REPORT_KEYS; only the pages' sizes meet in one place a brand.
    """
    paged = parts.withColumn("page", F.floor(F.col("p_partkey") / REPORT_KEYS))
    before = F.sum("n").over(Window.partitionBy("p_brand").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    item = F.struct("p_partkey", F.struct(F.col("p_partkey").cast("string").alias("candidate_id"), F.array(F.struct(F.col("p_type").alias("criterion"))).alias("gaps")).alias("c"))
    ordered = paged.groupBy("p_brand", "page").agg(F.sort_array(F.collect_list(item)).alias("items"))
    sizes = paged.groupBy("p_brand", "page").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col("p_brand").alias("brand"), F.col("page").alias("at"), F.coalesce(before, F.lit(0)).alias("start"))
    placed = ordered.join(starts, F.col("p_brand").eqNullSafe(F.col("brand")) & F.col("page").eqNullSafe(F.col("at")))
    numbered = F.transform("items", lambda x, i: x["c"].withField("rank", (F.col("start") + i + 1).cast("int")))
    return placed.select("p_brand", "page", F.to_json(F.struct(numbered.alias("ranked_candidates"))).alias("text"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, 'Medium' AS suitability, 'Moderate' AS severity, p_type AS criterion FROM part""")
def json_reports(t):
    made = json_records.reports(report_texts(t("part")), "p_brand", "text")
    gap = F.get("gaps", F.lit(0))
    return made.select(F.col("candidate_id").cast("long").alias("p_partkey"), "rank", "suitability", gap["severity"].alias("severity"), gap["criterion"].alias("criterion"))


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(b.segment, a.segment) AS segment, CASE WHEN b.c_custkey IS NULL THEN a.best ELSE greatest(a.best, b.best) END AS best, CASE WHEN b.c_custkey IS NULL THEN a.n ELSE coalesce(a.n, 0) + coalesce(b.n, 0) END AS n
FROM (SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS best, 1::BIGINT AS n FROM customer WHERE c_acctbal > 0) a
FULL JOIN (SELECT o_custkey AS c_custkey, min(o_orderpriority) AS segment, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY 1) b ON a.c_custkey = b.c_custkey""")
def state_upsert(t):
    old = t("customer").where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("best"), F.lit(1).cast("long").alias("n"))
    new = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("segment"), F.max("o_totalprice").alias("best"), F.count("*").alias("n"))
    return writing.upsert(old, new, ["c_custkey"], {"segment": "fill", "best": "greatest", "n": "add"})


@query("""SELECT o_custkey AS c_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place, o_orderpriority AS title, floor(o_totalprice / 1000)::INT AS months FROM orders JOIN customer ON o_custkey = c_custkey""")
def fan_out(t):
    jobs = {"title": F.col("item.title"), "months": F.col("item.months")}
    return writing.fan_out(people(t), "c_custkey", {"name": F.col("name")}, {"jobs": jobs})["jobs"]


@query("""SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def child_replace(t):
    rows = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    new = rows.where("o_orderstatus = 'O'")
    return writing.replace_children(rows, new, new, "c_custkey").select("c_custkey", "o_orderkey")


@query(f"""WITH {JOBS}, {SKILLS}, s AS (SELECT c_custkey, c_acctbal > 0 AS mail, coalesce(n, 0) > 0 AS hist, coalesce(len(types), 0) > 0 AS sk, coalesce(len(list_filter(types, lambda x: x < 'M')), 0) / nullif(len(types), 0) AS cov {JOINED})
SELECT c_custkey, round(0.7 * (1 + mail::INT + hist::INT) / 3 + 0.3 * sk::INT / 5, 4)::DOUBLE AS score, round(coalesce(cov, 1), 4)::DOUBLE AS coverage,
  concat_ws(',', CASE WHEN NOT mail THEN 'contact_info' END, CASE WHEN NOT hist THEN 'work_or_education_history' END) AS missing_critical,
  concat_ws(',', CASE WHEN sk AND coalesce(cov, 1) < 0.5 THEN 'low_taxonomy_coverage' END, CASE WHEN hist AND c_custkey % 2 = 0 THEN 'low_confidence_jobs' END) AS issues FROM s""")
def completeness_audit(t):
    matched = lambda x: F.when(x["name"] < "M", x["name"])
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    sure = F.when(F.col("c_custkey") % 2 == 0, 0.5).otherwise(0.9)
    rows = people(t).join(t("customer").select("c_custkey", "c_acctbal"), "c_custkey").select(
        "c_custkey", F.col("name").alias("first"), F.col("name").alias("last"), F.when(F.col("c_acctbal") > 0, F.col("name")).alias("email"), F.lit("").alias("phone"), F.lit("").alias("city"),
        F.lit(0.95).alias("personal"), none("confidence:double").alias("education"), F.transform("jobs", lambda j: F.struct(sure.alias("confidence"))).alias("jobs"),
        F.transform("skills", lambda x: F.struct(matched(x).alias("matched_id"), F.lit(0.9).alias("confidence"))).alias("skills"), none("name:string").alias("languages"),
        none("matched_id:string").alias("certificates"), none("matched_id:string").alias("software"),
    )
    made = audit.audit(rows, "c_custkey")
    return made.select("c_custkey", "score", "coverage", F.array_join("missing_critical", ",").alias("missing_critical"), F.array_join("issues", ",").alias("issues"))


@query("""SELECT category, severity, count(*) AS n, count(*) FILTER (WHERE fixed) AS n_fixed FROM (
  SELECT 'missing_critical' AS category, 'error' AS severity, false AS fixed FROM customer WHERE c_acctbal <= 0 UNION ALL
  SELECT 'missing_optional', 'info', false FROM customer UNION ALL
  SELECT 'missing_optional', 'warning', false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
  SELECT 'contact_issue', 'warning', false FROM customer WHERE c_acctbal > 0 AND c_nationkey = 1 UNION ALL
  SELECT 'date_error', 'warning', true FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' UNION ALL
  SELECT 'taxonomy_mismatch', 'info', false FROM customer) GROUP BY 1, 2""")
def quality_warnings(t):
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    late = F.lit("2030-01-01")
    jobs = F.transform("jobs", lambda j: F.struct(j["title"].alias("title"), F.date_format(j["o_orderdate"], "yyyy-MM-dd").alias("end"), F.when(j["company"] == "F", late).alias("start")))
    mail = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("a"), F.col("c_custkey") % 10, F.when(F.col("c_nationkey") == 1, "@gmial.com").otherwise("@gmail.com")))
    rows = people(t).join(t("customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey").select(
        "c_custkey", F.col("name").alias("first"), F.col("name").alias("last"), mail.alias("email"), F.lit(None).cast("string").alias("phone"), F.lit("").alias("city"),
        none("title:string,start:string,end:string").alias("education"), jobs.alias("jobs"), none("kind:string,field:string,section:string,original:string,suggested:string").alias("detected"),
        F.array(F.struct(F.lit("skill").alias("name"), F.lit(2).alias("count"))).alias("unmatched"),
    )
    found = audit.quality_warnings(contact.contact_checks(rows, ["email"], ["phone"]), "c_custkey")
    return found.groupBy("category", "severity").agg(F.count("*").alias("n"), F.count_if("fixed").alias("n_fixed"))


@query("""SELECT p_partkey, p_name, CASE WHEN p_size < 10 THEN p_size END AS hours, CASE WHEN p_size >= 10 THEN 'professional_body' ELSE 'other' END AS provider_type FROM part WHERE p_size < 10 OR p_size > 40""")
def course_split(t):
    name = F.when(F.col("p_size") < 10, F.concat("p_name", F.lit(" "), "p_size", F.lit(" ωρών"))).otherwise(F.col("p_name"))
    rows = t("part").select("p_partkey", "p_name", name.alias("title"), F.when(F.col("p_size") > 40, "Οικονομικό Επιμελητήριο").otherwise(F.col("p_brand")).alias("issuer"))
    return training.split_courses(rows, "title", "issuer")[1].select("p_partkey", "p_name", "hours", "provider_type")


@query("""WITH a AS (SELECT lower(p_name) term, p_brand AS key, 'parts' AS source, 'name' AS kind, 0 o FROM part UNION ALL SELECT lower(p_type), p_brand, 'parts', 'alias', 1 FROM part UNION ALL SELECT lower(n_name), 'R' || n_regionkey, 'nations', 'name', 2 FROM nation)
SELECT term, key, source, kind, (CASE kind WHEN 'name' THEN 1.0 ELSE 0.95 END)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY o DESC, key DESC) r FROM a) WHERE r = 1""")
def alias_table(t):
    parts = t("part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.array("p_type").alias("other"))
    nations = t("nation").select(F.concat(F.lit("R"), "n_regionkey").alias("id"), F.col("n_name").alias("name"))
    return aliases.alias_table({"parts": parts, "nations": nations}, "id", {"name": "name", "other": "alias"})


@query("""SELECT p_partkey, p_size AS years, string_agg(v, ',' ORDER BY v) AS types, lower(p_name) AS names, 0.6::DOUBLE AS confidence, 'structured' AS kind
FROM part JOIN (SELECT DISTINCT lower(p_type) v FROM part) ON v = lower(p_type) OR contains(' ' || lower(p_name) || ' ', ' ' || v || ' ') GROUP BY 1, 2, 4""")
def text_tags(t):
    part = t("part")
    known = aliases.alias_table({"types": part.select(F.lower("p_type").alias("id"), F.col("p_type").alias("name")), "names": part.select(F.lower("p_name").alias("id"), F.col("p_name").alias("name"))}, "id", {"name": "name"})
    body = F.concat(F.lit("We look for "), "p_name", F.lit(", "), "p_type", F.lit("; "), "p_size", F.lit("+ years"))
    made = aliases.tag(part.select("p_partkey", body.alias("body")), "p_partkey", "body", known)
    of = lambda s: F.array_join(F.try_element_at("ids", F.lit(s)), ",").alias(s)
    return made.select("p_partkey", "years", of("types"), of("names"), "confidence", "kind")


@query("""SELECT p_partkey, token, min(w) AS weight FROM (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) token, 'A' w FROM part UNION ALL SELECT p_partkey, unnest(string_split_regex(lower(p_brand), '[^a-z0-9]+')), 'B' FROM part) WHERE token <> '' GROUP BY 1, 2""")
def weighted_tokens(t):
    return aliases.weighted_tokens(t("part"), "p_partkey", {"p_name": "A", "p_brand": "B"})


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND x NOT IN ('and', 'of', 'in')) AS l FROM conversations)
SELECT conv_id, turn, len(l) AS n_tokens, md5(array_to_string(l, ' ')) AS digest FROM w""")
def index_tokens(t):
    made = t("conversations").select("conv_id", "turn", aliases.analysed(F.col("text"), ["and", "of", "in"]).alias("l"))
    return made.select("conv_id", "turn", F.size("l").cast("long").alias("n_tokens"), F.md5(F.array_join("l", " ")).alias("digest"))


@query("""SELECT c_custkey, replace(c_name, '#', '-') AS text, 0.95::DOUBLE AS confidence, 0.9444::DOUBLE AS agreement, false AS arbitrate FROM customer""")
def reading_fusion(t):
    a = t("customer").select("c_custkey", F.lit("a").alias("engine"), F.col("c_name").alias("text"), F.lit(0.7).alias("confidence"))
    b = t("customer").select("c_custkey", F.lit("b").alias("engine"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("text"), F.lit(0.8).alias("confidence"))
    return readings.fuse_readings(a.union(b), "c_custkey")[0]


@query("""SELECT p_name, min(r) AS gives FROM (SELECT DISTINCT p_name FROM part) JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) r FROM part) ON contains(p_name, r) GROUP BY 1""")
def implied_skills(t):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    rules = t("part").select(first.alias("rule")).distinct().select("rule", F.array().cast("array<string>").alias("variants"), F.col("rule").alias("gives"))
    return aliases.implied(t("part"), "p_name", rules, "rule", "variants", "gives")


@query(f"""SELECT c_custkey, EXISTS (SELECT 1 FROM {HELD} WHERE o_custkey = c_custkey AND p_type IN ('PROMO', 'ECONOMY')) AS in_category FROM customer""")
def category_member(t):
    wanted = F.array(F.lit("promo"), F.lit("economy"))
    return people(t).select("c_custkey", aliases.in_category(R.names(F.col("skills"), "name"), wanted).alias("in_category"))


@query("""SELECT o_orderkey, c_name, round(o_totalprice / 12, 1) AS yearly FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20""")
def longest(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "c_name", F.round(F.col("o_totalprice") / 12, 1).alias("yearly"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS severity_rank FROM events ORDER BY 2, ts DESC, event_id LIMIT 50""")
def severity_page(t):
    rank = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return t("events").withColumn("severity_rank", rank).orderBy("severity_rank", F.desc("ts"), "event_id").limit(50).select("event_id", "severity_rank")


@query("""SELECT o_orderkey, least(a, b) AS start, greatest(a, b) AS "end", a > b AS swapped, greatest(datesub('month', least(a, b), greatest(a, b)), 1)::INT AS months, b >= DATE '2000-01-01' - INTERVAL 30 DAY AND b <= DATE '2000-01-01' AS recent
FROM (SELECT o_orderkey, o_orderdate::DATE a, max(l_shipdate)::DATE - 60 b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
def date_pairs(t):
    shipped = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.date_sub(F.to_date(F.max("l_shipdate")), 60).alias("b"))
    rows = t("orders").join(shipped, "o_orderkey").select("o_orderkey", F.to_date("o_orderdate").alias("a"), "b")
    as_of = F.lit("2000-01-01").cast("date")
    months = temporal.duration_months(F.col("a"), F.col("b"), F.lit(False), as_of)
    made = rows.select("o_orderkey", R.swapped(F.col("a"), F.col("b")).alias("s"), months.alias("months"), F.col("b").between(F.date_sub(as_of, 30), as_of).alias("recent"))
    return made.select("o_orderkey", "s.start", "s.end", "s.swapped", "months", "recent")


@query("""SELECT o_orderkey, greatest(CASE WHEN o_orderstatus = 'F' THEN o_custkey % 3 ELSE greatest(datesub('month', o_orderdate::DATE, DATE '2026-01-15'), 1) END, 1)::INT AS months FROM orders""")
def backfilled_months(t):
    given = F.when(F.col("o_orderstatus") == "F", (F.col("o_custkey") % 3).cast("int"))
    none, as_of = F.lit(None).cast("date"), F.lit("2026-01-15").cast("date")
    return t("orders").select("o_orderkey", temporal.backfilled_months(given, F.to_date("o_orderdate"), none, F.lit(False), as_of).alias("months"))


@query("""SELECT o_custkey AS c_custkey, list_aggregate(list(o_orderkey ORDER BY coalesce(shipped, DATE '2026-01-15') DESC, o_orderdate DESC, o_orderkey DESC), 'string_agg', ',') AS jobs
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate)::DATE AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def job_order(t):
    shipped = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("shipped"))
    rows = t("orders").join(shipped, "o_orderkey", "left")
    keys = F.struct(F.coalesce("shipped", F.lit("2026-01-15").cast("date")).alias("until"), "o_orderdate", "o_orderkey")
    listed = rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(keys), asc=False).alias("k"))
    return listed.select("c_custkey", F.array_join(F.transform("k", lambda x: x["o_orderkey"].cast("string")), ",").alias("jobs"))


@query("""SELECT * FROM (SELECT 'newest' AS sort, c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100) UNION ALL SELECT * FROM (SELECT 'oldest', c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'name', c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 100) UNION ALL SELECT * FROM (SELECT 'other', c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100)""")
def named_sorts(t):
    sorts = {"newest": F.desc("c_acctbal"), "oldest": F.asc("c_acctbal"), "name": F.asc("c_name")}
    page = lambda s: filters.ordered_page(t("customer"), s, sorts, "newest", "c_custkey", 100).select(F.lit(s).alias("sort"), "c_custkey")
    return page("newest").union(page("oldest")).union(page("name")).union(page("other"))


@query("""SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'landline too short: 6' WHEN 2 THEN 'mobile too long: 13; repeated digits' ELSE 'non-digit characters' END AS warning FROM customer""")
def phone_report(t):
    tail = F.lpad((F.col("c_custkey") % 90 + 10).cast("string"), 2, "0")
    forms = F.array(F.concat(F.lit("+30 691-23 456"), F.col("c_custkey") % 10, F.lit("8")), F.concat(F.lit("2101"), tail), F.concat(F.lit("69 00000 0000"), tail), F.concat(F.lit("call "), tail))
    rows = t("customer").select("c_custkey", F.get(forms, F.col("c_nationkey") % 4).alias("phone"))
    return contact.contact_checks(rows, [], ["phone"]).select("c_custkey", "phone_check.warning")
