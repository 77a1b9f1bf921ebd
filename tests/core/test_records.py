"""Fixtures for synonyms, contact checks, nested records, audits, aliases, readings and writing."""

import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import contact, nested, records as R, synonyms, temporal, text
from rosterlake.operators import aliases, audit, matching, readings, retrieval, training, writing
from rosterlake.sources import files, json_records


def values(spark, data, *columns):
    """Results of columns over one string column c."""
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, c string")
    return [tuple(r)[1:] for r in frame.select("i", *columns).orderBy("i").collect()]


def test_synonyms(spark):
    c = F.col("c")
    skill = values(spark, ["Άριστο", " Expert ", "very good", "Basic skills", "x", None], synonyms.skill_level(c))
    assert [s for (s,) in skill] == ["expert", "expert", "advanced", "beginner", None, None]
    language = values(spark, ["Πολύ καλή", "b2", "Native speaker", "μητρική", "x", None], synonyms.language_level(c))
    assert [s for (s,) in language] == ["C1", "B2", "native", "native", "unknown", "unknown"]
    codes = values(spark, ["Αγγλικά", "Swahili", "Chinese", None], synonyms.language_code(c), synonyms.search_language(c))
    assert codes == [("en", "en"), ("sw", "swahili"), ("ch", "zh"), (None, None)]
    degree = values(spark, ["Μεταπτυχιακό", "AEI", "Odd", None], synonyms.degrees(c))
    assert [d for (d,) in degree] == [["master"], ["bachelor", "master", "doctorate", "phd"], ["odd"], None]
    assert values(spark, ["Άνοιξη ΰ", None], synonyms.unmarked_greek(c)) == [("Ανοιξη υ",), (None,)]


def test_email_repair_and_names(spark):
    c = F.col("c")
    got = values(spark, [" Μαρια@gmailcom.x\x00", "a@b.gr", "", None, "x@LIVECO"], contact.repaired_email(c))
    assert [g for (g,) in got] == ["Mapia@gmail.com", "a@b.gr", None, None, "x@live.com"]
    raw = ["CV 2024\n Maria  Anna Papa \nx", "one\ntwo 2 three", None, "Άννα Δήμου"]
    named = values(spark, raw, contact.person_name(F.lit(None), F.lit(" "), c))
    assert [tuple(n) for (n,) in named] == [("Maria", "Anna Papa"), ("Unknown", "Unknown"), ("Unknown", "Unknown"), ("Άννα", "Δήμου")]
    assert values(spark, ["x"], contact.person_name(F.lit("A"), F.lit(None), F.lit("B C")))[0][0].asDict() == {"first": "A", "last": "Unknown"}
    nul = chr(92) + "u0000"
    cleaned = values(spark, ['{"a":"x' + nul + 'y"}', '{"a":"' + chr(92) + nul + '"}'], contact.without_nuls(c))
    assert [x for (x,) in cleaned] == ['{"a":"xy"}', '{"a":"' + chr(92) + nul + '"}']


def test_email_checks(spark):
    given = ["a@gmial.com", "a@gmail.com", "nobody", "a b@x..gr", "annna@hotmail.gr", "", None]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(given)], "id int, email string")
    got = {r.id: r.email_check for r in contact.email_checks(rows, "email").collect()}
    assert len(got) == len(given)
    assert not got[0].valid and got[0].suggestions == ["a@gmail.com"]
    assert got[1].valid and got[1].warnings == []
    assert not got[2].valid and got[2].warnings == ["missing @"]
    assert got[3].valid and got[3].warnings == ["spaces", "consecutive dots"] and got[3].suggestions == ["ab@x..gr", "a b@x.gr"]
    assert not got[4].valid and got[4].suggestions == ["anna@hotmail.gr", "annna@hotmail.com"]
    assert got[5].valid and got[6].valid
    both = contact.contact_checks(rows.withColumn("phone", F.lit("6912345678")), ["email"], ["phone"])
    assert both.where("phone_check.valid").count() == len(given)


def test_sequence_ratio_equals_difflib(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("tide", "diet"), ("x", None)]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("r", contact.sequence_ratio("a", "b")).collect()
    for r in rows:
        assert r.r == (None if r.b is None else SequenceMatcher(None, r.a, r.b).ratio())


def test_record_columns(spark):
    schema = "name string, jobs array<struct<title:string,company:string,months:int,is_current:boolean>>, skills array<struct<name:string,name_en:string>>"
    rows = spark.createDataFrame([
        ("Ann Lee May", [("Clerk", "A", 12, False), ("Boss", "B", None, True), ("Clerk", "C", 6, None)], [("", "sql"), ("py", None), (None, None), ("py", "x")]),
        (None, None, None), ("Solo", [], []),
    ], schema).coalesce(1)
    got = rows.select(
        R.split_name(F.col("name")).alias("n"), R.distinct_names(F.col("jobs"), "title").alias("t"), R.names(F.col("skills"), "name", "name_en").alias("s"),
        R.search_document(F.col("name"), F.col("jobs"), F.col("skills"), F.col("name"), 3).alias("d"), R.list_row(F.col("name"), F.col("jobs"), F.col("skills")).alias("l"),
        R.summary_text(F.col("name"), [("Skills: ", R.names(F.col("skills"), "name"), 1, ", "), ("", R.names(F.col("jobs"), "title"), 2, " | ")]).alias("x"),
        R.merged(F.array().cast("array<string>"), F.array(F.lit("o")), True).alias("m"),
    ).collect()
    one, null, empty = got
    assert tuple(one.n) == ("Ann", "Lee May") and one.t == ["Clerk", "Boss"] and one.s == ["sql", "py", "py"]
    assert (one.d.total_months, one.d.total_years, one.d.current_title, one.d.current_company, one.d.text) == (18, 1.5, "Boss", "B", "Ann")
    assert tuple(one.l) == ("Ann Lee May", "Clerk", 3, 4) and one.x == "Ann Lee May | Skills: py | Clerk | Boss" and one.m == ["o"]
    assert tuple(null.n) == ("", "") and null.t == [] and null.d.total_months == 0 and null.l.role == "Unknown Role" and null.x == ""
    assert tuple(empty.n) == ("Solo", "") and empty.x == "Solo" and empty.l.n_jobs == 0


def test_scores_dates_and_steps(spark):
    one = spark.range(1)
    day = lambda s: F.lit(s).cast("date")
    got = one.select(
        R.section_completeness(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(None).cast("string"), F.lit("d"), F.lit(9), F.lit(2), F.lit(1), F.lit(None).cast("int")).alias("c"),
        R.audit_score([F.lit(True), F.lit(False), F.lit(None).cast("boolean")], [F.lit(True)]).alias("a"),
        R.swapped(day("2024-02-01"), day("2024-01-01")).alias("w"), R.swapped(day("2024-02-01"), F.lit(None).cast("date")).alias("o"),
        R.iso_date(F.lit("2024-02-30")).alias("b"), R.iso_date(F.lit("2024-02-29")).alias("g"), R.enum(F.lit("Odd"), ["x"], "y").alias("e"),
        R.progress(F.lit("b"), ["a", "b", "c", "completed"]).alias("p"), R.progress(F.lit("completed"), ["a", "completed"]).alias("q"), R.progress(F.lit("failed"), ["a"] * 2).alias("f"),
        R.suitability(F.lit(9), F.lit("Υψηλή"), F.lit(1)).alias("s"), R.suitability(F.lit(9), F.lit(None).cast("string"), F.lit(69)).alias("z"),
        R.confidence({"x": F.lit(0.5), "y": F.lit(None).cast("double"), "z": F.lit(0.5)}).alias("k"),
        temporal.duration_months(day("2024-03-01"), day("2024-01-01"), F.lit(False), day("2024-06-01")).alias("d"),
    ).first()
    assert got.c == pytest.approx(0.05 + 0.10 + 0.05 + 0.20 + 0.20 + 0.03) and got.a == pytest.approx(0.5333, abs=1e-4)
    assert tuple(got.w) == (datetime.date(2024, 1, 1), datetime.date(2024, 2, 1), True) and tuple(got.o) == (datetime.date(2024, 2, 1), None, False)
    assert tuple(got.b) == (None, True) and tuple(got.g) == (datetime.date(2024, 2, 29), False) and tuple(got.e) == ("y", True)
    assert (got.p, got.q, got.f) == (33, 100, 0) and got.s == "interview" and got.z == "consider" and tuple(got.k) == (0.5, "x", 0.5) and got.d == 2


PEOPLE = """key int, first string, last string, email string, phone string, city string, personal double,
  education array<struct<title:string,start:string,end:string,confidence:double>>, jobs array<struct<title:string,start:string,end:string,confidence:double>>,
  skills array<struct<name:string,matched_id:string,confidence:double>>, languages array<struct<name:string>>,
  certificates array<struct<name:string,matched_id:string>>, software array<struct<name:string,matched_id:string>>,
  detected array<struct<kind:string,field:string,section:string,original:string,suggested:string>>, unmatched array<struct<name:string,count:int>>"""


def test_audit_and_warnings(spark):
    rows = spark.createDataFrame([
        (1, "A", "B", "a@gmial.com", "691", "C", 0.9, [], [("Boss", "2024-02-01", "2024-01-01", 0.5)], [("x", None, 0.8), ("y", None, 0.0), ("z", "id", 0.4)], [("en",)], [], [],
         [("ocr_artifact", "skills", "s", "0", "O"), ("spelling", "jobs", "s", "q", "p")], [("skill", 2)]),
        (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ], PEOPLE)
    one, two = sorted(audit.audit(rows, "key").collect(), key=lambda r: r.key)
    assert one.score == pytest.approx(0.7 + 0.3 * 3 / 5) and one.level == "good" and one.coverage == pytest.approx(0.3333)
    assert (one.lowest_section, one.lowest_value) == ("jobs", 0.5) and one.average == pytest.approx((0.9 + 0.5 + 0.6) / 3, abs=1e-4)
    assert one.missing_critical == [] and one.missing_optional == [] and one.issues == ["low_taxonomy_coverage", "low_confidence_jobs"]
    assert two.score == 0 and two.coverage == 1.0 and two.missing_critical == ["name", "contact_info", "work_or_education_history"] and two.issues == []
    got = audit.quality_warnings(contact.contact_checks(rows, ["email"], ["phone"]), "key").collect()
    first = [(w.category, w.field) for w in got if w.key == 1]
    assert first == [("contact_issue", "phone"), ("contact_issue", "email"), ("date_error", "date_range"), ("ocr_artifact", "skills"), ("spelling_suspect", "jobs"), ("taxonomy_mismatch", "skill")]
    assert [w.suggested for w in got if w.category == "date_error"] == ["2024-01-01 - 2024-02-01"] and [w.fixed for w in got if w.category == "date_error"] == [True]
    assert [(w.category, w.severity) for w in got if w.key == 2] == [("missing_critical", "error")] * 2 + [("missing_optional", "info"), ("missing_optional", "warning")]
    listed = spark.createDataFrame([([("error", True), ("info", None)],)], "w array<struct<severity:string,fixed:boolean>>").select(R.tally(F.col("w"), ["error", "warning"]).alias("t")).first().t
    assert tuple(listed) == (1, 0, 1)


def test_courses(spark):
    rows = spark.createDataFrame([
        (1, "Σεμινάριο φορολογίας 20 ωρών", "X", None), (2, "AWS Architect", "Οικονομικό Επιμελητήριο", None), (3, "AWS Architect", "Amazon", None), (4, None, None, None),
        (5, "Safety basics", "X", "Προφίλ\nΣεμινάρια\nsafety basics 2020\nΓλώσσες\nenglish"), (6, "english test", "X", "Σεμινάρια\nsafety\nγλώσσες\nenglish"),
    ], "id int, name string, issuer string, raw string")
    stay, courses = training.split_courses(rows, "name", "issuer", "raw")
    assert sorted(r.id for r in stay.collect()) == [3, 4, 6]
    got = {r.id: (r.subject, r.hours, r.provider_type) for r in courses.collect()}  # archITect: subjects are parts of words
    assert got == {1: ("accounting", 20, "other"), 2: ("it", None, "professional_body"), 5: ("safety", None, "other")}


def test_aliases_and_tags(spark):
    skills = spark.createDataFrame([("S1", "Structured Query Language", "sql", ["SQL ", "Σκουέλ"]), ("S2", "C++", None, None)], "id string, name string, short string, other array<string>")
    roles = spark.createDataFrame([("R1", "Λογιστής", ["sql"])], "id string, name string, other array<string>")
    table = aliases.alias_table({"skills": skills, "roles": roles}, "id", {"name": "name", "other": "alias", "short": "abbreviation"})
    got = {r.term: (r.key, r.kind, r.confidence) for r in table.collect()}
    assert got["sql"] == ("R1", "alias", 0.95) and got["σκουελ"] == ("S1", "alias", 0.95) and got["λογιστης"] == ("R1", "name", 1.0) and len(got) == 5
    texts = spark.createDataFrame([(1, "Ζητείται ΛΟΓΙΣΤΉΣ με 5+ χρόνια και c++, άδεια κλαρκ"), (2, "nothing"), (3, None), (4, "")], "id int, body string")
    tags = {r.id: r for r in aliases.tag(texts, "id", "body", table).collect()}
    assert (tags[1].years, tags[1].license, tags[1].ids, tags[1].confidence) == (5, "forklift", {"roles": ["R1"], "skills": ["S2"]}, 0.7)
    assert all((tags[i].kind, tags[i].confidence) == ("semantic", 0.3) for i in (2, 3, 4))
    tokens = {r.token: r.weight for r in aliases.weighted_tokens(roles.select("id", "name", F.lit("λογιστής cpa").alias("alt")), "id", {"name": "A", "alt": "B"}).collect()}
    assert tokens == {"λογιστης": "A", "cpa": "B"}
    assert values(spark, ["Η Άννα του PowerBI2", None], aliases.analysed(F.col("c"), ["η", "του"], True)) == [(["αννα", "powerbi2", "power", "bi", "2"],), (None,)]
    named = spark.createDataFrame([("erp", "SAP", ["sap b1"]), ("erp", "Odoo", None)], "g string, n string, v array<string>")
    assert aliases.expanded(named, "n", "v", "g").first().terms == ["Odoo", "SAP", "sap b1"]
    rules = spark.createDataFrame([("CPA", ["chartered"], "Excel"), ("ACCA", None, "Word")], "rule string, variants array<string>, gives string")
    held = spark.createDataFrame([("Chartered ACCA",), ("cpa exam",), (None,)], "name string")
    assert {tuple(r) for r in aliases.implied(held, "name", rules, "rule", "variants", "gives").collect()} == {("Chartered ACCA", "Word"), ("cpa exam", "Excel")}


def test_readings(spark):
    rows = spark.createDataFrame([
        (1, "a", "hello world", 0.8), (1, "b", "Hello World", 0.9), (2, "a", "abcdefgh", 0.5), (2, "b", "zzzz", 0.5), (3, "a", "solo", 0.5), (3, "b", None, 0.9), (4, "a", "", 0.1),
    ], "doc int, engine string, text string, confidence double")
    fused, shares = readings.fuse_readings(rows, "doc")
    got = {r.doc: (r.text, r.confidence, r.agreement, r.arbitrate) for r in fused.collect()}
    assert got == {1: ("Hello World", 0.95, 1.0, False), 2: ("abcdefgh", 0.7, 0.0, True), 3: ("solo", 0.35, 0.0, False), 4: ("", 0.0, 0.0, False)}
    parts = {(r.doc, r.engine): r.share for r in shares.collect()}
    assert parts == {(1, "a"): 0.5, (1, "b"): 0.5, (2, "a"): 1.0, (2, "b"): 0.0, (3, "a"): 1.0}


def test_writing(spark, tmp_path):
    schema = "id int, name string, jobs array<struct<title:string,months:int>>, extra map<string,string>"
    new = spark.createDataFrame([(1, "A", [("x", 3), (None, None)], {"hobby": " Chess "}), (3, "C\x00", None, None)], schema)
    tables = writing.fan_out(new, "id", {"name": F.col("name")}, {"jobs": {"title": F.col("item.title"), "months": F.col("item.months")}})
    assert [tuple(r) for r in tables["jobs"].collect()] == [(1, 0, "x", 3)]
    assert all("u0000" not in r.raw_json for r in tables["parents"].collect())
    old = spark.createDataFrame([(1, "Old", 5, "k"), (2, "B", 1, None)], "id int, name string, n int, note string")
    fresh = spark.createDataFrame([(1, None, 3, "l"), (3, "C", None, "m")], "id int, name string, n int, note string")
    got = {tuple(r) for r in writing.upsert(old, fresh, ["id"], {"name": "fill", "n": "greatest", "note": "keep"}).collect()}
    assert got == {(1, "Old", 5, "k"), (2, "B", 1, None), (3, "C", None, "m")}
    children = spark.createDataFrame([(1, 0, "old", 9), (2, 0, "stays", 1)], "id int, place int, title string, months int")
    after = writing.replace_children(children, tables["jobs"], tables["parents"], "id")
    assert {(r.id, r.title) for r in after.collect()} == {(1, "x"), (2, "stays")}
    folders = writing.write_version({"jobs": after}, str(tmp_path), "1", {"jobs": "id"})
    assert spark.read.parquet(folders["jobs"]).count() == 2
    assert [tuple(r) for r in writing.unmapped(new, "id", "extra").collect()] == [(1, "hobby", " Chess ", "chess")]


def test_json_records(spark):
    noisy = ['Here:\n```json\n{"roles":["dev"],"languages":[{"language_code":"en"}],}\n```', "nothing", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(noisy)], "id int, t string")
    got = {r.id: r for r in json_records.requirements(rows, "id", "t").collect()}
    assert got[0].roles == ["dev"] and got[0].languages[0].is_required and got[0].certifications_priority == "nice"
    assert got[1].roles == [] and got[1].detected_language == "en" and got[2].remote_acceptable
    report = '{"ranked_candidates":[{"candidate_id":"7","gaps":[{"criterion":"x"}]},{"rank":2,"match_percentage":80.5}]}'
    ranked = json_records.reports(spark.createDataFrame([(1, report)], "id int, t string"), "id", "t").collect()
    assert [(r.rank, r.candidate_id, r.suitability, r.percent) for r in ranked] == [(0, "7", "Medium", 0.0), (2, "", "Medium", 80.5)]
    assert ranked[0].gaps[0].severity == "Moderate" and ranked[1].gaps == []
    person = '{"personal":{"first":"A"},"jobs":[{"title":"x","start":"2024-13-01","kind":"Odd"},{"title":""},{"title":"y","start":"2024-01-02","kind":"Contract"}]}'
    one = json_records.people(spark.createDataFrame([(1, person)], "id int, t string"), "id", "t").first()
    assert [(j.title, str(j.start), j.kind) for j in one.jobs] == [("x", "None", "other"), ("y", "2024-01-02", "contract")]
    assert one.warnings == ["bad start: x", "bad kind: x"] and one.skills == []


def test_phone_lengths_and_repeats(spark):
    got = values(spark, ["2101", "21012345678", "6900000000011", "6900000000", "abc77777", ""], text.phone_check(F.col("c")))
    assert [g.warning for (g,) in got] == ["landline too short: 4", "landline too long: 11", "mobile too long: 13; repeated digits", None, "non-digit characters; repeated digits", None]


def test_first_object(spark):
    given = ['x {"a": "}"} {"b": 1}', "{bad {\"c\": 2} tail", "none", None, "{"]
    assert [g for (g,) in values(spark, given, nested.first_object(F.col("c")))] == ['{"a": "}"}', '{"c": 2}', None, None, None]


def test_output_rows(spark):
    row = spark.sql("select cast(1.50 as decimal(9,2)) d, cast('é' as binary) b, timestamp_ntz'2024-01-02 03:04:05' t, date'2024-01-02' y, cast(null as string) n")
    assert files.output_rows(row).first().value == '{"d":1.5,"b":"é","t":"2024-01-02T03:04:05","y":"2024-01-02","n":null}'


def test_nearest_equals_brute_force(spark):
    vectors = [(i, [float(i % 7) - 3, float(i % 5) - 2, float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0] * 3), (62, [float("nan"), 1.0, 1.0])]
    rows = spark.createDataFrame(vectors, "id long, v array<double>")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("q"), F.col("v").alias("w"))
    got = {(r.q, r["rank"]): (r.id, r.score) for r in retrieval.nearest(rows, "id", "v", asked, "q", "w", 5, row_block=9, query_block=2).collect()}

    def unit(v):
        size = sum(x * x for x in v) ** 0.5 if v and all(x == x for x in v) else 0
        return [x / size for x in v] if size else [0.0] * 3

    known = {i: unit(v) for i, v in vectors}
    for q in (0, 20, 40, 60):
        best = sorted((-round(sum(a * b for a, b in zip(known[q], v)), 6), i) for i, v in known.items())[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, pytest.approx(-s, abs=1e-6)) for s, i in best]
    assert retrieval.nearest(rows.limit(0), "id", "v", asked, "q", "w", 5).count() == 0


def test_cascade_vector_tier(spark):
    items = spark.createDataFrame([("excel",), ("zzz",), ("qqq",), ("www",)], "t string")
    names = spark.createDataFrame([("Excel",), ("Accounting",)], "n string")
    given = spark.createDataFrame([("zzz", [1.0, 0.1]), ("qqq", [1.0, 1.0]), ("www", [-1.0, 0.0])], "item string, vector array<double>")
    known = spark.createDataFrame([("Accounting", [1.0, 0.0])], "name string, vector array<double>")
    got = {r.item: (r.name, r.method) for r in matching.cascade(items, "t", names, "n", vectors=(given, known)).collect()}
    assert got == {"excel": ("Excel", "exact"), "zzz": ("Accounting", "vector"), "qqq": ("Accounting", "vector_suggested"), "www": (None, "none")}
