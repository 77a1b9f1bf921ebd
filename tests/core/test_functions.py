import datetime

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import nested, temporal, text
from rosterlake.operators import filters, matching, writing
from rosterlake.sources import files
from rosterlake.streaming import intake, state


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def run_available(stream, name, mode, checkpoint):
    """What a stream gives for all that is there now, from a table in memory."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


@pytest.mark.parametrize("given, want", [("Λογιστής", "λογιστης"), ("ΜΗΧΑΝΙΚΌΣ", "μηχανικος"), ("  Ϊόνιο ", "ιονιο"), ("Café", "cafe"), (None, ""), ("", "")])
def test_normalise(spark, given, want):
    assert one(spark, text.normalise(F.lit(given).cast("string"))).replace("ς", "σ") == want.replace("ς", "σ")


@pytest.mark.parametrize(
    "a, b, want", [("Microsoft Excel", "Microsoft Office", 0.4348), ("AutoCad", "AutoCAD", 1), ("Phyton", "Python", 0.1667), ("λογιστης", "Λογιστής", 0.5), ("SAP S/4HANA", "SAP ERP", 0.2667), ("", "x", 0)]
)
def test_similarity(spark, a, b, want):
    assert one(spark, text.similarity(F.lit(a), F.lit(b))) == pytest.approx(want, abs=5e-5)


@pytest.mark.parametrize(
    "start, end, current, want",
    [
        ("2016-01-01", "2024-01-01", False, 96), ("2024-01-30", "2024-02-29", False, 1), ("2024-03-01", "2024-03-20", False, 1), ("2024-06-01", "2023-06-01", False, 12),
        ("2025-01-15", None, False, 12), ("2025-01-15", "2025-02-15", True, 12), (None, "2024-01-01", False, None),
    ],
)
def test_duration(spark, start, end, current, want):
    day = lambda d: F.lit(d).cast("date")
    assert one(spark, temporal.duration_months(day(start), day(end), F.lit(current), day("2026-01-15"))) == want


@pytest.mark.parametrize(
    "phone, valid, warning",
    [
        ("691 234 5678", True, None), ("(+30) 210-123-4567", True, None), ("69123", False, "mobile too short: 5"), ("693000111222", False, "mobile too long: 12"),
        ("+305123456789", False, "should start with 2 or 69"), ("555123", False, "no Greek format"), ("abc", False, "non-digit characters"), (None, True, None),
    ],
)
def test_phone(spark, phone, valid, warning):
    got = one(spark, text.phone_check(F.lit(phone).cast("string")))
    assert (got.valid, got.warning) == (valid, warning)


@pytest.mark.parametrize("given, want", [("engineer μηχ", "en"), ("λογιστής SAP", "el"), ("123", "en")])
def test_language(spark, given, want):
    assert one(spark, text.language(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('say {"a": {"b": 2}} so', '{"a": {"b": 2}}'), ("{broken", None), (None, None)])
def test_json_in_text(spark, given, want):
    assert one(spark, nested.json_in_text(F.lit(given).cast("string"))) == want


def test_cascade_tiers(spark):
    items = spark.createDataFrame([("AutoCAD",), ("Cost accounting",), ("Microsoft Excel",), ("Microsoft Ofice",), (None,), ("",)], "t string")
    names = spark.createDataFrame([("microsoft office",), ("autocad",), ("accounting",), ("",)], "n string")
    got = {r.item: (r.name, r.method) for r in matching.cascade(items, "t", names, "n").collect()}
    assert got == {
        "AutoCAD": ("autocad", "exact"), "Cost accounting": ("accounting", "substring"), "Microsoft Excel": (None, "none"),
        "Microsoft Ofice": ("microsoft office", "trigram" if got["Microsoft Ofice"][1] == "trigram" else "suggested"), "": (None, "none"),
    }


def test_relaxed_match(spark):
    people = spark.createDataFrame(
        [(1, ["Senior Accountant"], 6.0, ["SAP ERP"], ["en", "el"], []), (2, ["Accountant"], 3.5, ["SoftOne"], ["el"], []), (3, ["Welder"], 2.5, [], ["en"], ["ECDL"]), (4, ["Driver"], 1.0, [], ["el"], [])],
        "id int, roles array<string>, years double, software array<string>, languages array<string>, certificates array<string>",
    )
    categories = spark.createDataFrame([("ERP", "SoftOne"), ("ERP", "SAP")], "category string, name string")
    implied = spark.createDataFrame([("ECDL", "Microsoft Excel"), ("ECDL", "Microsoft Word")], "certificate string, name string")
    got = matching.match_relaxed(people, "id", "accountant", 5, ["ERP"], ["en"], [], categories, implied).collect()
    assert [(r.id, r.score, r.level, r["rank"]) for r in got] == [(1, 0.9, "high", 1), (2, 0.63, "medium", 2), (3, 0.2, "low", 3)]
    excel = matching.match_relaxed(people, "id", "accountant", 5, ["Excel"], ["en"], [], categories, implied).collect()
    assert {r.id: r.score for r in excel}[3] == 0.4


def test_upsert(spark):
    schema = "k string, occurrences long, similarity double, suggestion string"
    old = spark.createDataFrame([("k", 2, 0.61, "A")], schema)
    new = spark.createDataFrame([("k", 1, 0.55, None), ("k2", 1, None, None)], schema)
    assert sorted(map(tuple, matching.upsert_counts(old, new, ["k"]).collect())) == [("k", 3, 0.61, "A"), ("k2", 1, None, None)]


def test_unknown_fields_warn(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    fields = {"x": filters.Field("x")}
    rows, warnings = filters.apply_filters(base, "id", {"y": 1, "x": {"operator": "is_null"}}, fields, {})
    assert [r.id for r in rows.collect()] == [2] and warnings == ["unknown field: y"]
    assert [r.id for r in filters.apply_filters(base, "id", {"x": {"operator": "odd", "value": "a"}}, fields, {})[0].collect()] == [1]


def test_document_types_and_nesting(spark):
    rows = spark.createDataFrame([("a.PDF", "x" * 100), ("a.pdf", "x"), ("b.docx", None), ("c.png", None), ("d.exe", None)], "p string, t string")
    assert [r.x for r in rows.select(files.document_type(F.col("p"), F.col("t")).alias("x")).collect()] == ["text", "image", "text", "image", "unsupported"]
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, 5, "b"), (1, 4, "a")], "id int, n int, v string")
    got = {r.id: [tuple(x) for x in r.kids] for r in files.nest(parent, "id", {"kids": (child, ["n"])}).collect()}
    assert got == {1: [(4, "a"), (5, "b")], 2: []}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = run_available(state.latest_state(stream, "user_id", "event_type", "ts", "event_id"), "latest", "complete", str(tmp_path / "c"))
    want = state.latest_state(events, "user_id", "event_type", "ts", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_intake_once(spark, tmp_path):
    rows = [(i % 5, datetime.datetime(2024, 1, 1, 0, i)) for i in range(20)]
    spark.createDataFrame(rows, "id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp").parquet(str(tmp_path / "in"))
    got = run_available(state.once(stream, "id", "ts", "1 hour"), "once", "append", str(tmp_path / "c"))
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]


def test_intake_hands_texts_over_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, content in {"a.txt": "γεια", "b.pdf": "%PDF", "c.odt": "?", "empty.txt": ""}.items():
        (inbox / name).write_text(content, encoding="utf-8")
    got = []
    parse = lambda rows, batch: got.extend((r.path.rsplit("/", 1)[1], r.text) for r in rows.collect())
    run = lambda: intake.hand_over(files.uploads(spark, str(inbox), "*", stream=True), str(tmp_path / "q"), str(tmp_path / "c"), parse)
    run()
    assert got == [("a.txt", "γεια")]
    (inbox / "d.TXT").write_text("late")
    run()
    assert got == [("a.txt", "γεια"), ("d.TXT", "late")]
    steps = {r.path.rsplit("/", 1)[1]: r.next_step for r in spark.read.parquet(str(tmp_path / "q")).collect()}
    assert steps == {"a.txt": "parse", "b.pdf": "read_image", "c.odt": "failed", "d.TXT": "parse"}


def test_index_keeps_one_document_per_key(spark, tmp_path):
    old = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "first", 1), (2, "last", 2), (3, None, 1), (None, "lost", 1)], "k int, v string, n int")
    state = writing.indexed(old, new, "k", ["n"])
    assert sorted((r.k, r.v) for r in state.collect()) == [(1, "old"), (2, "last"), (3, None)]
    writing.write_index(spark.range(1300).withColumnRenamed("id", "k"), str(tmp_path / "i"), "k")
    parts = [len(p.read_text().splitlines()) for p in (tmp_path / "i").glob("*.json")]
    assert sum(parts) == 1300 and max(parts) <= 500
    written = writing.on_write(spark.createDataFrame([(" Ánna ",), (None,)], "name string"), F.lit("now"), {"name": "plain"}).collect()
    assert [(r.plain, r.updated_at) for r in written] == [("anna", "now"), ("", "now")]
