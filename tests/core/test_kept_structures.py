import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.operators import percolate, retrieval, vector_index
from rosterlake.operators.text_index import TextIndex

WORDS = "sun moon star wind rain snow leaf root stone river".split()


def rows_of(df):
    return sorted((r.q_id, r.doc_id, r.score, r["rank"]) for r in df.collect())


def some_docs(rng, n):
    words = WORDS + [f"w{i}" for i in range(200)]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(n)]


def test_index_equals_bm25_through_updates(spark, tmp_path):
    rng = random.Random(1)
    state = dict(some_docs(rng, 300))
    asked = spark.createDataFrame([(1, "sun and wind w5 w7"), (2, "nothing of it"), (3, "river river w150"), (4, "")], "q_id long, q string")
    index = TextIndex(spark, str(tmp_path), buckets=4, per_block=16)
    assert index.search(asked, "q_id", "q", 5).count() == 0
    frame = lambda rows: spark.createDataFrame(list(rows), "doc_id long, text string")

    def same(**options):
        docs = frame(state.items())
        found = rows_of(index.search(asked, "q_id", "q", 7, **options))
        among = options.get("among")
        want = retrieval.bm25(docs if among is None else docs.join(among.withColumn("here", F.lit(True)), "doc_id", "left"), "doc_id", "text", asked, "q_id", "q", 7, where=None if among is None else F.col("here").isNotNull())
        assert found == rows_of(want) and len(found) > 10

    index.update(frame([*state.items(), (None, "sun sun")]), 1)
    same()
    same(among=frame([(i, "") for i in range(0, 300, 3)]).select("doc_id"))
    changed = {i: f"{state[i]} wind sun w5" for i in range(0, 300, 7)} | {900: "river of stars", 901: None, 5: ""}
    index.update(frame(changed.items()), 2)
    state |= {k: v or "" for k, v in changed.items()}
    same()
    removed = frame([(i, None) for i in (7, 8, 9, 900, 12345)])
    index.update(frame([(10, "moon w5 w7 sun")]), 3, removed=removed)
    state = {k: v for k, v in state.items() if k not in (7, 8, 9, 900)} | {10: "moon w5 w7 sun"}
    same()
    assert index.state()[2:] == (len(state), sum(len(v.split()) for v in state.values()))
    index.update(frame([(10, "moon w5 w7 sun")]), 3, removed=removed)  # replayed
    same()
    index.compact(4)
    assert index.state()[0] == [4]
    same()


def test_update_leaves_other_postings_alone(spark, tmp_path):
    docs = spark.createDataFrame(some_docs(random.Random(2), 200), "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path), buckets=4, per_block=16)
    index.update(docs, 1)
    files = lambda: {(str(f), f.stat().st_mtime_ns) for f in tmp_path.rglob("segment=1/**/*.parquet")}
    before = files()
    index.update(docs.where("doc_id = 17"), 2)
    assert files() == before
    new = spark.read.parquet(f"{tmp_path}/postings/segment=2")
    text = docs.where("doc_id = 17").first().text
    assert {r.token for r in new.collect()} == set(text.split()) and all(list(r.ids) == [17] for r in new.collect())


def test_bounds_hold_and_leave_blocks_unopened(spark, tmp_path):
    rng = random.Random(3)
    rows = some_docs(rng, 2000) + [(5000 + i, "quartz " * 5 + "onyx jade") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "quartz onyx jade sun")], "q_id long, q string")
    index = TextIndex(spark, str(tmp_path), buckets=4, per_block=16)
    index.update(docs, 1)
    _, bounds = index.bounds(asked, "q_id", "q")
    found = index.search(asked, "q_id", "q", 4).collect()
    least = min(r.score for r in found)
    every = bounds.collect()
    assert {r.doc_id for r in found} == {5000, 5001, 5002, 5003}
    assert sum(r.bound >= least - 1e-6 for r in every) <= 4 < len(every) / 10


def test_folder_of_a_cluster_must_be_given(spark, monkeypatch):
    from rosterlake.sources.shared import shared_folder

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.master": "yarn"}.get(key, default))

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session, "x")


def vectors_of(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, {name}_v array<double>")


@pytest.mark.parametrize("spread", [0.25, None])
def test_recall_of_approximate_neighbours(spark, spread):
    """Vectors around centres, and vectors in any direction, which are the hardest."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 32))
    if spread:
        x = rng.standard_normal((60, 32))[rng.integers(0, 60, 4000)] + spread * x
    rows, asked = vectors_of(spark, x, "r"), vectors_of(spark, x[::20], "q")
    index = vector_index.build(rows, "r", "r_v")
    found = vector_index.search(index, asked, "q", "q_v", 10, "r")
    exact = vector_index.exact(rows, "r", "r_v", asked, "q", "q_v", 10)
    told = vector_index.recall(found, exact, "q", "r").agg(F.sum("found"), F.sum("wanted")).first()
    assert told[1] == 2000 and told[0] >= 0.9 * told[1]
    share = vector_index.compared(index, asked, "q", "q_v") / (200 * 4000)
    assert share < (0.15 if spread else 0.75), share
    whole = vector_index.search(index, asked, "q", "q_v", 10, "r", probes=10**6, rerank=400)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.select("q", "r", "score", "rank").collect()))


def test_vector_index_odd_rows(spark, monkeypatch):
    nan = float("nan")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [0.0, 2.0]), (6, [0.0, 2.0]), (7, [None, 1.0])], "id long, v array<double>")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "q long, w array<double>")
    index = vector_index.build(rows, "id", "v")
    assert [tuple(r) for r in vector_index.search(index, asked, "q", "w", 2, "id").orderBy("rank").collect()] == [(1, 5, 1.0, 1), (1, 6, 1.0, 2)]
    assert vector_index.search(vector_index.build(rows.limit(0), "id", "v"), asked, "q", "w", 2, "id").count() == 0
    monkeypatch.setattr(vector_index, "PART", 100)
    x = np.random.default_rng(5).standard_normal((1000, 8)) + 3  # one hot direction, few lists: all are cut in parts
    rows, asked = vectors_of(spark, x, "r"), vectors_of(spark, x[:10], "q")
    index = vector_index.build(rows, "r", "r_v", lists=3, probes=3)
    assert index.parts.max() > 2
    found = vector_index.search(index, asked, "q", "q_v", 5, "r", rerank=50)
    exact = vector_index.exact(rows, "r", "r_v", asked, "q", "q_v", 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.select("q", "r", "score", "rank").collect()))


def test_percolation_equals_running_each_search(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["red", "green", "Blue 50%", None]), rng.choice([None, 1.0, 2.5, 7.0, 40.0]), f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(10)}") for i in range(200)]
    rows = spark.createDataFrame(docs, "id long, colour string, size double, day string")
    fields = {"colour": F.col("colour"), "size": F.col("size"), "day": F.col("day").cast("date")}
    columns = {"colour": "colour", "size": "size", "day": "cast(day as date)"}
    values = {"colour": ["'red'", "'green'", "'Blue 50%'", "'none'"], "size": ["1.0", "2.5", "3.0", "40.0"], "day": ["date'2024-03-11'", "date'2024-05-19'", "date'2024-08-10'"]}
    plain = lambda v: v.removeprefix("date").strip("'")
    searches, tests = [], {}
    signs = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
    for n in range(120):
        parts, sql = {}, ["true"]
        for f in rng.sample(list(fields), rng.randrange(0, 3)):
            op = rng.choice([*signs, "between", "in", "any", "not_in", "is_null", "is_not_null", "contains", "strange"])
            a, b = sorted(rng.choices(values[f], k=2), key=lambda v: float(v) if f == "size" else v)
            c = columns[f]
            if op in signs or op == "strange":
                parts[f], test = {"operator": op, "value": plain(a)}, f"{c} {signs.get(op, '=')} {a}"
            elif op == "between":
                parts[f], test = {"operator": op, "value": [plain(a), plain(b)]}, f"{c} between {a} and {b}"
            elif op in ("in", "any", "not_in"):
                parts[f], test = {"operator": op, "value": [plain(a), plain(b)]}, f"{c} {'not ' * (op == 'not_in')}in ({a}, {b})"
            elif op == "contains":
                part = rng.choice(["ee", "RED", "lue_50", "1"])
                parts[f], test = {"operator": op, "value": part}, f"cast({c} as string) ilike '%{part}%'"
            else:
                parts[f], test = {"operator": op}, f"{c} {op.replace('_', ' ')}"
            sql.append(test)
        searches.append((n, json.dumps(parts | {"unknown": 3} | ({"size": None} if "size" not in parts else {}))))
        tests[n] = " and ".join(sql)
    stored = percolate.clauses(spark.createDataFrame(searches, "sid long, filters string"), "sid", "filters", fields)
    got = {tuple(r) for r in percolate.percolate(rows, "id", fields, stored).collect()}
    want = {(n, r.id) for n, test in tests.items() for r in rows.where(test).select("id").collect()}
    assert got == want and 500 < len(got) < 120 * 200
    told = percolate.alerts(percolate.percolate(rows, "id", fields, stored), stored, F.lit("2024-09-01")).collect()
    assert len(told) == 120 and sum(r.new_matches for r in told) == len(got)
