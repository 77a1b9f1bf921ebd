"""Fixtures for the cases in which a part of the job was once left out."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import aliases, governance, reports, retrieval
from rosterlake.plans import more_queries, record_queries  # noqa: F401  they register their queries
from rosterlake.plans import queries


def test_taxonomy_merge_covers_whole_tables(spark, sf):
    orders, lines = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "lineitem"))
    old = {(r.o_custkey, r.o_orderdate.year) for r in orders.collect()}
    owner = {r.o_orderkey: r.o_custkey for r in orders.collect()}
    new = {(owner[r.l_orderkey], r.l_shipdate.year) for r in lines.collect() if r.l_orderkey in owner}
    assert old - new and new - old and old & new
    got = queries.queries()["taxonomy_merge_whole"](spark, sf).collect()
    assert len(got) == len(old | new) and {(r.k, r.y) for r in got} == old | new


def brute_hybrid(docs, asked, k, allowed=lambda d: True):
    """query -> [(doc, vector rank, text rank)], best first; docs and asked: id -> (text, vector)."""
    words = {d: re.findall(r"\w+", t or "") for d, (t, _) in docs.items()}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for q, (text, vector) in asked.items():
        cosine = lambda v: sum(a * b for a, b in zip(v, vector)) / math.hypot(*v) / math.hypot(*vector)
        near = sorted((-round(cosine(v), 6), d) for d, (_, v) in docs.items() if v and vector and allowed(d))[: 2 * k]
        scores = {}
        for w in set(re.findall(r"\w+", text or "")):
            df = sum(w in ws for ws in words.values())
            for d, ws in words.items():
                if w in ws and allowed(d):
                    tf = ws.count(w)
                    part = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                    scores[d] = scores.get(d, 0) + part
        found = sorted((-round(s, 6), d) for d, s in scores.items())[: 2 * k]
        a, b = ({d: i + 1 for i, (_, d) in enumerate(x)} for x in (near, found))
        total = {d: (0.6 / (60 + a[d]) if d in a else 0) + (0.4 / (60 + b[d]) if d in b else 0) for d in a | b}
        out[q] = [(d, a.get(d), b.get(d)) for d in sorted(total, key=lambda d: (-total[d], d))[:k]]
    return out


@pytest.mark.parametrize("filtered", [False, True])
def test_hybrid_takes_both_lists_at_double_depth(spark, filtered):
    topics = ["sql spark data", "law contract court", "nurse ward care", "sql sql tuning", "weld steel"]
    docs = {i: (topics[i % 5] + " word" * (i % 4), [math.cos(i / 7), math.sin(i / 7), (i % 3) / 3]) for i in range(40)}
    docs |= {40: ("sql spark spark", None), 41: (None, [1.0, 0.1, 0.0]), 42: ("", None)}
    asked = {0: ("spark sql", [1.0, 0.0, 0.1]), 1: ("court", [0.0, 1.0, 0.3]), 2: ("nothing", [-1.0, 0.2, 0.0]), 3: ("weld", None)}
    rows = spark.createDataFrame([(i, t, v) for i, (t, v) in docs.items()], "id long, t string, v array<double>")
    queries_ = spark.createDataFrame([(i, t, v) for i, (t, v) in asked.items()], "q long, words string, w array<double>")
    where = F.col("id") % 4 != 1 if filtered else None
    got = retrieval.hybrid(rows, "id", "t", "v", queries_, "q", "words", "w", 6, where=where).collect()
    want = brute_hybrid(docs, asked, 6, (lambda d: d % 4 != 1) if filtered else lambda d: True)
    for q in asked:
        mine = sorted((r for r in got if r.q == q), key=lambda r: r["rank"])
        assert [(r.id, r.vector_rank, r.text_rank) for r in mine] == want[q]
    assert any(r.vector_rank is None for r in got) and any(r.text_rank is None for r in got) and any((r.vector_rank or 0) > 6 for r in got)


def test_tags_find_long_and_punctuated_aliases(spark):
    names = ["certified public accountant of the state", "node.js", "ci/cd", "objective-c", "two  spaces", "c++", "c", "!?"]
    table = aliases.alias_table({"s": spark.createDataFrame([(n, n) for n in names], "id string, name string")}, "id", {"name": "name"})
    texts = ["A Certified Public Accountant of the State, please", "Node.js and CI/CD", "objective-c;two spaces", "c++", "certified public accountant", "node", "!?"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
    got = {r.n: (r.ids or {}).get("s", []) for r in aliases.tag(rows, "n", "body", table).collect()}
    assert got == {0: [names[0]], 1: ["ci/cd", "node.js"], 2: ["c", "objective-c", "two  spaces"], 3: ["c++"], 4: [], 5: [], 6: []}
    assert [r.ids for r in aliases.tag(rows, "n", "body", table.limit(0)).collect()] == [None] * len(texts)


def test_violations_name_every_row_that_repeats(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 1), (4, "b", None), (5, "b", None), (6, None, 2), (7, "c", 3), (8, "a", -1)], "k int, x string, y int")
    rules, unique = {"negative": F.col("y") < 0}, {"xy": ["x", "y"], "x": ["x"]}
    got = sorted(map(tuple, governance.violations(rows, "k", rules, unique).collect()))
    assert got == sorted([("negative", 8)] + [("xy", k) for k in (1, 2, 3, 4, 5)] + [("x", k) for k in (1, 2, 3, 4, 5, 8)])
    assert sorted(map(tuple, governance.repeats(rows, "k", unique).collect())) == [("x", 1, 4), ("x", 4, 2), ("xy", 1, 3), ("xy", 4, 2)]


@pytest.mark.parametrize("name", ["warning_tally", "section_confidence", "coalescing_merge"])
def test_tallies_collect_nothing(spark, sf, name):
    plan = queries.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_first_values_collect_no_more_than_asked(spark):
    rows = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, None), (1, 4, "d"), (2, 1, "z"), (None, 1, "n")], "k int, o int, v string")
    found = reports.first_values(rows, "k", F.col("v"), [F.col("o")], 3, "vs")
    assert {r.k: r.vs for r in found.collect()} == {1: ["a", None, "c"], 2: ["z"], None: ["n"]}
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()


def test_report_texts_hold_bounded_pages(spark):
    keys = [*range(-1500, 2500), 7000]
    parts = spark.createDataFrame([(k, None if k % 7 == 0 else "B", f"t{k}") for k in keys], "p_partkey long, p_brand string, p_type string")
    texts = record_queries.report_texts(parts).collect()
    pages = [(r.p_brand, [(c["rank"], int(c["candidate_id"])) for c in json.loads(r.text)["ranked_candidates"]]) for r in texts]
    assert max(len(p) for _, p in pages) <= record_queries.REPORT_KEYS < 3000
    for brand in ("B", None):
        want = list(enumerate((k for k in keys if (k % 7 == 0) == (brand is None)), 1))
        assert sorted(c for b, p in pages if b == brand for c in p) == want
