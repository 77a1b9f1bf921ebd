import math
import random
import re

import duckdb
import pytest

from rosterlake.llm import mixing, quality, queries
from rosterlake.llm.support import fold

SCHEMA = "doc_id long, text string, source string, mix_class int, n int"


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)).collect()


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        out = {s: 3.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if out[s] > 3 * sizes[s]}
        if not above:
            return out
        full |= above


def test_mix_targets_and_taken(spark):
    rng = random.Random(5)
    rows, sizes = [], {}
    for i in range(3000):
        source = rng.choice(["a"] * 30 + ["b"] * 8 + ["c"] * 3 + ["d", "Z", "é", None])
        n = rng.choice([0, 1, 5, 40, rng.randrange(1, 90)])
        rows.append((i, " ".join(["w"] * n), source))
        sizes[source] = sizes.get(source, 0) + n
    got = mixed(spark, rows)
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.mix_size == len((rows[r.doc_id][1]).split()) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(want[r.source]) and 0 <= r.mix_copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.mix_copies * r.mix_size
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.05 * want[s] + 100, (s, t, want[s])
    assert sorted(map(str, mixed(spark, rows))) == sorted(map(str, got))


def test_mix_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "x y", None), (2, "", "b"), (2, "q", "b"), (3, "z " * 20000, "c")]
    got = mixed(spark, rows)
    assert len(got) == 6 and all(r.mix_target == 0 for r in got if r.source == "a")
    emitted = mixing.emit(mixing.mix(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)))
    assert emitted.columns == ["doc_id", "text", "source", "mix_class", "n"]
    assert emitted.count() == sum(r.mix_copies for r in got)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_by_given_sizes_equals_mix_by_texts(spark):
    rows = [(i % 40, "w " * (i * 7 % 23), (None, "a", "b")[i % 3]) for i in range(90)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    kept = lambda df: sorted(map(str, df.select("doc_id", "source", "mix_size", "mix_target", "mix_copies").collect()))
    sized = docs.withColumn("size", mixing.words("text")).drop("text")
    assert kept(mixing.mix(sized, size="size")) == kept(mixing.mix(docs))


def test_mix_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(mixing.oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in queries.op4_mixing(spark, sf).collect())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scores = queries.op7_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def brute_statistics(text):
    data = text.encode()
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", data) if w]
    if not words:
        return [0.0] * len(quality.STATISTICS)
    n, m = len(words), len(data)
    share = lambda chars: sum(b in chars for b in data) / m
    lines = [x for x in data.split(b"\n") if x]
    return [
        math.log(1 + len(text)), math.log(1 + n), m / n, max(len(w) for w in words), share(range(65, 91)), share(b"0123456789"),
        share(b".,;:'\"()-"), share(b"#$%&*+=@^~<>\\/_`{}[]"), share(b"!"), share(b"|"), share(b" \t\n\r"), len(lines) / n,
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(words.count(w) for w in set(words)) / n,
        sum(w[-1] in b"#$%&*!@^~|" for w in words) / n, sum(len(w) > 1 and w.isupper() for w in words) / n, len(set(lines)) / len(lines),
    ]


def brute_quality(model, text):
    stats = brute_statistics(text)
    total = model.intercept + sum(w * stats[i] for i, w in model.linear)
    for rule, w in model.rules:
        if all(stats[i] <= x if below else stats[i] > x for i, below, x in rule.terms):
            total += w
    return 1 / (1 + math.exp(-total))


def test_quality_scores_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.quality_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.rules or model.linear
    for r in quality.score(docs, model).collect():
        assert r.quality_score == pytest.approx(brute_quality(model, r.text or ""), abs=1e-9)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "a b c"), (5, "x" * 100000)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (1, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score(docs.selectExpr("*", "'x' quality_score"), model).collect()
    assert len(rows) == 5 and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
    assert docs.where(fold("doc_id", 3) >= 0).count() == 5


def test_quality_keeps_every_other_column_and_reads_long_texts(spark):
    docs = spark.createDataFrame([(1, "a fine day. " * 200_000, 7, 8), (2, None, 9, 10)], "doc_id long, text string, quality_stats long, quality_stats_0 long")
    labels = spark.createDataFrame([(1, 3), (2, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).orderBy("doc_id").collect()
    assert [(r.quality_stats, r.quality_stats_0) for r in rows] == [(7, 8), (9, 10)] and all(0 <= r.quality_score <= 1 for r in rows)
