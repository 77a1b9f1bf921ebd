"""The pipeline's stages judge rows, not ids."""

import corpus_pipeline
import pytest

from rosterlake.llm import exact_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"w{i}" for i in range(80))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("stage", [corpus_pipeline.exact, corpus_pipeline.near])
def test_one_row_of_a_text_stays_and_no_other_text_is_lost(spark, sf, stage):
    a, b, c, d = (f"{x} {WORDS[::-1] if x in 'bd' else WORDS} " + x * 30 + " ".join(f"{x}{i}" for i in range(200)) for x in "abcd")
    rows = [(1, a), (1, a), (5, b), (5, c), (4, b), (None, d), (None, d), (7, "x y " * 50), (None, "x y " * 50), (None, None), (None, "")]
    docs = frame(spark, rows)
    got = left(stage(spark, docs, sf))
    empty = [r for r in got if not r[1]]
    assert len(empty) == 1 and sorted((r for r in got if r[1]), key=str) == sorted([(1, a), (4, b), (5, c), (None, d), (7, "x y " * 50)], key=str)
    assert stage(spark, docs, sf).columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0


def test_exact_row_verdict_with_colliding_digests(spark):
    from pyspark.sql import functions as F

    rows = [(i % 4 or None, "ab "[i % 3] * (i % 5)) for i in range(40)]
    docs = frame(spark, rows)
    weak = lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 1))
    numbered = corpus_pipeline.numbered(docs)
    found = exact_dedup.exact_dedup(numbered, digest=weak, row=corpus_pipeline.ROW).collect()
    assert len(found) == 40 and sum(r.kept for r in found) == len({t.replace(" ", "") for _, t in rows})


def test_merge_index_resolves_over_many_flushes(spark):
    rows = [(i, f"{i % 7} text") for i in range(30)] + [(30, "7  text"), (31, "only"), (32, "7 text")]
    docs = frame(spark, rows)
    whole = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    index = exact_dedup.MergeIndex(spark, memtable=3, fan_in=2)
    for part in range(3):
        index.flush(docs.where(f"doc_id % 3 = {part}"))
        index.compact()
    sizes = [r.n_rows for r in index.runs().collect()]
    assert sum(sizes) == 33 and max(sizes) <= 3 and len(sizes) >= 11
    got = {r.doc_id: (r.keep_id, r.group_size) for r in index.resolve(docs).collect()}
    assert got == whole and got[29] == (1, 5) and got[32] == (30, 2) and got[31] == (31, 1)


def test_exact_dedup_of_string_and_extreme_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "x  y"), ("c", "z")], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.keep_id, r.kept) for r in exact_dedup.exact_dedup(docs, memtable=1, fan_in=2).collect())
    assert got == [("", None, True), ("a", None, False), ("b", None, False), ("c", "c", True)]
    low = -(1 << 63)
    numbers = spark.createDataFrame([(low, "q"), (5, "q"), (low + 1, "r")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(numbers).collect()} == {low: low, 5: low, low + 1: low + 1}
