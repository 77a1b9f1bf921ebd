"""Each stage of the pipeline against a brute-force version on its own input."""

import base64
import hashlib
import random
import struct

import corpus_pipeline
import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rosterlake.llm import mixing, queries
from test_mixing_and_quality import brute_quality
from test_tokens_and_dedup import brute_components, brute_fingerprint

CLASHING = ["mix_size", "mix_copies", "mix_copy", "mix_class", "mix_source", "quality_stats", "quality_score", "quality_predicted", "pipeline_row", "row", "fp", "digest", "best", "stats", "further_0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture(scope="module")
def rows(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rng = random.Random(12)
    out = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given]
    out += [(r.doc_id, r.text, "zz", None, 0) for r in rng.sample(given, 5)]  # repeated ids and texts
    out += [(given[1].doc_id, given[2].text + " and more of the same", "en", "web", 1)]  # one id, two texts
    out += [(None, None, None, None, None), (None, "", "en", "web", 0), (None, given[3].text, None, None, 5), (9_000_000, given[4].text * 20, "en", "é", 7)]
    return [(*r, *[f"{c}{i}" for c in CLASHING]) for i, r in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts(rows):
    return sorted((tuple(r) for r in rows), key=str)


def brute_quality_filter(spark, rows, sf):
    model = queries.quality_model(frame(spark, rows).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    return [r for r in rows if brute_quality(model, r[1] or "") >= 0.5]


def brute_exact(spark, rows, sf):
    groups = {}
    for r in rows:
        groups.setdefault("".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r"), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]


def brute_near(spark, rows, sf):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root, groups = brute_components(set(fps)), {}
    for r, f in zip(rows, fps):
        groups.setdefault(root[f], []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def brute_mix(spark, rows, sf):
    documents = pd.DataFrame([(i, r[3], r[1]) for i, r in enumerate(rows)], columns=["n", "source", "text"])  # noqa: F841
    documents["doc_id"] = pd.array([r[0] for r in rows], "Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    sql = mixing.oracle_sql()
    for old, new in [("SELECT doc_id, size, source_size::BIGINT", "SELECT doc_id, size, source, source_size::BIGINT"), ("SELECT c.doc_id, c.size,", "SELECT c.doc_id, c.source, c.size,"), (") * size AS taken", ") AS copies")]:
        assert old in sql
        sql = sql.replace(old, new)
    copies = {}
    for doc_id, size, source, _, _, n in con.execute(sql).fetchall():
        copies.setdefault((doc_id, source, size), []).append(n)
    out = []
    for r in rows:
        out += [r] * copies[r[0], r[3], len((r[1] or "").split())].pop()
    return out


STEPS = [(corpus_pipeline.quality_filter, brute_quality_filter), (corpus_pipeline.exact, brute_exact), (corpus_pipeline.near, brute_near), (corpus_pipeline.mix, brute_mix)]


def settled(found):
    """Rows as the test compares them: of rows that tie in every respect a stage may keep either."""
    return sorted(((r[0], r[1]) for r in found), key=str)


def test_stages_equal_brute_force(spark, sf, rows):
    now = rows
    for stage, brute in STEPS:
        docs = frame(spark, now)
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns
        got = [tuple(r) for r in found.collect()]
        assert set(got) <= set(now) and settled(got) == settled(brute(spark, now, sf)), stage.__name__
        assert got and stage(spark, docs.limit(0), sf).count() == 0
        now = got
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in now:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert texts(corpus_pipeline.tokens(spark, frame(spark, now), sf).collect()) == texts(want)


def test_stages_take_odd_rows(spark, sf, rows):
    odd = [r for r in rows if r[0] is None or not r[1]]
    for stage, brute in STEPS[1:]:
        assert settled(stage(spark, frame(spark, odd), sf).collect()) == settled(brute(spark, odd, sf)), stage.__name__
    assert corpus_pipeline.quality_filter(spark, frame(spark, odd), sf).columns == frame(spark, odd).columns


def test_run_hands_on_what_stages_return(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    digests = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"))
    assert found.count() > 0 and found.join(digests, "doc_id").where("d <> decoded_sha256").count() == 0
