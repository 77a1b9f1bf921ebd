"""Text searches at size: what is shuffled and written, and odd rows."""

import math
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from __spark_entry__ import queries
from rosterlake.functions import text
from rosterlake.operators import retrieval, text_index
from rosterlake.operators.text_index import TextIndex


def plain_bm25(rows, asked, k, mean):
    """By the formula, document by document; rows that repeat id and size are one, and all rows of an id add up."""
    merged = {}
    for i, text in rows:
        words = (text or "").lower().split()
        merged.setdefault((i, len(words)), Counter()).update(words)
    df = Counter(w for c in merged.values() for w in c)
    out = set()
    for q, text in asked:
        scores = Counter()
        for (i, n), c in merged.items():
            for w in set(text.lower().split()) & set(c):
                scores[i] += math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean))
        ranked = sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
        out |= {(q, i, s, r + 1) for r, (s, i) in enumerate(ranked)}
    return out


def test_no_pair_of_a_query_and_a_document_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ENTRIES", 100, raising=False)
    monkeypatch.setattr(retrieval, "ASKED", 7, raising=False)
    rows = [(i, f"The word{i % 7} and W{i % 31} the end" + " filler" * (i % 5)) for i in range(400)]
    rows += [(3, rows[3][1]), (4, "the the other size"), (900, None), (901, ""), (902, "?!"), (903, rows[5][1])]
    asked = [(q, f"the end of word{q % 7} w{q} filler") for q in range(30)] + [(90, ""), (91, "unheard")]
    docs, queries = spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame(asked, "q long, words string")
    sizes = [len(t.replace("?!", "").split()) for _, t in rows if t is not None]
    want = plain_bm25([(i, t and t.replace("?!", "")) for i, t in rows], asked, 4, sum(sizes) / len(sizes))
    for wanted in (200_000, 3):  # with more words than that all are counted
        monkeypatch.setattr(retrieval, "WANTED", wanted, raising=False)
        found = retrieval.bm25(docs, "id", "t", queries, "q", "words", 4)
        got = {(r.q, r.id, r.score, r["rank"]) for r in found.collect()}
        assert len(got) == 120 and {(q, i, r) for q, i, _, r in got} == {(q, i, r) for q, i, _, r in want}
        assert all(abs(s - t) < 2e-6 for (*_, s, _), (*_, t, _) in zip(sorted(got), sorted(want)))
        # Four documents a query leave each block: pairs are added up inside a task.
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and plan.index("FlatMapCoGroupsInArrow") < plan.index("Join")


def test_letters_are_counted_without_a_list_of_them(spark):
    odd = ["", None, "abc", "αβγ", "abcdefg αβγ", "abcdefgh αβγδ", "12 3!", "ἀῆ x", "𝔘𝔫 α", "á é\nß", " Ώρα_ΚΑΛΗ-7 \t", "ς jcqw Z9 "]
    rows = spark.createDataFrame(list(enumerate(odd)), "id int, t string")
    greek = lambda c: "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿"
    of = lambda t: "el" if sum(map(greek, t or "")) > 0.3 * sum(unicodedata.category(c)[0] == "L" for c in t or "") else "en"
    found = rows.select("t", text.language(F.col("t")).alias("l"), text.normalise_name(F.col("t")).alias("n"))
    assert "regexp_count" not in found._jdf.queryExecution().analyzed().toString()
    for r in found.collect():
        plain = "".join(c for c in unicodedata.normalize("NFD", (r.t or "").strip(" ").lower()) if unicodedata.category(c) != "Mn")
        assert r.l == of(r.t) and r.n == "".join(c for c in plain if c in "abcdefghijklmnopqrstuvwxyz0123456789 " or "α" <= c <= "ω")


def test_a_search_reads_its_postings_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"the word{i % 7} w{i} end") for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"the word{q} w{q * 9}") for q in range(7)], "q long, words string")
    index = TextIndex(spark, str(tmp_path), buckets=4, per_block=16)
    index.update(docs, 1)
    read, plain = [], TextIndex._read
    monkeypatch.setattr(TextIndex, "_read", lambda self, name, *a: read.append(name) or plain(self, name, *a))
    found = {tuple(r) for r in index.search(asked, "q", "words", 5, among=docs.where("doc_id <> 9")).collect()}
    assert read.count("postings") == 1 and read.count("dead") == 1
    assert found == {tuple(r) for r in retrieval.bm25(docs, "doc_id", "text", asked, "q", "words", 5, where=F.col("doc_id") != 9).collect()}
    # Equal tokens are found without a function that Spark calls for each of them.
    assert "lambdafunction" not in text.tokens(F.col("text"))._jc.toString()


def test_a_token_of_neighbouring_blocks_is_one_row(spark, tmp_path, monkeypatch):
    rows = [(i, f"the w{i % 50} w{i}" if i % 7 else "") for i in range(600)] + [(i, "") for i in range(600, 610)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the w3 w77"), (2, "w49 none")], "q long, words string")
    index = TextIndex(spark, str(tmp_path / "a"), buckets=4, per_block=16)
    index.update(docs, 1)
    assert index.bounds(asked, "q", "words")[1].select("block").distinct().count() > 30  # and still bounded block by block
    postings = spark.read.parquet(f"{tmp_path}/a/postings")
    assert postings.groupBy("token").count().agg(F.max("count")).first()[0] <= 3  # 39 blocks
    assert {r.df for r in postings.where("token = 'the'").groupBy("token").agg(F.sum("df").alias("df")).collect()} == {sum(bool(i % 7) for i in range(600))}
    # What the postings count is not counted again; only what a later segment takes away is.
    assert spark.read.parquet(f"{tmp_path}/a/counts").isEmpty()
    found = {tuple(r) for r in index.search(asked, "q", "words", 5).collect()}
    assert found == {tuple(r) for r in retrieval.bm25(docs, "doc_id", "text", asked, "q", "words", 5).collect()} and len(found) == 10
    # Long documents: fewer blocks in a group, here one.
    monkeypatch.setattr(text_index, "HELD", 20, raising=False)
    index.update(docs.where("doc_id % 3 = 0"), 2)
    assert [r.together for r in index.commits()] == [16, 1]
    assert found == {tuple(r) for r in index.search(asked, "q", "words", 5).collect()}
    empty = TextIndex(spark, str(tmp_path / "b"), per_block=1)
    empty.update(docs.where("text = ''"), 1)
    assert empty.search(asked, "q", "words", 5).isEmpty()


def test_no_text_is_joined_to_a_vector(spark, sf, monkeypatch):
    searched, plain = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda docs, *a, **more: searched.append(docs) or plain(docs, *a, **more))
    found = queries()["hybrid_search"](spark, sf)
    assert "Join" not in searched[0]._jdf.queryExecution().optimizedPlan().toString()
    # Vectors beside the documents or in a table of their own: the same.
    rows = spark.createDataFrame([(i, f"w{i % 3} w{i}", [1.0, i * 1.0] if i % 4 else None) for i in range(20)], "d long, t string, v array<double>")
    asked = spark.createDataFrame([(1, "w1 w7", [1.0, 3.0]), (2, "w2", None)], "q long, w string, x array<double>")
    search = lambda docs, **more: {tuple(r) for r in retrieval.hybrid(docs, "d", "t", "v", asked, "q", "w", "x", 4, where=F.col("d") != 5, **more).collect()}
    assert search(rows) == search(rows.drop("v"), vectors=rows.where("v is not null").drop("t"))
    assert found.count() > 0
