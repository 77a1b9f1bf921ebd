import random
import re

import pytest

from rosterlake.functions import spotting


def brute(text, terms):
    return sorted((m.start(), t) for t in terms for m in re.finditer(f"(?={re.escape(t)})", text))


def brute_longest(text, terms):
    out, at = [], 0
    while at < len(text):
        here = [t for t in terms if text.startswith(t, at)]
        if here:
            out.append((at, max(here, key=len)))
            at += len(out[-1][1])
        else:
            at += 1
    return out


def test_automaton_equals_search_for_each_term():
    rng = random.Random(1)
    for _ in range(200):
        terms = sorted({"".join(rng.choices("abcλ", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))})
        text = "".join(rng.choices("abcλ ", k=rng.randrange(0, 60)))
        reader = spotting.Reader(spotting.build(terms))
        assert sorted((s, terms[t]) for s, t in reader.occurrences(text)) == brute(text, terms)
        assert [(s, terms[t]) for s, t in reader.longest(text)] == brute_longest(text, terms)


def test_thousands_of_terms_in_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng = random.Random(2)
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    whole = " ".join(texts.values()).lower()
    terms = sorted({whole[i : i + rng.randrange(4, 14)] for i in rng.choices(range(len(whole)), k=4000)} | {"", "no such term"})
    found = spotting.spot(docs, "doc_id", "text", spark.createDataFrame([(t,) for t in [*terms, None]], "term string"), "term").collect()
    got = {(r.doc_id, r.start, r.term) for r in found}
    assert len(got) == len(found) > 4000
    assert all(texts[d].lower()[s : s + len(t)] == t for d, s, t in got)
    some = list(texts)[::20]
    assert {x for x in got if x[0] in some} == {(d, s, t) for d in some for s, t in brute(texts[d].lower(), [t for t in terms if t])}


def test_more_terms_than_one_automaton_holds(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Xabcab"), (2, None), (3, "")], "id long, text string")
    terms = spark.createDataFrame([("ab",), ("ABC",), ("bca",), (None,)], "term string")
    want = [(1, "ab", 1), (1, "ab", 4), (1, "abc", 1), (1, "bca", 2)]
    assert sorted(map(tuple, spotting.spot(rows, "id", "text", terms, "term").collect())) == want
    assert [tuple(r) for r in spotting.spot(rows, "id", "text", terms, "term", overlapping=False).collect()] == [(1, "abc", 1), (1, "ab", 4)]
    monkeypatch.setattr(spotting, "WHOLE", 150)
    assert sorted(map(tuple, spotting.spot(rows, "id", "text", terms, "term").collect())) == want
    with pytest.raises(ValueError, match="automata"):
        spotting.spot(rows, "id", "text", terms, "term", overlapping=False)
    assert spotting.spot(rows, "id", "text", terms.limit(0), "term").count() == 0
