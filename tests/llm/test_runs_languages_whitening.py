import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from rosterlake.llm import language_id, periodic_runs, queries, whitening

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


# Periodic runs


def brute_runs(words):
    """Every maximal run by comparing all words q apart, for every q."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((i, j - i, q) for (i, j), q in best.items())


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def words_with_runs(rng):
    kind, n = rng.randrange(7), rng.randrange(0, 160)
    if kind == 0:
        return rng.choices("ab", k=n)
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        return fibonacci(n + 1)
    if kind == 3:
        return [str(i.bit_count() % 2) for i in range(n)]
    if kind == 4:  # squares of every odd period around one place
        return ["a", "b"] * rng.randrange(1, 30) + ["a"] + ["a", "b"] * rng.randrange(30)
    if kind == 5:
        part = rng.choices("abc", k=rng.randrange(1, 40))
        return part * rng.randrange(1, 5) + part[: rng.randrange(len(part) + 1)] + rng.choices("abc", k=5)
    return sum((rng.choices("ab", k=rng.randrange(1, 6)) * rng.randrange(1, 8) for _ in range(6)), []) * rng.randrange(1, 3)


def runs_of(texts):
    found, short = periodic_runs._handled(texts)
    out = [[] for _ in texts]
    for t, *run in zip(*found):
        out[t].append(tuple(map(int, run)))
    return out, short


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        docs = [words_with_runs(rng) for _ in range(8)]
        found, short = runs_of([" ".join(d) for d in docs])
        assert found == [brute_runs(d) for d in docs]
        assert short == [collapsed(d, r) for d, r in zip(docs, found)]


def test_runs_of_long_periodic_texts():
    (unary, broken), _ = runs_of(["a " * 100_000, "a b " * 30_000 + "a " + "a b " * 30_000])
    assert unary == [(0, 100_000, 1)]
    assert len(broken) == 29_999 and (0, 60_001, 2) in broken and (60_001, 60_000, 2) in broken


def test_wavelet_range_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(1000)
    tree = periodic_runs.Wavelet(values)
    for _ in range(200):
        lo, hi = sorted(rng.integers(0, 1001, 2))
        v = int(rng.integers(0, 1100))
        part = np.sort(values[lo:hi])
        one = lambda x: np.array([x])
        below = int(tree.below(one(lo), one(hi), one(v))[0])
        assert below == (part < v).sum()
        if below < hi - lo:  # the successor
            assert tree.nth(one(lo), one(hi), one(below))[0] == part[part >= v][0]


def test_op11_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, TINY).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    for r in rows:
        words = periodic_runs.WORD.findall(docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_runs_odd_rows(spark):
    long = " ".join(map(str, range(150_000)))
    rows = [(1, None, 7), (2, "", 8), (2, "", 8), (None, "x " * 13, 9), (3, long, 1), (4, "y" * 200_000, 1), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    found = periodic_runs.periodic_runs(docs, keep=["doc_id"]).collect()
    assert sorted((r.doc_id or 0, len(r.runs), len(r.collapsed)) for r in found) == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (2, 0, 0), (2, 0, 0), (3, 0, len(long)), (4, 0, 200_000)]
    assert periodic_runs.periodic_runs(docs.limit(0), keep=["doc_id"]).count() == 0
    assert queries.with_repeats(docs).count() == 7


# Languages


def brute_marginals(score, transitions):
    n, k = score.shape
    out, total = np.zeros((n, k)), 0.0
    for way in itertools.product(range(k), repeat=n):
        w = math.exp(sum(score[i, y] for i, y in enumerate(way)) + sum(transitions[a, b] for a, b in zip(way, way[1:])))
        total += w
        for i, y in enumerate(way):
            out[i, y] += w
    return out / total


def test_forward_backward_equals_enumeration():
    """Words beyond the ends add a constant where the transitions into each label sum to the same."""
    rng = np.random.default_rng(4)
    turn = np.log(np.array([[0.6, 0.3, 0.1], [0.1, 0.6, 0.3], [0.3, 0.1, 0.6]]))
    sizes = np.array([5, 1, 0, 7])
    score = rng.normal(size=(13, 3))
    found = language_id.marginals(score, sizes, turn)
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends):
        assert np.allclose(found[a:b], brute_marginals(score[a:b], turn))


def plain_marginals(score, transitions):
    """Forward and backward word by word."""
    a, phi = np.exp(transitions), np.exp(score)
    forward, now = [], np.ones(len(a))
    for x in phi:
        now = (now @ a) * x
        forward.append(now := now / now.sum())
    out, now = [], np.ones(len(a))
    for x, f in zip(phi[::-1], forward[::-1]):
        out.append(f * now / (f * now).sum())
        now = a @ (x * now)
        now = now / now.sum()
    return np.array(out[::-1])


def test_blocks_equal_a_pass_over_the_chain():
    rng = np.random.default_rng(5)
    turn = rng.normal(size=(4, 4))
    sizes = np.array([64, 1000, 3, 65, 127])
    score = rng.normal(size=(sizes.sum(), 4)) * 3
    found = language_id.marginals(score, sizes, turn)
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends):
        assert np.allclose(found[a:b], plain_marginals(score[a:b], turn), atol=1e-9)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(6)
    say = {"ba": "bdgaou", "ki": "kptiey", "zu": "zsvuao"}
    chains = [(["".join(rng.choices(say[n], k=rng.randrange(2, 7))) for _ in range(20)], i) for i, n in enumerate(sorted(say)) for _ in range(100)]
    return language_id.fit(chains, sorted(say)), chains


def test_slopes_of_transitions(model):
    """The expected pairs are those of enumeration."""
    rng = np.random.default_rng(7)
    score, turn = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    turn = turn - turn.max()
    turn[:] = np.log(np.array([[0.7, 0.3], [0.3, 0.7]]))
    want, total = np.zeros((2, 2)), 0
    for way in itertools.product(range(2), repeat=4):
        w = math.exp(sum(score[i, y] for i, y in enumerate(way)) + sum(turn[a, b] for a, b in zip(way, way[1:])))
        total += w
        for a, b in zip(way, way[1:]):
            want[a, b] += w
    assert np.allclose(language_id._pairs(score, np.array([4]), turn, np.arange(1, 4)), want / total)


def test_code_switched_words_are_labelled(spark, model):
    crf, chains = model
    assert (np.diag(crf.transitions) > crf.transitions.max(1) - 1e-9).all()  # staying is likelier than any change
    words = chains[0][0] + chains[250][0][:8] + chains[120][0]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None)], "doc_id long, text string")
    rows = language_id.label_words(docs, crf).orderBy("position").collect()
    assert [r.word for r in rows] == words
    assert sum(r.lang == l for r, l in zip(rows, ["ba"] * 20 + ["zu"] * 8 + ["ki"] * 20)) >= 47


def test_pieces_of_a_long_text_join_up(model, monkeypatch):
    crf, chains = model
    text = " ".join(w for c, _ in chains[::7] for w in c)
    whole = np.concatenate([p for _, _, p, _ in language_id.judged([text], crf)])
    monkeypatch.setattr(language_id, "PIECE", 500)
    parts = list(language_id.judged([text], crf))
    assert len(parts) > 5 and np.allclose(np.concatenate([p for _, _, p, _ in parts]), whole, atol=1e-6)


def test_op12_on_held_out_rows(spark):
    rows = queries.op12_language_id(spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_language_odd_rows(spark):
    rows = [(1, "der die das und ist " * 4, "de", 1), (2, "the and of is that " * 4, "en", 2), (3, None, "de", 3), (4, "12 -- 7!", None, 4), (None, "the and of", None, 5), (5, "", "xx", 6), (6, "the of " * 400_000, None, 7), (7, "der" * 100_000, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = language_id.train(docs)
    assert model.languages == ["de", "en"]
    found = {(r.doc_id): r for r in language_id.predict(docs, model, keep=["doc_id"]).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, None, 5, 6)] == ["de", "en", "und", "und", "en", "und", "en"] and found[3].score == 0
    assert language_id.predict(docs.limit(0), model).count() == 0
    none = language_id.train(docs.where("lang is null"))
    assert none is None and {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


# Whitening


def test_whitening_equals_brute_force(spark):
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    rows = queries.op13_whitening(spark, SMALL).collect()
    ids = list(given)
    x = np.array([[math.floor(1024 * c) + 100000 for c in given[i]] for i in ids])
    n, sums = len(x), x.sum(0)
    cov = (x - sums / n).T @ (x - sums / n) / n
    values, vectors = np.linalg.eigh(cov)
    deviation = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for i, v in zip(ids, x)}
    assert len(rows) == 8 * n
    place = {i: k for k, i in enumerate(ids)}
    for k in range(1, 9):
        own = sorted((place[r.vec_id], r) for r in rows if r.component == k)
        want = (x - sums / n) @ vectors[:, -k] / math.sqrt(values[-k])
        got = np.array([r.whitened for _, r in own])
        assert np.allclose(got, want, atol=1e-9) or np.allclose(got, -want, atol=1e-9)
        assert all(r.deviation == deviation[r.vec_id] and r.n == n and r.identity_error < 1e-9 for _, r in own)
        assert abs(own[0][1].explained / (values[-k] / np.trace(cov)) - 1) < 1e-9


def spread(values, seed=1):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1.0, 41),
        np.concatenate([[5, 5, 5], np.linspace(0.1, 4, 17)]),
        np.concatenate([3 + 1e-9 * np.arange(5), [1, 1 + 1e-12, 0.5]]),
        10.0 ** -np.arange(16),
        np.ones(6),
        np.array([7.0]),
        np.zeros(3),
    ],
)
def test_refined_eigenvectors(values):
    a = spread(values)
    found, x = whitening.eigenpairs(a)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    assert np.abs(a @ x - x * found).max() < 4e-15 * max(np.abs(values).max(), 1e-300) * len(a) ** 0.5
    assert np.allclose(found, np.sort(values)[::-1], atol=1e-14 * len(a) * values.max())


def test_refinement_betters_float32():
    a = spread(np.linspace(1, 2, 30))
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    best = np.abs(a @ rough - rough * (rough * (a @ rough)).sum(0)).max()
    found, x = whitening.eigenpairs(a)
    assert best > 1e-8 and np.abs(a @ x - x * found).max() < 1e-14


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, None, 2), (3, [nan, 1.0], 3), (4, [inf, 1.0], 4), (5, [None, 1.0], 5), (6, [], 6), (7, [1.0], 7), (None, [2.0, 5.0], 8), (8, [2.0, 5.0], 9), (8, [2.0, 5.0], 9), (9, [-1.0, 0.5], 1)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long")
    found = whitening.whitened(given).collect()
    assert len(found) == 10 and {r.n for r in found} == {5} and sum(r.vec_id is None for r in found) == 2
    assert whitening.whitened(given.limit(0)).count() == 0 and whitening.whitened(given.where("vec_id = 8")).count() == 0
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.component, abs(round(r.whitened, 12))) for r in one] == [(1, 1, 1.0), (2, 1, 1.0)]
    vast = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whitened(vast).collect()) in (3, 6)
