import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from rosterlake.llm import byte_bpe, exact_dedup, simhash
from rosterlake.llm.support import components

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, source string, digest string, fp long, mix_size int"
ODD = [None, "", " ", "a", "   x\ty", "don't we'll I'M", "naïve Ω≈ç√ 中文字符 🙂👍🏽", "x" * 5000, " \n\n\n  a ", "12345 6,7", "<|endoftext|>", "a\u0000b"]


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "s", "d", 1, 2) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected_tokens(library, text):
    ids = library.encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def test_bpe_equals_library_on_odd_and_random_texts(spark, library):
    rng = random.Random(1)
    alphabet = [*"abcdefghij    \n\t'.,!0123", "é", "ß", "中", "🙂", " ", "ł", "the", "ing", " of"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    rows = byte_bpe.digests(byte_bpe.encode_decode(frame(spark, texts), PATH, public_tokenizers.PATTERN)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == expected_tokens(library, texts[r.doc_id]), texts[r.doc_id]


def test_bpe_equals_library_on_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in byte_bpe.digests(byte_bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN)).collect():
        assert tuple(r)[1:] == expected_tokens(library, texts[r.doc_id])


def test_bpe_of_long_texts_in_parts_with_a_full_memo(library, monkeypatch):
    for name, value in {"MEMO": 2000, "AT_ONCE": 50, "PART": 7}.items():
        monkeypatch.setattr(byte_bpe, name, value)
    with open(PATH, "rb") as f:
        codec = byte_bpe.Codec(byte_bpe.read_ranks(f.read()), public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["the", " of", " x", "\n", "é", "7", " 🙂", "'s", "q" * 300]) for _ in range(rng.randrange(400)))
        ids = library.encode_ordinary(text)
        packed = codec.encode(text)
        assert packed == struct.pack(f"<{len(ids)}I", *ids) and codec.decode(packed) == text.encode()
        assert codec.held <= 2000 + 7 * (200 + 2 * 300 + 4 * 300) + 50 * 300


def test_bpe_empty_table(spark):
    assert byte_bpe.encode_decode(frame(spark, ["a"]).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        most = max(len(t) for _, t in members)
        keep = min((i for i, t in members if len(t) == most and i is not None), default=None)
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a", "b", " ", "\n", "é"]) for _ in range(rng.randrange(6))) for _ in range(400)]
    ids = list(range(len(texts)))
    texts += ["a b", "a b", None]
    ids += [3, 3, None]
    # A digest of 16 values makes different texts collide: bytes decide.
    digest = (lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 2))) if weak else None
    got = exact_dedup.exact_dedup(frame(spark, texts, ids), digest=digest).collect()
    cut = lambda rows: sorted([tuple(r)[: 4 if weak else 5] for r in rows], key=str)
    assert cut(got) == cut(brute_exact(zip(ids, texts)))


def test_exact_dedup_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, ["a"]).limit(0)).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check_simhash(rows, docs):
    fps = {i: brute_fingerprint(t) for i, t in docs}
    root = brute_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in rows) == sorted(
        (i, f, least[root[f]]) for i, f in fps.items()
    )


@pytest.mark.parametrize("heavy", [simhash.HEAVY, 2])
def test_simhash_equals_brute_force(spark, heavy):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = frame(spark, texts)
    check_simhash(simhash.near_duplicates(docs, heavy=heavy).collect(), list(enumerate(texts)))


@pytest.mark.parametrize("heavy", [simhash.HEAVY, 3])
def test_links_of_close_fingerprints(spark, heavy):
    rng = random.Random(4)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(30):
            f = base
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components(simhash.link(spark.createDataFrame([(f,) for f in signed], "fp long"), heavy))
    roots = {r.node & (1 << 64) - 1: r.root for r in found.collect()}
    want = brute_components(fps)
    for a in fps:
        for b in fps:
            assert (want[a] == want[b]) == (a == b or (a in roots and roots[a] == roots.get(b)))


def test_simhash_nulls_and_empty(spark):
    rows = simhash.near_duplicates(frame(spark, [None, "", "a b c d e"], [None, 5, None])).collect()
    assert sorted((str(r.doc_id), r.component_id is None) for r in rows) == [("5", False), ("None", False), ("None", True)]
    assert simhash.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_very_long_texts(spark):
    """Texts beyond every bound of a piece, and one that differs in its last word."""
    rng = random.Random(9)
    long = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=200_000))
    texts = [long, long.replace(" ", "\n"), long[:-1] + "!", "x" * 2_000_000, None]
    docs = frame(spark, texts)
    kept = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert kept == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1)}
    found = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    words = long.split()
    counts = [0] * 64
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    want = sum(1 << b for b in range(64) if 2 * counts[b] > len(words) - 2)
    assert found[0][0] % (1 << 64) == found[1][0] % (1 << 64) == want and found[0][1] == found[1][1] == 0
    assert found[4] == (0, 4)
