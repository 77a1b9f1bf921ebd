"""Operator 1: toxicity by weak supervision.

Voters judge each text: lexicons mined from labelled rows (words, and beginnings
of words, each dealt to several voters), a small fixed lexicon, patterns, and two
voters for clean text, which speak where the lexicons are silent; a label, where there
is one that may be read, is one more voter.  A generative label model is fitted to the
counts of all vote patterns of all documents by expectation maximisation: it estimates
each voter's accuracy in either class, the label's too, and the correlation that
remains between voters within a class; where correlated voters speak together, each
counts for less.  A linear classifier then learns the posterior labels, and no others,
from words and beginnings of words, and scores every text.

Two passes over the documents, no shuffle of text.  The number of vote patterns is
bounded by the voters.  Lexicons and classifier are fitted on a bounded sample of
labelled rows.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zlib
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from rosterlake.llm.support import materialize, text_of

#: Labelled rows to mine lexicons from and to fit the classifier on at most, half of either label where there are enough.
SAMPLE = 20_000
#: Features of the classifier at most.
FEATURES = 3_000
MEMO = 400_000

# Common insults in English.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass imbecile loser losers scum trash garbage pathetic worthless disgusting clown "
    "filthy vermin retard retarded bastard bitch asshole crap shit fuck fucking hate kill ugly jerk pig freak creep".split()
)
INSULTING = regex.compile(r"\b(?:you|u|they|these|those) (?:are|re|is) (?:all |just |such |so |an? |the )*(\w+)")

_SEPARATE = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or b < 32 else b for b in range(256))
VOTERS = ("word0", "word1", "word2", "word3", "start0", "start1", "fixed", "many", "insulting", "shouting", "clean_words", "clean_starts")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; punctuation separates."""
    return text.lower().encode().translate(_SEPARATE).split()


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings of four to seven characters."""
    out = [b"w" + word]
    chars = word.decode("utf-8", "replace")
    return out + [f"{n}{chars[:n]}".encode() for n in (4, 5, 6, 7) if len(chars) > n]


def fingerprint(words: list[bytes]) -> int:
    """The least hash of three words in a row: near copies mostly share it."""
    rows = zip(words, words[1:], words[2:]) if len(words) > 2 else [words]
    return min(xxhash.xxh64_intdigest(b" ".join(r)) for r in rows) >> 1


@dataclass(frozen=True)
class Lexicon:
    """Mined features: toxic ones (with their log likelihood gain) vote, all feed the classifier."""

    toxic: dict[bytes, float]
    features: tuple[bytes, ...]


def _sample(labels: DataFrame, bound: int) -> DataFrame:
    half = lambda v: labels.where(F.col("label") == v).orderBy(F.xxhash64("label_id"), "label_id").limit(bound // 2)
    return half(1).union(half(0))


def mine(sample: DataFrame, features: int = FEATURES) -> Lexicon:
    """Learn lexicons from rows (text, label) of labelled documents.

    Near copies count once, or one document's rare words would look like evidence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1)):
                found[label.as_py()].update({f for w in set(words_of(text.as_py())) for f in features_of(w)})
            keys = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in found)],
                names=["feature", "clean", "toxic"],
            )

    def copies(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(words_of(t.as_py())) for t in texts], pa.int64())

    key = F.arrow_udf(copies, T.LongType())
    single = materialize(sample.withColumn("copy", key("text")).dropDuplicates(["copy", "label"]).select("text", "label"), "single")
    sizes = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Lexicon({}, ())
    schema = T.StructType(
        [T.StructField("feature", T.BinaryType()), T.StructField("clean", T.LongType()), T.StructField("toxic", T.LongType())]
    )
    counts = single.mapInArrow(run, schema).groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts.where(F.col("toxic") + F.col("clean") >= 4), "features")
    tried = counts.count()
    base = n1 / (n0 + n1)
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((t + c) * share))).otherwise(0.0)
    counts = counts.withColumn("gain", part(t, base) + part(c, 1 - base)).withColumn("share", t / (t + c))
    # Of features tried by chance alone, about one in all reaches log(tried).
    best = counts.where(F.col("gain") >= 0.8 * math.log(max(tried, 2))).orderBy(F.desc("gain"), "feature").limit(features).collect()
    toxic = {bytes(r["feature"]): r["gain"] for r in best if r["gain"] >= math.log(max(tried, 2)) and r["share"] > max(0.7, 2 * base)}
    return Lexicon(toxic, tuple(sorted(bytes(r["feature"]) for r in best)))


class Voters:
    """Applies the voters to a text; built once in each task."""

    def __init__(self, lexicon: Lexicon):
        self.toxic = lexicon.toxic
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            fired = {
                (zlib.crc32(f) % 4) if f[:1] == b"w" else 4 + zlib.crc32(f) % 2 for f in features_of(word) if f in self.toxic
            }
            if word.decode("utf-8", "replace") in INSULTS:
                fired.add(6)
            got = self.memo[word] = tuple(sorted(fired))
        return got

    def vote(self, text: str) -> str:
        """One character per voter: + toxic, - clean, 0 no opinion."""
        words = words_of(text)
        hits: Counter = Counter(itertools.chain.from_iterable(map(self.of_word, words)))
        out = ["+" if hits[i] else "0" for i in range(7)]
        total = sum(hits[i] for i in range(7))
        out.append("+" if words and total >= max(3, 0.01 * len(words)) else "0")
        insulting = total and any(self.of_word(m.encode()) for m in INSULTING.findall(text.lower()))
        out.append("+" if insulting else "0")
        out.append("+" if total and sum(map(str.isupper, text.split())) * 3 > len(words) else "0")
        out.append("-" if not any(hits[i] for i in (0, 1, 2, 3, 6)) else "0")
        out.append("-" if not (hits[4] or hits[5]) else "0")
        return "".join(out)


@dataclass(frozen=True)
class LabelModel:
    """Class share, vote shares of each voter in either class, and correlations of voters within the classes."""

    prior: float
    shares: np.ndarray  # (voters, 3 votes, 2 classes)
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray, silence: bool = False) -> np.ndarray:
        """Probability of toxic for rows of votes 0 (clean), 1 (none), 2 (toxic).

        A voter's evidence is divided by one plus its positive correlations with the
        others that vote in the row.  That a voter is silent is evidence only if
        silence is true, and then is divided by its correlations with all voters.
        """
        spoken = votes != 1
        shared = np.maximum(self.correlations, 0)
        repeated = spoken @ shared
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            evidence = np.log(self.shares[j, votes[:, j], 1] / self.shares[j, votes[:, j], 0])
            quiet = evidence / shared[j].sum() if silence else 0.0
            odds += np.where(spoken[:, j], evidence / np.maximum(repeated[:, j], 1), quiet)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def as_votes(patterns: list[str]) -> np.ndarray:
    """Rows of votes 0 (clean), 1 (none), 2 (toxic); the last voter is the label."""
    return np.array([["-0+".index(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(VOTERS) + 1)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation maximisation over vote patterns and their counts; the last voter is the label.

    It starts from the label where there is one and else from the voters' majority.  The
    class share is that of the labels (without labels, the majority's): rows without votes
    say nothing of it.  Correlations are measured on the residuals of votes within the
    classes.
    """
    n = votes.shape[1]
    lean = (votes == 2).sum(1) - 0.5 * (votes == 0).sum(1)
    told = votes[:, -1] != 1
    belief = np.where(told, votes[:, -1] / 2, np.where(lean > 0, 0.9, 0.1))
    counts = counts.astype(float)
    known = counts * told if told.any() else counts
    prior = float(np.clip(((known * belief).sum() + 1) / (known.sum() + 2), 0.001, 0.5))
    for _ in range(rounds):
        shares = np.empty((n, 3, 2))
        for j in range(n):
            for v in range(3):
                at = votes[:, j] == v
                shares[j, v] = (counts * at * (1 - belief)).sum(), (counts * at * belief).sum()
            shares[j] = (shares[j] + 0.3) / (shares[j].sum(0) + 0.9)
        value = votes - 1.0
        mean = shares[:, 2] - shares[:, 0]
        part = np.zeros((n, n))
        for c, b in ((0, 1 - belief), (1, belief)):
            rest = value - mean[:, c]
            part += (rest * (counts * b)[:, None]).T @ rest
        spread = np.sqrt(np.maximum(np.diag(part), 1e-9))
        correlations = part / np.outer(spread, spread)
        np.fill_diagonal(correlations, 1.0)
        model = LabelModel(prior, shares, correlations)
        belief = model.posterior(votes, silence=True)
    return model


@dataclass(frozen=True)
class Classifier:
    """Linear weights of features that a text has."""

    weights: dict[bytes, float]
    intercept: float

    def scorer(self):
        memo: dict[bytes, tuple[bytes, ...]] = {}
        weights = self.weights

        def of_word(word: bytes) -> tuple[bytes, ...]:
            got = memo.get(word)
            if got is None:
                if len(memo) > MEMO:
                    memo.clear()
                got = memo[word] = tuple(f for f in features_of(word) if f in weights)
            return got

        def score(text: str) -> float:
            found = set(itertools.chain.from_iterable(map(of_word, set(words_of(text)))))
            return float(1 / (1 + np.exp(-np.clip(self.intercept + sum(map(weights.__getitem__, sorted(found))), -40, 40))))

        return score


def train(
    docs: DataFrame,
    labels: DataFrame,
    held_out,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    bound: int = SAMPLE,
    features: int = FEATURES,
) -> Classifier:
    """Fit on the documents; labels of rows where held_out is true are not read.

    bound: labelled rows to learn from at most; features: words and beginnings that the
    classifier may weigh, at most.  A label above 0 is toxic.  Where an id has two labels,
    the larger counts; rows with a null id or label are left out.  Without rows of both
    labels the fixed lexicon and patterns vote alone, and the classifier learns their
    posterior labels on at most bound documents.  Texts of any length are read whole.
    """
    known = (
        labels.where(~held_out & F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("label_id"))
        .agg((F.max(label) > 0).cast("int").alias("label"))
    )
    texts = docs.select(F.col(doc_id).alias("label_id"), text_of(text).alias("text"))
    # The sample has at most bound rows of two numbers.
    lexicon = mine(texts.join(F.broadcast(_sample(known, bound)), "label_id").select("text", "label"), features)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([voters.vote(t.as_py()) for t in batch.column(2)], pa.string())],
                names=["doc_id", "held", "votes"],
            )

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held", T.BooleanType()), T.StructField("votes", T.StringType())]
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_of(text).alias("text"))
    voted = materialize(rows.mapInArrow(vote, schema), "votes")
    spoken = F.coalesce(F.when(F.col("held"), None).when(F.col("label") == 1, "+").when(F.col("label") == 0, "-"), F.lit("0"))
    joined = voted.join(known, F.col("doc_id") == F.col("label_id"), "left")
    told = materialize(joined.select("doc_id", F.concat("votes", spoken).alias("votes")), "told")
    patterns = told.groupBy("votes").count().orderBy("votes").collect()
    if not patterns:
        return Classifier({}, 0.0)
    names = [r["votes"] for r in patterns]
    model = fit_label_model(as_votes(names), np.array([r["count"] for r in patterns]))
    listed = sorted({*lexicon.features, *(b"w" + w.encode() for w in INSULTS)})
    # Learn from labelled rows with the posterior of their votes; where no label may be read, from any rows.
    any_label = any(n[-1] != "0" for n in names)
    learned = told.where("doc_id is not null").where("not endswith(votes, '0')" if any_label else "true")

    def posterior(votes: pa.Array) -> pa.Array:
        return pa.array(model.posterior(as_votes(votes.to_pylist())), pa.float64())

    judged = learned.withColumn("belief", F.arrow_udf(posterior, T.DoubleType())("votes"))
    side = lambda w: judged.where(w).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound // 2)
    chosen = side("belief >= 0.5").union(side("belief < 0.5")).groupBy("doc_id").agg(F.max("belief").alias("belief"))

    def indices(texts: pa.Array) -> pa.Array:
        place = {f: i for i, f in enumerate(listed)}
        out = []
        for t in texts:
            x = np.zeros(len(listed))
            x[[place[f] for w in set(words_of(t.as_py())) for f in features_of(w) if f in place]] = 1.0
            out.append(x)
        return pa.array(out, pa.list_(pa.float64()))

    sparse = F.arrow_udf(indices, T.ArrayType(T.DoubleType()))
    fitting = texts.withColumnRenamed("label_id", "doc_id").join(F.broadcast(chosen), "doc_id").select(
        array_to_vector(sparse("text")).alias("features"), "belief"
    )
    soft = fitting.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("belief").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("belief")).alias("weight")),
    )).alias("s")).select("features", "s.label", "s.weight")
    soft = soft.where("weight > 0.001").persist()
    if soft.isEmpty():
        return Classifier({}, math.log(model.prior / (1 - model.prior)))
    linear = LogisticRegression(weightCol="weight", regParam=0.00005, maxIter=100, standardization=False).fit(soft)
    soft.unpersist()
    return Classifier(
        {f: w for f, w in zip(listed, linear.coefficients.toArray().tolist()) if abs(w) > 1e-4}, float(linear.intercept)
    )


def score(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row; a null text counts as empty and has the intercept's score.

    Repeated rows score alike; a text of any length is read whole; an empty table gives an
    empty result; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([of_text(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"]
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)
