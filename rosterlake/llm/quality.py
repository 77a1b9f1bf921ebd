"""Operator 7: quality classifier as a sparse rule ensemble.

Statistics of each text (one Arrow pass over whole texts) feed a small random
forest; every path from a root to a node is a conjunctive rule.  A lasso logistic
regression over the rules' truth values, and over the statistics themselves,
leaves few of them with a weight.  The surviving rules are compiled into Spark
column expressions; scoring is one projection over the statistics.

The forest and the lasso learn from a bounded sample of labelled rows (SAMPLE);
nothing else is sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rosterlake.llm.support import materialize, text_of

#: Labelled rows to learn from at most: those whose ids have the smallest hashes.
SAMPLE = 20_000
TREES = 24
DEPTH = 3
LASSO = 0.002

STATISTICS = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper", "digits", "marks", "symbols", "shouts",
    "bars", "spaces", "lines", "distinct", "repeats", "top_word", "marked_words", "upper_words", "distinct_lines",
)

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:'\"()-"
_SYMBOLS = b"#$%&*+=@^~<>\\/_`{}[]"


def statistics_of(text: str) -> list[float]:
    """The statistics of one text, in the order of STATISTICS; zeros for a text without words."""
    import math
    from collections import Counter

    data = text.encode()
    words = data.split()
    n, m = len(words), len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda drop: (m - len(data.translate(None, drop))) / m
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    lasts = Counter(w[-1] for w in words)
    marked = sum(c for b, c in lasts.items() if b in b"#$%&*!@^~|")
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        math.log1p(len(text)), math.log1p(n), m / n, float(max(map(len, counts))), share(_UPPER), share(_DIGITS),
        share(_MARKS), share(_SYMBOLS), share(b"!"), share(b"|"), share(b" \t\n\r"), len(lines) / n, len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values()) / n, marked / n, upper / n, len(set(lines)) / len(lines),
    ]


def with_statistics(docs: DataFrame, text: str = "text", column: str = "stats") -> DataFrame:
    """docs with an array of statistics; a null text counts as empty."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics_of(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return docs.withColumn(column, run(text_of(text)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of comparisons (statistic, is at most, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for i, below, x in self.terms:
            value = F.get(F.col(stats), F.lit(i))
            out = out & ((value <= x) if below else (value > x))
        return out


def tree_rules(forest) -> list[Rule]:
    """Every root-to-node path of a fitted forest, each once."""
    found: dict[Rule, None] = {}

    def walk(node, terms: tuple) -> None:
        if terms:
            found[Rule(terms)] = None
        if node.numDescendants() > 0:
            split = node.split()
            i, x = split.featureIndex(), split.threshold()
            walk(node.leftChild(), (*terms, (i, True, x)))
            walk(node.rightChild(), (*terms, (i, False, x)))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found)


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and linear terms; a logistic score as a Column."""

    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[int, float], ...]
    intercept: float

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(0.0)
        for i, weight in self.linear:
            total = total + F.get(F.col(stats), F.lit(i)) * weight
        return 1.0 / (1.0 + F.exp(-total))


def sample_of(labelled: DataFrame, key: str, bound: int) -> DataFrame:
    """At most bound rows, those with the smallest hashes of key."""
    return labelled.orderBy(F.xxhash64(key), key).limit(bound)


def fit(labelled: DataFrame, stats: str = "stats", label: str = "label", seed: int = 7) -> RuleEnsemble:
    """Learn from rows with statistics and a label of 0 or 1.

    With no row, or one label only, the score is constant: the share of label 1,
    or 0.5 without rows.
    """
    shares = labelled.agg(F.count("*").alias("n"), F.avg(label).alias("p")).first()
    if not shares["n"] or shares["p"] in (0.0, 1.0):
        import math

        p = min(max(0.5 if shares["p"] is None else shares["p"], 0.01), 0.99)
        return RuleEnsemble((), (), math.log(p / (1 - p)))
    rows = labelled.select(array_to_vector(F.col(stats)).alias("features"), F.col(label).cast("double").alias("label"), stats)
    # Both labels weigh alike, so that a score of 0.5 is a balanced decision.
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / shares["p"]).otherwise(0.5 / (1 - shares["p"])))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=seed, weightCol="weight", featureSubsetStrategy="onethird", minInstancesPerNode=2
    ).fit(rows)
    rules = tree_rules(forest)
    truth = F.array(*[F.when(r.column(stats), 1.0).otherwise(0.0) for r in rules]) if rules else F.array().cast("array<double>")
    wide = materialize(rows.select(F.concat(truth, F.col(stats)).alias("x"), "label", "weight"), "rules")
    lasso = LogisticRegression(
        featuresCol="v", weightCol="weight", elasticNetParam=1.0, regParam=LASSO, maxIter=60
    ).fit(wide.withColumn("v", array_to_vector("x")))
    weights = lasso.coefficients.toArray().tolist()
    return RuleEnsemble(
        tuple((r, w) for r, w in zip(rules, weights) if w),
        tuple((i, w) for i, w in enumerate(weights[len(rules) :]) if w),
        float(lasso.intercept),
    )


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bound: int = SAMPLE
) -> RuleEnsemble:
    """Fit on the documents that labels name (at most bound of them).

    Rows with a null id or label are left out; where an id has two labels, the
    smaller counts; a label over 0 counts as 1, any other as 0.
    """
    known = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("label_id"))
        .agg((F.min(label) > 0).cast("int").alias("label"))
    )
    known = sample_of(known, "label_id", bound)
    texts = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text"))
    # The sample has at most bound rows of two numbers: small enough to broadcast at any size of docs.
    joined = texts.join(F.broadcast(known), "label_id")
    return fit(materialize(with_statistics(joined).select("stats", "label"), "sample"))


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """docs with quality_score and quality_predicted (1 from 0.5 on).

    Null and empty texts have zero statistics and are scored like any other;
    repeated rows score alike; a text of any length is read whole; an empty table gives
    an empty result.  Columns of docs with these two names are replaced, all others stay.
    """
    stats = next(n for n in map("quality_stats_{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = with_statistics(docs, text, stats)
    rows = rows.withColumn("quality_score", model.score(stats)).drop(stats)
    return rows.withColumn("quality_predicted", (F.col("quality_score") >= 0.5).cast("int"))
