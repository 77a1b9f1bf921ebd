"""The operators over the driver's tables, as the contracts fix their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlake.llm import (
    byte_bpe,
    embedding_dedup,
    exact_dedup,
    html_text,
    language_id,
    language_model,
    mixing,
    periodic_runs,
    quality,
    simhash,
    toxicity,
    url_filter,
    whitening,
)
from rosterlake.llm.url_filter import UrlRule
from rosterlake.llm.support import WORD_REGEX, fold, materialize, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# The rules of the contract.
URL_RULES = [
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
]


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.RuleEnsemble:
    """Labels of the rows with crc32(doc_id) mod 3 = 1 are never learned from."""
    return quality.train(docs, labels.where(fold("doc_id", 3) != 1))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows with crc32(doc_id) mod 5 = 0 are never learned from."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", *(F.col(f"url_{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once, for their sizes; ids, sources and sizes are all that is mixed."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words("text").alias("size"))
    mixed = mixing.mix(materialize(sized, "sizes"), size="size")
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_predicted").alias("predicted"),
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(
        byte_bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) mod 10 = 0, the words from a place on repeat with a period, both of which the crc gives.

    A null id leaves the text as it is.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(crc % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_REGEX), F.lit(0)))
    numbered = docs.select("doc_id", "text", words.alias("words"), F.floor(crc / 10).alias("g"))
    n = F.size("words")
    placed = numbered.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    again = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", a + (i - a) % p)))
    return placed.select("doc_id", F.when(a.isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")), keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.withColumn("longest", longest)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.before")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.shorter")).alias("period"),
        F.expr("1000 * longest.length div -longest.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with crc32(doc_id) mod 3 = 1 are never learned from."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    found = language_id.predict(docs, language_id.train(docs.where(~held_out)), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where a long does not hold it."""
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_url_filter": op2_url_filter,
        "op3_simhash": op3_simhash,
        "op4_mixing": op4_mixing,
        "op5_html_text": op5_html_text,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_quality": op7_quality,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_language_model": op9_language_model,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_language_id": op12_language_id,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.oracle_sql(URL_RULES),
        "op4_mixing": mixing.oracle_sql(),
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    }
