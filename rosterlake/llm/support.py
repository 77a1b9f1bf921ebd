"""Helpers that several operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one if Spark runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="rosterlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there.

    The table survives lost executors, keeps column pruning, and joins over it
    get exchanges of their own, which adaptive execution can split when skewed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, within: str, keep: list[DataFrame] = ()) -> None:
    """Delete the tables in the folder within that df reads, but for those that keep reads: nothing reads them any more."""
    folders = lambda d: {f.rsplit("/", 1)[0] for f in d.inputFiles()}
    name = within.rstrip("/").rsplit("/", 1)[1]
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in folders(df) - set().union(*map(folders, keep)):
        if f"/{name}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def text_of(column: str | Column) -> Column:
    """The text, a null counted as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node.

    Alternates the large-star and small-star steps, each a grouped minimum joined
    back to the edges, until the edges stay the same; the number of rounds grows
    with the logarithm of the component size, not with its diameter.  No
    neighbour list is ever gathered.  Nodes without an edge are not returned.
    """

    folder = f"{shared_dir(edges.sparkSession)}/components-{uuid.uuid4().hex}"

    def written(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def lowest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        lows = written(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        return lows, pairs.join(lows, "u")

    def state(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = state(now)
    while True:
        both = written(now.union(now.select("v", "u")))
        low, joined = lowest(both)
        large = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct())
        least, small = lowest(large)
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        before, now = now, written(small)
        for table in (before, both, low, large, least):
            discard(table, folder)
        after = state(now)
        if after == seen:
            break
        seen = after
    # A star now: every node but the roots has one edge, to its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
