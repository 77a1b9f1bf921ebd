"""A keyed table of which an update rewrites only the buckets that its keys fall into.

data/batch=N/bucket=B holds bucket B as it was after batch N; commits/batch=N, written
last, lists the buckets of the batch.  A bucket is read from the last batch that has it.
Files are never changed, so readers see a whole state, and a batch that runs again after a
failure starts from the state before it and gives the same one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterlake.operators.writing import upsert


class BucketedTable:
    """keys and their columns in the folder path; schema: of the whole row, as DDL; buckets: how many folders the keys are dealt to."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> the batch (below before) that wrote it last."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
            return {}
        told = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/commits")
        told = told if before is None else told.where(F.col("batch") < before)
        return {r.bucket: r.batch for r in told.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The state after the last batch, or the last one below before; only: of these buckets."""
        by_batch: dict[int, list[int]] = {}
        for bucket, batch in self.versions(before).items():
            if only is None or bucket in only:
                by_batch.setdefault(batch, []).append(bucket)
        empty = self.spark.createDataFrame([], self.schema)
        if not by_batch:
            return empty
        rows = self.spark.read.schema(f"{self.schema}, batch long, bucket int").parquet(f"{self.path}/data")
        current = reduce(lambda a, b: a | b, ((F.col("batch") == n) & F.col("bucket").isin(b) for n, b in by_batch.items()))
        return rows.where(current).select(empty.columns)

    def _put(self, made: DataFrame, touched: DataFrame, batch: int) -> None:
        rows = self._bucketed(made).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        touched.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    def upsert(self, new: DataFrame, rules: dict[str, str], batch: int) -> None:
        """writing.upsert of new, one row a key, with a batch number greater than all before; the same batch again gives the same state."""
        touched = self._bucketed(new).select("bucket").distinct()
        buckets = [r.bucket for r in touched.collect()]  # no more than there are buckets
        held = self.read(before=batch, only=buckets)
        columns = self.spark.createDataFrame([], self.schema).columns
        self._put(upsert(held, new, self.keys, rules).select(columns), touched, batch)

    def merge(self, new: DataFrame, columns: dict[str, Column], batch: int) -> None:
        """What the table has and new, which may repeat a key, grouped by key; columns: name -> aggregate over both."""
        touched = self._bucketed(new).select("bucket").distinct()
        held = self.read(before=batch, only=[r.bucket for r in touched.collect()])
        made = held.unionByName(new.select(held.columns)).groupBy(*self.keys).agg(*[c.alias(n) for n, c in columns.items()])
        self._put(made.select(held.columns), touched, batch)

    def replace(self, parents: DataFrame, new: DataFrame, key: str, batch: int) -> None:
        """The rows of new in place of all that the table has of the parents' keys; key alone decides the bucket (keys = [key])."""
        touched = self._bucketed(parents.select(key).union(new.select(key))).select("bucket").distinct()
        buckets = [r.bucket for r in touched.collect()]
        gone = parents.select(key).union(new.select(key)).distinct()
        stay = self.read(before=batch, only=buckets).join(gone, key, "left_anti")
        self._put(stay.unionByName(new.select(stay.columns)), touched, batch)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last keep states reads; returns how many."""
        told = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/commits")
        last = sorted({r.batch for r in told.select("batch").distinct().collect()})[-keep:]
        used = {(v, b) for n in last for b, v in self.versions(before=n + 1).items()}
        jvm, deleted = self.spark._jvm, 0
        files = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for folder in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/batch=*/bucket=*")):
            at = folder.getPath()
            if (int(at.getParent().getName().split("=")[1]), int(at.getName().split("=")[1])) not in used:
                deleted += bool(files.delete(at, True))
        return deleted
