"""Sources and sinks of documents and nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rosterlake.sources.shared import kept


def uploads(spark: SparkSession, path: str, pattern: str = "*.{pdf,docx,txt}", most_bytes: int = 10 * 1024 * 1024, stream: bool = False) -> DataFrame:
    """Uploaded files up to a size: path, length, modificationTime, content.  Spark's file source gives no row for an empty file."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if stream:
        files = files.schema("path string, modificationTime timestamp, length long, content binary")
    return files.load(path).where(F.col("length") <= most_bytes)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_records(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    rows.write.partitionBy(*(partition_by or [])).json(path)


def document_type(path: Column, text: Column, least: int = 100) -> Column:
    """How to read a document: by its extension; a PDF with enough text is text, else an image."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(extension.isin("docx", "txt"), "text")
        .when((extension == "pdf") & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= least), "text")
        .when(extension.isin("pdf", "png", "jpg", "jpeg"), "image")
        .otherwise("unsupported")
    )


def nest(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """parent with one array of structs per child table, sorted by the given columns; empty without rows."""
    out = parent
    for name, (child, order) in children.items():
        fields = [*order, *[c for c in child.columns if c != key and c not in order]]
        lists = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        empty = F.array().cast(lists.schema[name].dataType)
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))
    return out


def nest_pages(child: DataFrame, key: str, order: list[str], size: int, name: str = "items", parts: int | None = None) -> DataFrame:
    """key, page (from 0) and an array of at most size structs: each key's rows in the given order, cut in pages.

    For parents whose children are too many for one row.  Rows are dealt out in ranges of
    key and order, so that a key with most of the rows fills many tasks; each range counts
    its rows of a key, the counts give the number of rows before it, and no task sorts
    more than a range.  Rows without a key are left out.
    """
    fields = [*order, *[c for c in child.columns if c != key and c not in order]]
    rows = child.where(F.col(key).isNotNull()).select(key, *fields)
    dealt = rows.repartitionByRange(parts, key, *fields) if parts else rows.repartitionByRange(key, *fields)
    dealt = kept(dealt.withColumn("page_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(key, "page_range").agg(F.count("*").alias("n"))
    along = Window.partitionBy(key).orderBy("page_range")  # a row for each range that has the key
    before = counts.select(key, "page_range", (F.sum("n").over(along) - F.col("n")).alias("page_before"))
    place = F.row_number().over(Window.partitionBy(key, "page_range").orderBy(*fields)) - 1
    placed = dealt.withColumn("page_place", place).join(before, [key, "page_range"])
    page = F.floor((F.col("page_before") + F.col("page_place")) / size).alias("page")
    return placed.select(key, page, F.struct(*fields).alias("item")).groupBy(key, "page").agg(F.sort_array(F.collect_list("item")).alias(name))


def unnest(nested: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of one array of structs, with the key."""
    return nested.select(key, F.inline(name))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows of several tables side by side."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.union, parts)


def output_rows(rows: DataFrame) -> DataFrame:
    """One JSON text per row: value.  Decimals become numbers, bytes UTF-8 text, dates and times ISO; nulls are written."""
    plain = {"decimal": lambda c: c.cast("double"), "binary": lambda c: F.decode(c, "UTF-8")}
    kept = [plain.get(f.dataType.typeName(), lambda c: c)(F.col(f.name)).alias(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("value"))
