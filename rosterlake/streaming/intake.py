"""New files handed over to the parse step, as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.sources.files import document_type

#: What follows for each type of document.
NEXT = {"text": "parse", "image": "read_image", "unsupported": "failed"}


def routed(files: DataFrame, text: Column | None = None) -> DataFrame:
    """correlation_id, path, kind, next_step, text of each file (as sources.files.uploads gives them).

    text: what was extracted; without it the content is read as UTF-8 if the extension
    is txt.  The id follows from path and time of change, so that a file read again has
    the same one.
    """
    if text is None:
        text = F.when(F.lower("path").endswith(".txt"), F.decode("content", "UTF-8"))
    identity = F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string")), 256)
    read = files.select(F.substring(identity, 1, 32).alias("correlation_id"), "path", text.alias("text"))
    kind = document_type(F.col("path"), F.col("text"))
    steps = F.create_map(*[F.lit(x) for pair in NEXT.items() for x in pair])
    return read.select("correlation_id", "path", kind.alias("kind"), F.element_at(steps, kind).alias("next_step"), "text")


def hand_over(files: DataFrame, queue: str, checkpoint: str, parse: Callable[[DataFrame, int], None], text: Column | None = None) -> None:
    """Runs what has arrived: each micro-batch is written to queue, then its rows for the parse step go to parse(rows, batch).

    A batch that is run again after a failure overwrites its own folder and comes with
    the same number, by which parse can tell it.
    """

    def step(batch: DataFrame, number: int) -> None:
        folder = f"{queue}/batch={number}"
        routed(batch, text).write.mode("overwrite").parquet(folder)
        written = batch.sparkSession.read.parquet(folder)
        parse(written.where(F.col("next_step") == "parse"), number)

    files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
