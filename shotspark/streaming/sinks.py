"""Typed rows and dead letters of a message stream, each exactly once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shotspark.sources.envelopes import read_envelopes
from shotspark.sources.files import dead_letters


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def batch_writer(
    path: str, schema: T.StructType | str, *, worker: str, event_type: str | None = None, required: Sequence[str] = ()
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that parses envelopes and writes them under ``path``.

    Envelopes carry ``source_stream, source_event_id, event_type, payload``.  Those that parse go to
    ``rows/batch=<id>`` as typed columns, the others to ``dead_letters/batch=<id>``, and
    ``commits/batch=<id>`` is written last.  A batch that runs again replaces what it had
    left, and one that was committed is skipped, so a restart leaves no second copy and no
    half: readers only see committed batches.  One query writes to one ``path``.
    """

    def write(messages: DataFrame, batch: int) -> None:
        spark = messages.sparkSession
        commit = f"{path}/commits/batch={batch}"
        if _exists(spark, f"{commit}/_SUCCESS"):
            return
        parsed = read_envelopes(messages.withColumn("__payload", F.col("payload")), schema, event_type, required).persist()
        try:
            good = parsed.where("error is null").drop("error", "__payload")
            good.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
            bad = parsed.where("error is not null").select(
                "source_stream", "source_event_id", F.lit(worker).alias("worker"), "error", F.col("__payload").alias("payload")
            )
            dead_letters(bad).write.mode("overwrite").json(f"{path}/dead_letters/batch={batch}")
            counts = parsed.agg(F.count_if(F.col("error").isNull()).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("dead_letters"))
            counts.coalesce(1).write.mode("overwrite").parquet(commit)
        finally:
            parsed.unpersist()

    return write


def deliver_once(
    envelopes: DataFrame, path: str, checkpoint: str, schema: T.StructType | str, *, worker: str,
    event_type: str | None = None, required: Sequence[str] = (), available_now: bool = False,
) -> StreamingQuery:
    """Start a query that writes every envelope of the stream once, as :func:`batch_writer` does."""
    writer = envelopes.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(batch_writer(path, schema, worker=worker, event_type=event_type, required=required)).start()


def delivered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The committed rows and dead letters under ``path``, each with its ``batch``."""
    commits = spark.read.parquet(f"{path}/commits").select("batch")
    letter = "source_stream STRING, source_event_id STRING, worker STRING, error STRING, payload STRING, batch INT"
    return (
        spark.read.parquet(f"{path}/rows").join(commits, "batch", "left_semi"),
        spark.read.schema(letter).json(f"{path}/dead_letters").join(commits, "batch", "left_semi"),
    )
