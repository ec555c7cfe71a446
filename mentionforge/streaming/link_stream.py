"""Linking and run logs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.anchors import index_once
from ..operators.safety import redact
from ..plans.linking import link_contains
from ..sources import store

#: Runs of ids that are merged into one.
FAN = 16


def link_stream(queries: DataFrame, snapshot: Callable[[str | None], tuple[DataFrame, DataFrame, str]], path: str, checkpoint: str) -> StreamingQuery:
    """Links each micro-batch of a query stream by containment and appends the results to ``path``.

    ``snapshot(None)`` gives the current (words, entities, data_version) and ``snapshot(version)``
    that version's. A batch's version is written beside the checkpoint, once, before the batch is worked
    on, so a batch that is retried sees the version of its first attempt, whatever was
    published meanwhile. A version's anchors are built once, for all its batches. The version goes with the rows. A retried batch replaces its own directory, so results are there once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, pin = rows.sparkSession, f"{checkpoint}-versions/{number}"
        pinned = store.read_small(spark, pin)
        words, entities, version = snapshot(pinned or None)
        if not pinned:
            store.create_once(spark, pin, version)
        index = index_once(words, "normalized_key", f"{checkpoint}-anchors", version)
        out = link_contains(rows, words, entities, index=index).withColumn("data_version", F.lit(version))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_records(results: DataFrame, mode: str = "offline") -> DataFrame:
    """A run record for each linking result: id, mode, time, result; redacted."""
    return redact(results.withColumns({"run_id": F.expr("uuid()"), "mode": F.lit(mode), "created_at": F.current_timestamp()}))


def append_runs(results: DataFrame, path: str, mode: str = "offline") -> None:
    """Appends run records as JSON lines."""
    run_records(results, mode).write.mode("append").json(path)


def seen_runs(number: int) -> list[tuple[int, int]]:
    """(first batch, batches) of the ledger's runs that hold the ids of all batches before ``number``: at most
    ``FAN - 1`` of each power of ``FAN``, the longest first."""
    runs, first = [], 0
    size = 1
    while size * FAN <= number:
        size *= FAN
    while size:
        for _ in range((number - first) // size):
            runs.append((first, size))
            first += size
        size //= FAN
    return runs


def _merged(number: int) -> list[tuple[int, int]]:
    """The runs that end with batch ``number - 1``, shorter ones first, but for the batch's own."""
    sizes, size = [], FAN
    while number and number % size == 0:
        sizes.append((number - size, size))
        size *= FAN
    return sizes


def _run(ledger: str, first: int, size: int) -> str:
    return f"{ledger}/run-{first}-{size}"


def run_log_stream(results: DataFrame, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Appends the run records of a stream of results (query_id, ts, ...), each query_id once for ever.

    Keyed state drops what repeats within ``delay`` and forgets an id ``delay`` after its event time, so its size follows
    the ids of that span alone; a row more than ``delay`` behind the stream is late and dropped, as with any
    watermark. Ids that return later are told by a ledger beside the checkpoint: each batch anti-joins the ids of
    all batches before it and notes those that are new. ``FAN`` runs of ids are merged into one of the next size, so a batch reads
    few files and an id is rewritten once a power of ``FAN``. A retried batch replaces its rows and its runs, and
    reads only runs that earlier batches wrote, which stay until it is done. Null ids are one id.
    """
    schema = T.StructType([results.schema["query_id"]])

    def ids(spark: SparkSession, runs: list[tuple[int, int]], ledger: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*(_run(ledger, *r) for r in runs)) if runs else spark.createDataFrame([], schema)

    def batch(rows: DataFrame, number: int) -> None:
        spark, ledger = rows.sparkSession, f"{checkpoint}-ids"
        for first, size in _merged(number):  # the batch before is done, so what it merged isn't read again
            for k in range(FAN):
                store.remove(spark, _run(ledger, first + k * (size // FAN), size // FAN))
        known = ids(spark, seen_runs(number), ledger).select(F.col("query_id").alias("_seen"))
        # two tables are written from one run of the stateful plan
        fresh = rows.join(known, F.col("query_id").eqNullSafe(F.col("_seen")), "left_anti").persist()
        try:
            redact(fresh).write.mode("overwrite").json(f"{path}/batch={number}")
            fresh.select("query_id").write.mode("overwrite").parquet(_run(ledger, number, 1))
        finally:
            fresh.unpersist()
        for first, size in _merged(number + 1):
            parts = [(first + k * (size // FAN), size // FAN) for k in range(FAN)]
            ids(spark, parts, ledger).write.mode("overwrite").parquet(_run(ledger, first, size))

    once = results.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["query_id"])
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
