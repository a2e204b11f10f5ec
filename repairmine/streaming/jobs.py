"""Structured Streaming forms of the incremental jobs.

Input is a file stream over the files of a table; every micro-batch goes
through ``foreachBatch`` into a result table with one folder a batch. What is
known of a key lies in the query's state store, so a batch costs what its own
rows cost, whatever came before it, and never reads the result table. A batch
replaces its own folder, and the store keeps a version for every batch, so a
batch that is replayed after a restart writes the same rows again instead of
further ones. State goes to RocksDB unless the session names another store:
keys are then bounded by the executors' disks, not their memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repairmine.session import materialize, scratch_path
from repairmine.sources.sinks import first_per_id


def split_files(spark: SparkSession, sf_dir: str, name: str, key: str, files: int = 4) -> str:
    """The table as several files (a landing folder), so that a stream over
    it runs several micro-batches."""
    path = scratch_path(spark, f"landing-{name}-{uuid.uuid4().hex}")
    spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").repartition(files, key).write.parquet(path)
    return path


def table_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream over the files of a folder."""
    return (spark.readStream.schema(spark.read.parquet(folder).schema)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(stream: DataFrame, handler, name: str, checkpoint: str | None, mode: str, available_now: bool):
    """``handler(batch_df, batch_id)`` over a stream; the checkpoint lies in
    the shared folder (a fresh one unless given)."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    if before is None or before.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, ROCKSDB)
    ckpt = checkpoint or scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex}")
    w = stream.writeStream.foreachBatch(handler).outputMode(mode).option("checkpointLocation", ckpt)
    try:
        return (w.trigger(availableNow=True) if available_now else w).start(), ckpt
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def run_to_table(stream: DataFrame, handler, name: str, checkpoint: str | None = None, mode: str = "append") -> str:
    """Run over everything that is available now; the checkpoint's path."""
    q, ckpt = start(stream, handler, name, checkpoint, mode, available_now=True)
    q.awaitTermination()
    return ckpt


def first_rows(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key by ``order`` as a keyed aggregate (run
    it in update mode: a batch brings the keys that it holds, with the first
    of all their rows so far)."""
    rest = [c for c in stream.columns if c not in order and c != key]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    return stream.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, "_row.*")


def stream_insert_ignore(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """The earliest event per key, whatever batch brings it. A key's rows
    in the result table only move forward in the order, so its first is it."""
    out = scratch_path(spark, f"first_per_{key}-{uuid.uuid4().hex}")
    order = ["ts", "event_id"]
    events = table_stream(spark, split_files(spark, sf_dir, "events", "event_id"))
    run_to_table(first_rows(events, key, order), lambda batch, bid: write_batch(batch, out, bid), "insert_ignore", mode="update")
    return first_per_id(spark.read.parquet(out), [F.col(c) for c in order], key)


def new_rows(stream: DataFrame, key: str, done: DataFrame, done_by: list[str]) -> DataFrame:
    """R2: rows whose ``done_by`` is not in ``done``, the first to come of
    every ``key`` (the keys are state)."""
    return stream.join(done, done_by, "left_anti").dropDuplicates([key])


def stream_skip_done(spark: SparkSession, sf_dir: str, done: DataFrame, keys=("user_id", "day")) -> DataFrame:
    """R2: only rows whose key is not done yet are processed; processed rows
    are appended by id."""
    out = scratch_path(spark, f"processed-{uuid.uuid4().hex}")
    done_keys = materialize(spark, done.select(*keys).distinct(), "done")
    events = table_stream(spark, split_files(spark, sf_dir, "events", "event_id")).withColumn("day", F.to_date("ts"))
    run_to_table(new_rows(events, "event_id", done_keys, list(keys)), lambda batch, bid: write_batch(batch, out, bid), "skip_done")
    return spark.read.parquet(out)


def retry_loop(spark: SparkSession, items: str, key: str, check: Callable[[DataFrame], DataFrame], cap: int,
               checkpoint: str | None = None, files_per_trigger: int = 1) -> tuple[str, str]:
    """A stream over the files of ``items`` and over its own retry table.

    ``check`` adds ``ok`` (null: no verdict yet) to rows of the items'
    columns and ``try_count``. A row that fails goes to the retry table with
    one more try and comes back with the next micro-batch, until it succeeds
    (``done``), has failed ``cap`` times (``failed``) or gets no verdict
    (``waiting``). Returns the folders of ended rows (``key, try_count,
    outcome``) and of all tries (``key, try_count, ok``), a folder a batch.
    The query runs until both sources are used up.
    """
    base = checkpoint or scratch_path(spark, f"retry-{uuid.uuid4().hex}")
    ended, tried, again = f"{base}/ended", f"{base}/tried", f"{base}/again"
    fresh = table_stream(spark, items, files_per_trigger).withColumn("try_count", F.lit(0))
    spark.createDataFrame([], fresh.schema).write.mode("append").parquet(f"{again}/start")
    back = spark.readStream.schema(fresh.schema).option("recursiveFileLookup", "true").parquet(again)

    def handle(batch: DataFrame, bid: int) -> None:
        judged = materialize(spark, check(batch), "judged")
        tries = F.col("try_count") + F.when(F.col("ok"), 0).when(F.col("ok").isNull(), 0).otherwise(1)
        judged = judged.withColumn("tries", tries)
        back_again = (F.col("tries") > F.col("try_count")) & (F.col("tries") < cap)
        outcome = F.when(F.col("ok"), "done").when(F.col("ok").isNull(), "waiting").otherwise("failed")
        write_batch(judged.where(~back_again).select(key, F.col("tries").alias("try_count"), outcome.alias("outcome")), ended, bid)
        write_batch(judged.select(key, "try_count", "ok"), tried, bid)
        repeat = judged.where(back_again).withColumn("try_count", F.col("tries")).select(*fresh.columns)
        if not repeat.isEmpty():  # the last of the three: nothing comes back from an unfinished batch
            repeat.write.mode("overwrite").parquet(f"{again}/batch-{bid}")

    q, _ = start(fresh.unionByName(back), handle, "retry", f"{base}/log", "append", available_now=False)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return ended, tried


def verdict_check(attempts: DataFrame, key: str, order: list[str], ok, cap: int) -> Callable[[DataFrame], DataFrame]:
    """A check that takes the verdict of a row's n-th try from a table of
    attempts (its n-th row of the key by ``order``; ``ok``: its verdict)."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    told = attempts.select(key, ok.alias("ok"), (nth - 1).alias("try_count")).where(F.col("try_count") < cap)
    told = materialize(attempts.sparkSession, told, "verdicts")
    return lambda batch: batch.join(told, [key, "try_count"], "left")


def user_retries(spark: SparkSession, sf_dir: str, cap: int) -> tuple[str, str]:
    """The retry loop over users: every user with an attempt is one item, and
    its tries are its ``error`` (failed) and ``purchase`` (ok) events in order."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    tried = events.where(F.col("event_type").isin("error", "purchase") & F.col("user_id").isNotNull())
    items = scratch_path(spark, f"items-{uuid.uuid4().hex}")
    tried.select("user_id").distinct().repartition(4, "user_id").write.parquet(items)
    return retry_loop(spark, items, "user_id", verdict_check(
        tried, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", cap), cap)


def stream_retry(spark: SparkSession, sf_dir: str, cap: int = 3) -> DataFrame:
    """``user_id, try_count, outcome`` (done / failed / waiting)."""
    return spark.read.parquet(user_retries(spark, sf_dir, cap)[0]).select("user_id", "try_count", "outcome")


def stream_retry_totals(spark: SparkSession, sf_dir: str, cap: int = 3) -> DataFrame:
    """R4 over the loop: rows read for the first time, repeats, and ends."""
    ended, tried = user_retries(spark, sf_dir, cap)
    kind = F.when(F.col("try_count") == 0, "read").otherwise("repeat")
    return spark.read.parquet(tried).select(kind.alias("outcome")).unionByName(
        spark.read.parquet(ended).select("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of read rows and of the attempts' verdicts as a
    streaming aggregation in complete mode, written per batch."""
    out = scratch_path(spark, f"totals-{uuid.uuid4().hex}")
    verdict = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    ev = table_stream(spark, split_files(spark, sf_dir, "events", "event_id"))
    counts = (ev.select(F.explode(F.filter(F.array(F.lit("read"), verdict), lambda x: x.isNotNull())).alias("outcome"))
              .groupBy("outcome").agg(F.count("*").alias("n")))

    def handle(batch: DataFrame, bid: int) -> None:
        batch.write.mode("overwrite").parquet(out)
    run_to_table(counts, handle, "totals", mode="complete")
    return spark.read.parquet(out)
