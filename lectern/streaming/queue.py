"""Structured Streaming: whitelisted updates, delivery queue state, draining."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UPDATE = "update_id long, from_id long, chat_id long, kind string, payload string, item string"
ITEM = "struct<item:string,payload:string>"


def updates(spark: SparkSession, folder: str, schema: str = UPDATE, files_per_batch: int = 1) -> DataFrame:
    """Updates as files of JSON lines; offsets live in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def whitelisted(rows: DataFrame, owner: int) -> DataFrame:
    """Only the owner's updates, in the owner's chat or in none: before any other operator."""
    return rows.where((F.col("from_id") == owner) & (F.col("chat_id").isNull() | (F.col("chat_id") == owner)))


def queue_sizes(rows: DataFrame) -> DataFrame:
    """Per owner the queue after each batch: 'add' appends an item, 'remove' takes out the item its payload names, 'clear' empties it.

    An item's id is ``item``, or its payload where none is given; equal payloads under
    different ids are different items. All of a batch's updates are applied in the order of
    their ids, however the batch is cut.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items = [tuple(i) for i in state.get[0]] if state.exists else []
        every = pd.concat(list(batches)).sort_values("update_id")
        for kind, payload, item in every[["kind", "payload", "item"]].itertuples(index=False):
            if kind == "add":
                items.append((payload if item is None else item, payload))
            elif kind == "remove":
                items = [i for i in items if i[0] != payload]
            elif kind == "clear":
                items = []
        state.update((items,))
        yield pd.DataFrame({"owner": [key[0]], "items": [[p for _, p in items]], "n": [len(items)]})

    if "item" not in rows.columns:
        rows = rows.withColumn("item", F.lit(None).cast("string"))
    return rows.groupBy("from_id").applyInPandasWithState(fold, "owner long, items array<string>, n long", f"items array<{ITEM}>", "update", GroupStateTimeout.NoTimeout)


def pending_slot(rows: DataFrame) -> DataFrame:
    """Per owner the question that a text answers: 'ask' sets the slot, 'text' reads and clears it, 'cancel' clears it.

    Rows: owner, update_id, question (null: nothing was asked), payload; one for each text.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked = state.get[0] if state.exists else None
        out = []
        for kind, payload, n in pd.concat(list(batches)).sort_values("update_id")[["kind", "payload", "update_id"]].itertuples(index=False):
            if kind == "ask":
                asked = payload
            elif kind == "text":
                out.append((key[0], n, asked, payload))
                asked = None
            elif kind == "cancel":
                asked = None
        state.update((asked,))
        yield pd.DataFrame(out, columns=["owner", "update_id", "question", "payload"])

    return rows.groupBy("from_id").applyInPandasWithState(fold, "owner long, update_id long, question string, payload string", "question string", "append", GroupStateTimeout.NoTimeout)


def admitted(rows: DataFrame, most: int, limit: int = 20 * 1024 * 1024) -> DataFrame:
    """``rows`` (size) with ``admitted``: whether a file fits the configured size and the transport's."""
    return rows.withColumn("admitted", F.coalesce(F.col("size") <= min(most, limit), F.lit(True)))


def windowed_counts(events: DataFrame, at: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time counts with a watermark (an extension: the batch tools only know processing time)."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), kind).agg(F.count("*").alias("n"))


def deliver_once(batch: DataFrame, epoch: int, deliver, results_path: str, key: str | None = None) -> None:
    """Deliver what the ledger at ``results_path`` doesn't have for this epoch, and write its result rows there.

    The ledger has a folder for each epoch, so only that one is read. With ``key``, items are told apart by that column,
    which the results must have: those with a row in the ledger aren't delivered again, and an item that a batch repeats is
    delivered once. Without it an epoch with a complete folder is left alone as a whole.
    """
    spark = batch.sparkSession
    folder = f"{results_path.rstrip('/')}/epoch={epoch}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        if key is None:
            return
        batch = batch.join(spark.read.parquet(folder).select(key).distinct(), key, "left_anti")
    if key is not None:
        batch = batch.dropDuplicates([key])
        if batch.isEmpty():
            return
    deliver(batch).write.mode("append" if key else "overwrite").parquet(folder)


def drain_batches(rows: DataFrame, deliver, results_path: str, checkpoint: str, key: str | None = None):
    """Deliver each batch and record a result row for each item; a failure of one doesn't stop the others.

    A batch that is run again after a failure is delivered once: see deliver_once(). The results have a column ``epoch``.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        deliver_once(batch, epoch, deliver, results_path, key)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
