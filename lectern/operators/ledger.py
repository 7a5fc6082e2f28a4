"""Queues, ledgers and caches as tables: each operation maps the state to a new state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drain(queue: DataFrame, results: DataFrame) -> DataFrame:
    """What stays queued after a delivery: all but the names that landed. Without results everything stays."""
    landed = results.where("ok").select("name").distinct()
    return queue.join(landed, "name", "left_anti")


def split_live(queue: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """``state``: live if the path is present, else missing."""
    return queue.join(present.select(key).distinct().withColumn("__p", F.lit(1)), key, "left").withColumn("state", F.when(F.col("__p").isNotNull(), "live").otherwise("missing")).drop("__p")


def introduce(words: DataFrame, introduced: DataFrame) -> DataFrame:
    """Words not introduced before, in order of first mention: (word, first_pos)."""
    return words.join(introduced.select("word").distinct(), "word", "left_anti").groupBy("word").agg(F.min("pos").alias("first_pos"))


def latest(values: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Key-value state: the last write wins."""
    return values.groupBy(key).agg(F.max_by(value, at).alias(value))


def newest(tokens: DataFrame, by: list[str], seq: str, most: int) -> DataFrame:
    """A first-in-first-out cache: the ``most`` newest of each owner. The limit is applied before the shuffle too."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(seq).desc()))
    return tokens.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def prior(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """All earlier texts of a group, in order: the story so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("so_far", F.array_join(F.collect_list(text).over(w), " / "))


def first_mentions(tokens: DataFrame, by: str, word: str, pos: str) -> DataFrame:
    """Only the first token instance of each word in a group."""
    n = F.row_number().over(Window.partitionBy(by, word).orderBy(pos))
    return tokens.withColumn("__n", n).where("__n = 1").drop("__n")


def toggle(selected, other):
    """Symmetric difference of two selections (array columns)."""
    return F.array_sort(F.array_union(F.array_except(selected, other), F.array_except(other, selected)))


def remove_ids(queue: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The queue without the items of the given ids; equal names under other ids stay."""
    return queue.join(ids.select(key).distinct(), key, "left_anti")


def fresh(scan: DataFrame, memo: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a memo keyed by (path, mtime, size) already knows of a scan, and the rows that must be read anew."""
    known = scan.join(memo, keys)
    return known, scan.join(memo.select(*keys).distinct(), keys, "left_anti")


def stale_handles(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``asked`` with ``answer``: 'ok' for a handle that is known, 'stale' for one that isn't any more."""
    hit = known.select(key).distinct().withColumn("__k", F.lit(True))
    return asked.join(hit, key, "left").withColumn("answer", F.when(F.col("__k"), "ok").otherwise("stale")).drop("__k")


def select_more(selected, other):
    """Union and difference of two selections (array columns)."""
    return F.array_sort(F.array_union(selected, other)), F.array_sort(F.array_except(selected, other))


def ordered_distinct(values):
    """An array's values in the order of their first places, each once."""
    return F.array_distinct(values)


def expired(views: DataFrame, at: str, now, seconds: float) -> DataFrame:
    """Views (with the time ``at`` of their last refresh, null for none) that are due again."""
    return views.where(F.col(at).isNull() | (now - F.col(at) > seconds))


def rework(attempts: DataFrame, by: str, cap: int) -> DataFrame:
    """(by, attempts, outcome) of bounded reworking: a chapter is validated cap + 1 times at most and accepted at its first pass.

    ``attempts``: by, attempt (from 1), passed. 'pending' where neither a pass nor the cap is reached.
    """
    seen = attempts.where(F.col("attempt") <= cap + 1)
    first = F.min(F.when(F.col("passed"), F.col("attempt")))
    out = seen.groupBy(by).agg(first.alias("first"), F.max("attempt").alias("last"))
    outcome = F.when(F.col("first").isNotNull(), "accepted").when(F.col("last") >= cap + 1, "gave up").otherwise("pending")
    return out.select(by, F.coalesce("first", "last").alias("attempts"), outcome.alias("outcome"))


def in_rows(buttons: DataFrame, by: list[str], order: str, width: int = 5) -> DataFrame:
    """``buttons`` with ``button_row`` and ``button_col`` (from 0), ``width`` to a row."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return buttons.withColumn("button_row", F.floor(place / width).cast("int")).withColumn("button_col", (place % width).cast("int"))


def choose_folder(present: DataFrame, preferred: str, fallback: str) -> DataFrame:
    """(host, folder): the fallback folder only where it already holds bitmaps, else the preferred one. ``present``: host, folder, name."""
    held = F.bool_or((F.col("folder") == fallback) & F.lower("name").endswith(".bmp"))
    return present.groupBy("host").agg(F.when(held, fallback).otherwise(preferred).alias("folder"))


def option_index(options, label):
    """The index (from 0) of a label among a setting's options; null for none."""
    at = F.array_position(options, label)
    return F.when(at > 0, at - 1)
