"""Joins that the engine needs by name: overlays, intervals, as-of, anchors, exact covers, patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(sources: list[DataFrame], key: str, line: str, first_wins: bool = False) -> DataFrame:
    """Union of sources in rising precedence; one row a key: the last source's last line (or the first's first)."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("prec", F.lit(n)) for n, s in enumerate(sources)])
    order = [F.col("prec"), F.col(line)] if first_wins else [F.col("prec").desc(), F.col(line).desc()]
    pick = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__n", pick).where("__n = 1").drop("__n")


def interval(points: DataFrame, at: str, ranges: list[tuple], label: str) -> DataFrame:
    """The first listed inclusive range that holds each point, as an expression: ranges are parameters, not data."""
    name = F.lit(None).cast("string")
    for lo, hi, value in reversed(ranges):
        name = F.when(F.col(at).between(F.lit(lo), F.lit(hi)), value).otherwise(name)
    return points.withColumn(label, name)


def as_of(points: DataFrame, marks: DataFrame, by: list[str], at: str, take: str, default=None) -> DataFrame:
    """For each point the value ``take`` of the latest mark at or before it, within ``by``.

    Union and a running last value: one shuffle and one sort, no inequality join.
    """
    extra = [c for c in points.columns if c not in (*by, at)]
    left = points.select(*by, at, F.lit(1).alias("__side"), *extra, F.lit(None).cast(marks.schema[take].dataType).alias("__take"))
    nulls = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra]
    right = marks.select(*by, at, F.lit(0).alias("__side"), *nulls, F.col(take).alias("__take"))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right).withColumn(take, F.coalesce(F.last("__take", ignorenulls=True).over(w), F.lit(default)))
    return rows.where("__side = 1").drop("__side", "__take")


def nth_anchor(lines: DataFrame, doc: str, text: str, anchor: str, occurrence: int) -> DataFrame:
    """The ``occurrence``-th line (from 1) equal to ``anchor`` in each document."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy("pos"))
    return lines.where(F.trim(text) == anchor).withColumn("n", n).where(F.col("n") == occurrence).drop("n")


def locate_anchor(lines: DataFrame, docs: DataFrame, doc: str, text: str, anchor: str, occurrence: int | None = None) -> DataFrame:
    """(doc, pos, error): the line equal to ``anchor`` in each of ``docs``, or why there is none.

    'missing' without such a line; 'ambiguous' for several without an ``occurrence``;
    'out of range' for an occurrence there isn't.
    """
    hits = lines.where(F.col(text) == anchor).groupBy(doc).agg(F.array_sort(F.collect_list("pos")).alias("at"))
    rows = docs.select(doc).join(hits, doc, "left").withColumn("at", F.coalesce("at", F.array().cast(hits.schema["at"].dataType)))
    n, nth = F.size("at"), 1 if occurrence is None else occurrence
    error = F.when(n == 0, "missing").when(F.lit(occurrence is None) & (n > 1), "ambiguous").when(F.lit(nth < 1) | (n < nth), "out of range")
    return rows.select(doc, F.when(error.isNull(), F.get("at", F.lit(max(0, nth - 1)))).alias("pos"), error.alias("error"))


def cover_errors(spans: DataFrame, by: str, size: Column) -> DataFrame:
    """Where half-open spans fail to tile [0, size) of their group: gaps, overlaps, both ends."""
    w = Window.partitionBy(by).orderBy("start", "end")
    rows = spans.withColumn("__size", size).withColumn("prev", F.lag("end").over(w)).withColumn("next", F.lead("start").over(w))
    kind = (
        F.when(F.col("prev").isNull() & (F.col("start") > 0), "gap at start").when(F.col("prev") < F.col("start"), "gap").when(F.col("prev") > F.col("start"), "overlap")
        .when(F.col("next").isNull() & (F.col("end") != F.col("__size")), "wrong end")
    )
    return rows.select(by, "start", "end", kind.alias("error")).where("error is not null")


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """The first of the patterns found in ``text``, unrolled so that each compiles once."""
    pick = F.lit(None).cast("string")
    for p in reversed(patterns):
        pick = F.when(text.rlike(p), p).otherwise(pick)
    return pick


def occurrences(text: Column, piece: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.greatest(F.length(piece), F.lit(1))).cast("long")


def two_sided_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, labelled missing or stray."""
    e, a = expected.select(key).distinct().withColumn("__e", F.lit(1)), actual.select(key).distinct().withColumn("__a", F.lit(1))
    both = e.join(a, key, "full_outer")
    return both.where("__e is null or __a is null").select(key, F.when(F.col("__a").isNull(), "missing").otherwise("stray").alias("state"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable from ``start`` (node) over edges (src, dst) with the least number of hops, however many."""
    from lectern.plans.cache import pinned

    seen = pinned(start.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier, k = seen, 0
    while not frontier.isEmpty():
        k += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = pinned(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        seen = pinned(seen.unionByName(frontier))  # one table, whatever the number of hops
    return seen


def chase(links: DataFrame, start: DataFrame, most: int = 20) -> DataFrame:
    """Pages along ``next`` links (url, next) from ``start`` (chain, url), ``most`` at most and none twice: (chain, url, place)."""
    from lectern.plans.cache import pinned

    seen = pinned(start.select("chain", "url").withColumn("place", F.lit(0)))
    last = seen
    for k in range(1, most):
        step = last.join(links, "url").where("next is not null and next <> ''").select("chain", F.col("next").alias("url"))
        last = pinned(step.distinct().join(seen.select("chain", "url"), ["chain", "url"], "left_anti").withColumn("place", F.lit(k)))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen


def flagged(rows: DataFrame, marks: DataFrame, key: str, name: str) -> DataFrame:
    """``name``: whether ``marks`` has the row's key."""
    hit = marks.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(hit, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
