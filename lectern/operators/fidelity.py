"""How much of a text survives: character ratio, n-gram containment, edit bounds."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lectern.functions import fixed
from lectern.functions import text as T


def word_ngrams(text: Column, n: int = 5) -> Column:
    """Hashes of the distinct n-grams of white-space-divided words; none for a shorter text.

    The words are found once for each row and windows are hashed from them, so the work
    is linear in the text; equal 64-bit hashes stand for equal grams.
    """
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[w[i + k] for k in range(n)]))
    return T.bound(T.words_of(text), lambda w: F.when(F.size(w) >= n, F.array_distinct(windows(w))).otherwise(F.array().cast("array<bigint>")))


def char_ratio(before: Column, after: Column) -> Column:
    a, b = F.length(T.no_space(before)), F.length(T.no_space(after))
    return F.when(a > 0, b / a).otherwise(1.0)


def containment(before: Column, after: Column, n: int = 5) -> Column:
    """Share of the distinct grams of ``before`` that ``after`` holds; 1.0 without any."""
    both = F.struct(word_ngrams(before, n).alias("a"), word_ngrams(after, n).alias("b"))
    return T.bound(both, lambda g: F.when(F.size(g["a"]) > 0, F.size(F.array_intersect(g["a"], g["b"])) / F.size(g["a"])).otherwise(1.0))


def gate(ratio: Column, held: Column) -> Column:
    return ratio.between(0.98, 1.02) & (held >= 0.995)


def overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: int = 5, n: int = 5) -> DataFrame:
    """Pairs that share at least ``least`` distinct grams, by a join on the gram: no pair is made without one."""
    l = left.select(left_key, F.explode(word_ngrams(F.col("text"), n)).alias("gram"))
    r = right.select(right_key, F.explode(word_ngrams(F.col("text"), n)).alias("gram"))
    return l.join(r, "gram").groupBy(left_key, right_key).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


@F.pandas_udf(StructType([StructField(n, LongType()) for n in ("edits", "changed", "longest", "growth")]))
def edit_measures(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Longest-match edit script: edits, changed characters, longest span, net growth."""
    out = []
    for a, b in zip(before.fillna(""), after.fillna(""), strict=True):
        spans = [(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]
        sizes = [max(x) for x in spans]
        out.append((len(spans), sum(sizes), max(sizes, default=0), len(b) - len(a)))
    return pd.DataFrame(out, columns=["edits", "changed", "longest", "growth"])


def changed_ratio(size: Column, m: Column) -> Column:
    """Changed characters as a share of four places; halfway decimals go to the even digit."""
    return F.bround(m["changed"] / F.greatest(size, F.lit(1)), 4)


def growth_ratio(size: Column, m: Column) -> Column:
    """Net growth or loss, as a share."""
    return F.bround(F.abs(m["growth"]) / F.greatest(size, F.lit(1)), 4)


def edit_bounds(size: Column, m: Column) -> Column:
    """Bounds that a correction breaks, on rounded ratios: text changed, span of one edit, growth or loss."""
    over = [(changed_ratio(size, m) > fixed.MAX_CHANGED, "changed"), (m["longest"] > fixed.MAX_SPAN, "span"), (growth_ratio(size, m) > fixed.MAX_GROWTH, "growth")]
    return F.array_compact(F.array(*[F.when(broken, name) for broken, name in over]))


def edit_reasons(size: Column, m: Column) -> Column:
    """The same bounds as sentences with the figures, for a reader of the report."""
    figures = {"changed": changed_ratio(size, m), "span": m["longest"], "growth": growth_ratio(size, m)}
    bounds = {"changed": fixed.MAX_CHANGED, "span": fixed.MAX_SPAN, "growth": fixed.MAX_GROWTH}
    broken = edit_bounds(size, m)
    return F.array_compact(F.array(*[F.when(F.array_contains(broken, k), F.format_string(fixed.EDIT_REASONS[k], figures[k].cast("string"), F.lit(str(bounds[k])))) for k in figures]))


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    lines = lambda x: x.splitlines(keepends=True)
    return pd.Series(["".join(difflib.unified_diff(lines(a), lines(b), "restored.md", "corrected.md")) for a, b in zip(before.fillna(""), after.fillna(""), strict=True)])


def coverage(books: DataFrame, key: str, before: str, after: str, integrity_errors: str) -> DataFrame:
    """Per book char_ratio, containment (both rounded to four places), coverage_pass and passed: no integrity error and covered."""
    r, c = char_ratio(F.col(before), F.col(after)), containment(F.col(before), F.col(after))
    rows = books.select(key, r.alias("r"), c.alias("c"), (F.col(integrity_errors) == 0).alias("sound"))
    ok = gate(F.col("r"), F.col("c"))
    return rows.select(key, F.bround("r", 4).alias("char_ratio"), F.bround("c", 4).alias("ngram_containment"), ok.alias("coverage_pass"), (ok & F.col("sound")).alias("passed"))
