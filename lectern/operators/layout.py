"""Building page lines from glyph boxes: order, size, font, and blanks where glyphs stand apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def in_reading_order(lines: DataFrame, page: list[str], top: str, seq: str, name: str = "pos") -> DataFrame:
    """Lines of a page from top to bottom, those of one height as they came, numbered from 0."""
    w = Window.partitionBy(*page).orderBy(top, seq)
    return lines.withColumn(name, F.row_number().over(w) - 1)


def spaced_text(glyphs: DataFrame, line: list[str], ratio: float = 0.4) -> DataFrame:
    """(line, text): glyphs (x0, x1, text, seq) from left to right, a blank where a gap exceeds ``ratio`` medians of their width.

    Glyphs without width don't count for the median (2.0 without any); no blank is put
    before white space or behind it.
    """
    w = Window.partitionBy(*line).orderBy("x0", "seq")
    width = F.col("x1") - F.col("x0")
    usual = glyphs.groupBy(*line).agg(F.coalesce(F.median(F.when(width > 0, width)), F.lit(2.0)).alias("usual"))
    rows = glyphs.withColumn("gap", F.col("x0") - F.lag("x1").over(w)).withColumn("before", F.lag("text").over(w)).withColumn("n", F.row_number().over(w)).join(usual, line)
    blank = lambda c: (T.strip(F.col(c)) == "") & (F.col(c) != "")
    apart = F.coalesce((F.col("gap") > ratio * F.col("usual")) & ~blank("text") & ~blank("before"), F.lit(False))
    cells = F.array_sort(F.collect_list(F.struct("n", F.when(apart, F.concat(F.lit(" "), "text")).otherwise(F.col("text")).alias("t"))))
    return rows.groupBy(*line).agg(F.array_join(F.transform(cells, lambda c: c["t"]), "").alias("text"))


def line_style(glyphs: DataFrame, line: list[str]) -> DataFrame:
    """(line, size, font, box): the median size and the commonest font, the first seen of equals, and the glyphs' extent, one place."""
    fonts = glyphs.groupBy(*line, "font").agg(F.count("*").alias("n"), F.min("seq").alias("at"))
    fonts = fonts.groupBy(*line).agg(F.max_by("font", F.struct("n", -F.col("at"))).alias("font"))
    one = lambda c: F.bround(c, 1)
    sizes = glyphs.groupBy(*line).agg(
        one(F.median("size")).alias("size"), one(F.min("x0")).alias("x0"), one(F.min("top")).alias("top"), one(F.max("x1")).alias("x1"), one(F.max("bottom")).alias("bottom"),
    )
    return sizes.join(fonts, line)


def page_records(glyphs: DataFrame, page: list[str], ratio: float | None = None) -> DataFrame:
    """(page, lines, chars): a page's lines in reading order as structs, and its characters that aren't white space.

    ``glyphs``: page, line, seq, text, x0, x1, top, bottom, size, font. With ``ratio``
    blanks are put in by spaced_text(); without it glyphs are joined as they are.
    """
    line = [*page, "line"]
    if ratio is None:
        cells = F.array_sort(F.collect_list(F.struct("x0", "seq", "text")))
        texts = glyphs.groupBy(*line).agg(F.array_join(F.transform(cells, lambda c: c["text"]), "").alias("text"))
    else:
        texts = spaced_text(glyphs, line, ratio)
    rows = texts.join(line_style(glyphs, line), line)
    cells = F.array_sort(F.collect_list(F.struct("top", "line", F.struct("text", "x0", "top", "x1", "bottom", "size", "font").alias("l"))))
    out = rows.groupBy(*page).agg(F.transform(cells, lambda c: c["l"]).alias("lines"), F.sum(F.length(T.no_space(F.col("text")))).alias("chars"))
    return out


def fonts(glyphs: DataFrame, doc: str) -> DataFrame:
    """(doc, fonts): the distinct font names, sorted."""
    return glyphs.groupBy(doc).agg(F.array_sort(F.collect_set("font")).alias("fonts"))


def largest(variants: Column, size: str) -> Column:
    """The variant (struct) of the largest size, the last of equals."""
    ranked = F.transform(variants, lambda v, i: F.struct(v[size].alias("s"), i.alias("i"), v.alias("v")))
    return F.array_max(ranked)["v"]
