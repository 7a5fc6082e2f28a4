"""Titles on covers: greedy wrapping over a table of glyph widths, and the largest size that fits a box.

Widths are shares of the type size, so that a line's width at a size is their sum times the size. Texts meet the glyph
table by a join on characters; what a title's row then needs is its own characters and widths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T


def atoms(chars: list[str], widths: list[float], kinds: list[str]) -> list[tuple[str, float, bool]]:
    """Units that no break cuts, as (text, width, whether white space stands before): a wide sign alone, other runs whole."""
    out: list[tuple[str, float, bool]] = []
    gap = open_ = False
    for c, w, kind in zip(chars, widths, kinds, strict=True):
        if kind == "space":
            gap, open_ = True, False
        elif kind == "other" and open_:
            text, width, before = out[-1]
            out[-1] = text + c, width + w, before
        else:
            out.append((c, w, gap))
            gap, open_ = False, kind == "other"
    return out


def wrap(units: list[tuple[str, float, bool]], blank: float, most: float) -> list[tuple[str, float]]:
    """Lines (text, width) of at most ``most``, each filled before the next is begun; a unit that is too wide stands alone."""
    lines: list[tuple[str, float]] = []
    for text, width, gap in units:
        if lines:
            line, used = lines[-1]
            more = blank if gap else 0.0
            if used + more + width <= most:
                lines[-1] = line + (" " if gap else "") + text, used + more + width
                continue
        lines.append((text, width))
    return lines


def fit(units: list[tuple[str, float, bool]], blank: float, box_w: float, box_h: float, ascent: float, descent: float) -> tuple[int, list[str], int]:
    """(size, lines, line height) of the largest size whose lines fit the box; the smallest size where none does.

    A larger size never needs fewer lines and always higher ones, so the sizes that fit are all below the others, and
    halving finds the last of them.
    """

    def at(size: int) -> tuple[bool, list[str], int]:
        lines = wrap(units, blank, box_w / size)
        height = int((round(ascent * size) + round(descent * size)) * fixed.LINE_SPACING)
        return all(w * size <= box_w for _, w in lines) and height * len(lines) <= box_h, [t for t, _ in lines], height

    low, high = 0, len(fixed.TITLE_SIZES) - 1  # sizes from the smallest; the one at ``low`` fits, or none does
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if at(fixed.TITLE_SIZES[middle])[0] else (low, middle - 1)
    size = fixed.TITLE_SIZES[low]
    return size, *at(size)[1:]


def fit_titles(titles: DataFrame, key: str, text: str, glyphs: DataFrame, box_w: int, box_h: int, ascent: float, descent: float, unknown: float = 1.0) -> DataFrame:
    """(key, size, lines, line_height) of each title in a box. ``glyphs``: ch, width (a share of the size); ``unknown`` for other signs.

    Breaks are at white space and before and after wide signs. A null or blank title has no lines, and the largest size.
    A text is fitted once, whatever number of titles have it.
    """
    titles = titles.select(key, F.coalesce(text, F.lit("")).alias("__text"))
    texts = titles.select("__text").distinct()
    chars = texts.select("__text", F.posexplode_outer(F.split("__text", "")).alias("pos", "ch")).where("ch <> ''")
    kind = F.when(F.col("ch").rlike(f"[{fixed.WHITE}]"), "space").when(T.is_wide_cjk(F.col("ch")), "wide").otherwise("other")
    rows = chars.join(glyphs.select("ch", F.col("width").cast("double").alias("width")), "ch", "left").withColumn("width", F.coalesce("width", F.lit(float(unknown)))).withColumn("kind", kind)
    held = rows.groupBy("__text").agg(F.array_sort(F.collect_list(F.struct("pos", "ch", "width", "kind"))).alias("c"))
    blank = glyphs.where("ch = ' '").agg(F.coalesce(F.max("width").cast("double"), F.lit(float(unknown))).alias("blank"))  # one row
    every = texts.join(held, "__text", "left").crossJoin(F.broadcast(blank))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for chars, widths, kinds, gap in df[["ch", "w", "k", "blank"]].itertuples(index=False):
                units = atoms(list(chars), list(widths), list(kinds)) if chars is not None else []
                out.append(fit(units, gap, box_w, box_h, ascent, descent))
            yield pd.DataFrame({"__text": df["__text"], "size": [o[0] for o in out], "lines": [o[1] for o in out], "line_height": [o[2] for o in out]})

    rows = every.select("__text", F.col("c.ch").alias("ch"), F.col("c.width").alias("w"), F.col("c.kind").alias("k"), "blank")
    fitted = rows.mapInPandas(run, "__text string, size int, lines array<string>, line_height int")
    return titles.join(fitted, "__text").select(key, "size", "lines", "line_height")
