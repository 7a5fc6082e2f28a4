"""Restoring running text from extracted lines: gaps and islands over (doc, page, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed

TEXT_STEP = 1.6
INDENT = 10


def _order(doc: str):
    return Window.partitionBy(doc).orderBy("page", "pos")


def flatten(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, page, pos, line fields) from pages that hold an array ``lines`` of structs, in numeric page order."""
    rows = pages.select(doc, "page", F.posexplode("lines").alias("pos", "l"))
    return rows.select(doc, "page", "pos", "l.*")


def islands(lines: DataFrame, doc: str, breaks: Column, text: str = "text", glue: str = " ") -> DataFrame:
    """One row per island: (doc, para, text); ``breaks`` marks a line that begins a new island."""
    w = _order(doc)
    rows = lines.withColumn("para", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.array_sort(F.collect_list(F.struct("page", "pos", F.col(text).alias("t"))))
    paras = rows.groupBy(doc, "para").agg(cells.alias("cells"))
    dense = F.row_number().over(Window.partitionBy(doc).orderBy("para")) - 1
    return paras.select(doc, dense.alias("para"), F.array_join(F.transform("cells", lambda c: c["t"]), glue).alias("text"))


def reflow_sentence(lines: DataFrame, doc: str) -> DataFrame:
    """Paragraphs that end with a line whose last character is terminal punctuation; geometry plays no part."""
    ends = F.coalesce(F.rtrim(F.lag("text").over(_order(doc))).rlike("[" + "".join("\\" + c for c in fixed.TERMINAL) + "]$"), F.lit(False))
    return islands(lines, doc, ends)


def reflow_prose(lines: DataFrame, doc: str) -> DataFrame:
    """Paragraphs that begin at a gap over 1.6 medians on the same page, or off the modal margin by over 10.

    The medians and modes are per document: positive same-page gaps only; the mode of
    rounded margins, the first seen of equals.
    """
    w = _order(doc)
    rows = lines.withColumn("gap", F.when(F.lag("page").over(w) == F.col("page"), F.col("top") - F.lag("bottom").over(w))).withColumn("margin", F.bround("x0").cast("long"))
    rows = rows.withColumn("n", F.row_number().over(w))
    gaps = rows.groupBy(doc).agg(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0.0)).alias("usual"))
    margins = rows.groupBy(doc, "margin").agg(F.count("*").alias("c"), F.min("n").alias("f"))
    margins = margins.groupBy(doc).agg(F.max_by("margin", F.struct("c", -F.col("f"))).alias("base"))
    rows = rows.join(gaps, doc).join(margins, doc)
    starts = (F.col("n") > 1) & (F.coalesce((F.col("usual") > 0) & (F.col("gap") > TEXT_STEP * F.col("usual")), F.lit(False)) | (F.abs(F.col("margin") - F.col("base")) > INDENT))
    return islands(rows, doc, starts)


def verse(lines: DataFrame, doc: str) -> DataFrame:
    return islands(lines, doc, F.lit(False), glue="\n")


def dehyphenate(lines: DataFrame, doc: str, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Lines joined where one ends with '-' and the next of the same page begins in lower case.

    The hyphen goes unless the joined word is an exception. A line that ends in a lone
    '-' joins nothing. A joined line keeps the first line's place. Columns: doc, page,
    pos, text, merged (hyphens that went).
    """
    w = _order(doc)
    last = F.element_at(F.split(F.rtrim("text"), " "), -1)
    links = F.col("text").endswith("-") & (F.length(last) >= 2) & (F.lead("page").over(w) == F.col("page")) & F.lead("text").over(w).rlike(r"^\p{Ll}")
    rows = lines.withColumn("links", F.coalesce(links, F.lit(False)))
    rows = rows.withColumn("chain", F.sum(F.when(F.coalesce(F.lag("links").over(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.array_sort(F.collect_list(F.struct("page", "pos", F.col("text").alias("t"))))
    chains = rows.groupBy(doc, "chain").agg(cells.alias("cells"))
    kept = F.array(*[F.lit(e.lower()) for e in exceptions]) if exceptions else F.array().cast("array<string>")
    start = F.struct(F.col("cells")[0]["t"].alias("t"), F.lit(0).alias("n"))

    def step(a, c):
        tail = F.element_at(F.split(F.rtrim(a["t"]), " "), -1)
        word = F.lower(F.concat(F.substring(tail, F.lit(1), F.length(tail) - 1), F.element_at(F.split(c["t"], " "), 1)))
        keeps = F.array_contains(kept, word)
        cut = F.substring(a["t"], F.lit(1), F.length(a["t"]) - 1)
        return F.struct(F.concat(F.when(keeps, a["t"]).otherwise(cut), c["t"]).alias("t"), (a["n"] + F.when(keeps, 0).otherwise(1)).alias("n"))

    done = F.aggregate(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), start, step)
    return chains.select(doc, F.col("cells")[0]["page"].alias("page"), F.col("cells")[0]["pos"].alias("pos"), done["t"].alias("text"), done["n"].alias("merged"))


def offsets(paragraphs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """``off``: where each paragraph begins when they are joined by blank lines."""
    w = Window.partitionBy(doc).orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("off", F.coalesce(F.sum(F.length(text) + 2).over(w), F.lit(0)).cast("long"))


def normalise(df: DataFrame, text: str, table: list[tuple[str, str]]) -> DataFrame:
    """Ordered replacements; ``hits``: how often each applied, counted after the earlier ones."""
    out, counts = F.col(text), []
    for old, new in table:
        counts.append(((F.length(out) - F.length(F.replace(out, F.lit(old), F.lit("")))) / F.lit(len(old))).cast("long"))
        out = F.replace(out, F.lit(old), F.lit(new))
    return df.withColumn("hits", F.array(*counts)).withColumn(text, out)
