"""Cutting restored text into chapters by anchors, with figures placed behind their paragraphs.

A draft is a parameter for one book; texts of many books are cut at once when their drafts
are given as tables. Every rule that a draft can break gives an error row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import joins

REQUIRED = ("title", "author", "language", "chapters", "front_matter")


def validate(draft: Mapping) -> list[str]:
    """What a draft document lacks, in order; empty for a sound one."""
    missing = [k for k in REQUIRED if k not in draft]
    if missing:
        return [f"missing required keys: {missing}"]
    errors = [] if draft["front_matter"] == "drop" else [f"unsupported front_matter value {draft['front_matter']!r}"]
    errors += [] if draft["chapters"] else ["no chapters"]
    return errors + [f"chapter {n} missing {key!r}" for n, c in enumerate(draft["chapters"], 1) for key in ("toc_label", "start_anchor") if key not in c]


def paragraphs(texts: DataFrame, book: str, text: str) -> DataFrame:
    """(book, para, off, text): the units of a restored text, which blank lines divide, and where each begins."""
    whole = F.regexp_replace(F.col(text), r"\n+$", "")
    rows = texts.select(book, F.posexplode(F.split(whole, "\n\n")).alias("para", "text")).where("text <> '' or para > 0")
    before = F.sum(F.length("text") + 2).over(Window.partitionBy(book).orderBy("para").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(book, "para", F.coalesce(before, F.lit(0)).alias("off"), "text")


def locate(anchors: DataFrame, texts: DataFrame, book: str, text: str) -> DataFrame:
    """``anchors`` (book, n, anchor) with ``at``, the place of the anchor in its book's text, or ``error``: it must occur just once."""
    rows = anchors.join(texts.select(book, F.col(text).alias("__t")), book, "left")
    hits = joins.occurrences(F.col("__t"), F.col("anchor"))
    error = F.when(F.coalesce(hits, F.lit(0)) == 0, "anchor not found").when(hits > 1, F.format_string("anchor ambiguous (%d hits)", hits))
    return rows.withColumn("error", error).withColumn("at", F.when(error.isNull(), F.expr("position(anchor, __t)") - 1)).drop("__t")


def start_paragraphs(located: DataFrame, paras: DataFrame, book: str) -> DataFrame:
    """``located`` with ``para``: the paragraph that holds each anchor, by an as-of join on the offset."""
    marks = paras.select(book, F.col("off").alias("at"), "para")
    return joins.as_of(located.where("error is null").withColumn("at", F.col("at").cast("long")), marks.withColumn("at", F.col("at").cast("long")), [book], "at", "para", 0)


def order_errors(starts: DataFrame, book: str) -> DataFrame:
    """(book, n, error) of chapters whose anchor doesn't come behind the one before."""
    before = F.lag("para").over(Window.partitionBy(book).orderBy("n"))
    return starts.withColumn("prev", before).where("prev is not null and para <= prev").select(book, "n", F.lit("anchor out of order").alias("error"))


def chapters(starts: DataFrame, paras: DataFrame, figures: DataFrame, book: str) -> DataFrame:
    """(book, n, file, toc_label, paragraphs, text): chapters as documents, figures behind their paragraphs in draft order.

    ``starts``: book, n, toc_label, para; ``figures``: book, n, para, caption, file (their
    paragraphs may lie in no chapter: see front_matter()). Each paragraph takes the last
    chapter that starts at or before it, by a running value; those before the first
    chapter belong to none.
    """
    marks = starts.select(book, "para", F.struct("n", "toc_label").alias("chapter"))
    held = paras.join(marks, [book, "para"], "left")
    w = Window.partitionBy(book).orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("chapter", F.last("chapter", ignorenulls=True).over(w)).where("chapter is not null")
    image = F.concat(F.lit("!["), F.coalesce("caption", F.lit("")), F.lit("](../images/"), "file", F.lit(")"))
    pictures = figures.groupBy(book, "para").agg(F.array_sort(F.collect_list(F.struct("n", image.alias("i")))).alias("pictures"))
    held = held.join(pictures, [book, "para"], "left")
    none = F.array().cast("array<string>")
    blocks = F.concat(F.array("text"), F.coalesce(F.transform("pictures", lambda p: p["i"]), none))
    rows = held.groupBy(book, F.col("chapter.n").alias("n"), F.col("chapter.toc_label").alias("toc_label")).agg(F.count("*").alias("paragraphs"), F.array_sort(F.collect_list(F.struct("para", blocks.alias("b")))).alias("c"))
    body = F.flatten(F.transform("c", lambda x: x["b"]))
    text = F.concat(F.array_join(F.concat(F.array(F.concat(F.lit("# "), "toc_label")), body), "\n\n"), F.lit("\n"))
    return rows.select(book, "n", F.format_string("chapters/ch%02d.md", "n").alias("file"), "toc_label", "paragraphs", text.alias("text"))


def front_matter(starts: DataFrame, paras: DataFrame, book: str) -> DataFrame:
    """(book, dropped): paragraphs before the first chapter."""
    first = starts.groupBy(book).agg(F.min("para").alias("first"))
    return paras.join(first, book).where("para < first").groupBy(book).agg(F.count("*").alias("dropped"))


def figure_errors(figures: DataFrame, starts: DataFrame, pages: DataFrame, book: str) -> DataFrame:
    """(book, n, error): figures (book, n, para, page, index) in dropped front matter, of pages that aren't there or with too few images.

    ``pages``: book, page, images (an array of boxes).
    """
    first = starts.groupBy(book).agg(F.min("para").alias("first"))
    rows = figures.join(first, book, "left").join(pages.select(book, "page", F.size("images").alias("held")), [book, "page"], "left")
    error = (
        F.when(F.col("para") < F.col("first"), "anchor in dropped front matter").when(F.col("held").isNull(), F.format_string("page %d not found", "page"))
        .when(F.col("index") >= F.col("held"), F.format_string("image index %d out of range on page %d (has %d)", "index", "page", "held"))
    )
    return rows.select(book, "n", error.alias("error")).where("error is not null")


def figure_boxes(figures: DataFrame, pages: DataFrame, book: str, dpi: int = 300, max_width: int = 480) -> DataFrame:
    """(book, n, file, box, width, height): crop boxes in pixels at ``dpi`` and sizes after fitting ``max_width``."""
    rows = figures.join(pages.select(book, "page", "images"), [book, "page"]).withColumn("i", F.get("images", F.col("index")))
    px = lambda c: F.bround(F.col(f"i.{c}") * (dpi / 72.0)).cast("int")
    rows = rows.select(book, "n", F.struct(*[px(c).alias(c) for c in ("x0", "top", "x1", "bottom")]).alias("box"))
    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.bottom") - F.col("box.top")
    wide = w > max_width
    return rows.select(book, "n", F.format_string("fig%02d.png", "n").alias("file"), "box", F.when(wide, max_width).otherwise(w).alias("width"), F.when(wide, F.bround(h * max_width / w).cast("int")).otherwise(h).alias("height"))


def accounting(chapters_: DataFrame, dropped: DataFrame, paras: DataFrame, book: str) -> DataFrame:
    """(book, assigned, dropped, total, ok): every paragraph is in a chapter or in dropped front matter."""
    out = paras.groupBy(book).agg(F.count("*").alias("total")).join(chapters_.groupBy(book).agg(F.sum("paragraphs").alias("assigned")), book, "left").join(dropped, book, "left")
    assigned, gone = F.coalesce("assigned", F.lit(0)), F.coalesce("dropped", F.lit(0))
    return out.select(book, assigned.alias("assigned"), gone.alias("dropped"), "total", (assigned + gone == F.col("total")).alias("ok"))
