"""Document triage: page profiles, language vote, repeated edge lines, route and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T


def language_vote(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stop-word votes: the language of most hits, ties in list order, 'unknown' under five hits.

    Computed in the row: one pass, no shuffle, whatever the number of documents. Columns
    of ``keep`` pass through.
    """
    words = T.latin_words(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(key, *keep, words.alias("words"))
    hits = lambda stop: F.size(F.filter("words", lambda w: w.isin(*stop)))
    scores = [hits(stop).alias(lang) for lang, stop in fixed.STOPWORDS.items()]
    rows = rows.select(key, *keep, *scores)
    best = F.greatest(*[F.col(lang) for lang in fixed.STOPWORDS])
    pick = F.lit(None).cast("string")
    for lang in reversed(fixed.STOPWORDS):
        pick = F.when(F.col(lang) == best, lang).otherwise(pick)
    return rows.select(key, *keep, F.when(best >= fixed.LEAST_VOTES, pick).otherwise("unknown").alias("lang_guess"), best.alias("votes"))


def exploded_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) for the non-blank lines, in order."""
    return docs.select(key, F.posexplode(T.lines_of(F.col(text))).alias("pos", "line"))


def page_profile(pages: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of a page: characters, lines, self-doubled lines, words, stray single letters, edge lines. ``keep`` passes through."""
    rows = pages.select(key, *keep, F.col(text).alias("t"), T.lines_of(F.col(text)).alias("lines"))
    clean = F.transform("lines", lambda l: T.dedoubled(l))
    rows = rows.select(key, *keep, "t", "lines", clean.alias("clean"))
    rows = rows.select(key, *keep, "t", "lines", "clean", T.latin_words(F.array_join("clean", " ")).alias("words"))
    stray = F.filter("words", lambda w: (F.length(w) == 1) & ~F.lit(fixed.SINGLE_WORDS).contains(w))
    edge = lambda at: F.coalesce(F.substring(F.try_element_at("clean", F.lit(at)), 1, 80), F.lit(""))
    return rows.select(
        key, *keep, F.length(T.no_space(F.col("t"))).alias("chars"), F.size("lines").alias("lines"), F.size(F.filter("lines", T.is_self_doubled)).alias("doubled_lines"),
        F.size("words").alias("words"), F.size(stray).alias("stray_singles"), edge(1).alias("first_line"), edge(-1).alias("last_line"),
    )


def char_doubled(raw: Column, deduped: Column) -> Column:
    """Whether most glyphs are drawn twice: taking copies away leaves less than 0.7 of them. No glyph, no doubling."""
    return (raw > 0) & (deduped / F.greatest(raw, F.lit(1)) < fixed.DEDUPE_UNDER)


def should_dedupe(mode: Column, raw: Column, deduped: Column) -> Column:
    """'on' and 'off' decide themselves; anything else asks the glyphs."""
    return F.when(mode == "on", True).when(mode == "off", False).otherwise(char_doubled(raw, deduped))


def image_coverage(images: Column, width: Column, height: Column) -> Column:
    """Share of a page under images (an array of boxes), at most 1, three places; an empty page has the area 1."""
    area = F.aggregate(images, F.lit(0.0), lambda a, i: a + F.abs((i["x1"] - i["x0"]) * (i["bottom"] - i["top"])))
    page = (width * height).cast("double")
    return F.bround(F.least(area / F.when(page != 0, page).otherwise(1.0), F.lit(1.0)), 3)


def is_text_page(chars: Column) -> Column:
    return chars >= fixed.TEXT_PAGE_CHARS


def is_image_page(chars: Column, coverage: Column) -> Column:
    return (chars < fixed.TEXT_PAGE_CHARS) & (coverage > fixed.IMAGE_PAGE_COVERAGE)


def furniture(profile: DataFrame, book: str) -> DataFrame:
    """Edge lines, digits masked, that repeat on at least max(3, a third) of a book's pages."""
    edges = profile.select(book, F.explode(F.array("first_line", "last_line")).alias("l")).select(book, T.digit_mask(F.col("l")).alias("edge_line")).where("edge_line <> ''")
    pages = profile.groupBy(book).agg(F.greatest(F.lit(3), F.expr("cast(count(*) div 3 as int)")).alias("least"))
    counted = edges.groupBy(book, "edge_line").agg(F.count("*").alias("n"))
    return counted.join(pages, book).where("n >= least").select(book, "edge_line", "n")


def route(profile: DataFrame, book: str, transcripts: DataFrame | None = None) -> DataFrame:
    """TRANSCRIPT where there is one, TEXT from nine tenths of text pages, OCR up to one tenth, else HYBRID; flags in fixed order.

    ``profile`` may carry char_doubled (of a page) and image_coverage. doubled_chars needs
    over half the pages, doubled_lines over a tenth of the lines, broken_spacing over 0.02
    of the words, page_furniture a repeated edge line. ``transcripts``: the books (column
    ``book``) that have one.
    """
    from lectern.plans.cache import pinned

    profile = pinned(profile)  # three readers; it is small, and its making costs most
    doubled_pages = F.count_if("char_doubled") if "char_doubled" in profile.columns else F.count_if(F.lit(False))
    images = F.count_if(is_image_page(F.col("chars"), F.col("image_coverage"))) if "image_coverage" in profile.columns else F.count_if(F.lit(False))
    agg = profile.groupBy(book).agg(
        F.count("*").alias("pages"), F.count_if(is_text_page(F.col("chars"))).alias("text_pages"), images.alias("image_pages"), doubled_pages.alias("doubled_pages"),
        F.sum("doubled_lines").alias("doubled"), F.sum("lines").alias("lines"), F.sum("stray_singles").alias("stray"), F.sum("words").alias("words"),
        median_whole("chars").alias("median_chars"),
    )
    held = furniture(profile, book).select(book).distinct().withColumn("held", F.lit(True))
    agg = agg.join(held, book, "left")
    agg = agg.join(transcripts.select(book).distinct().withColumn("told", F.lit(True)), book, "left") if transcripts is not None else agg.withColumn("told", F.lit(False))
    ratio = lambda part, whole: F.col(part) / F.greatest(whole, F.lit(1))
    doubled, stray = ratio("doubled", "lines"), ratio("stray", "words")
    raised = [(F.col("doubled_pages") > F.col("pages") / 2, "doubled_chars"), (doubled > fixed.DOUBLED_LINES_OVER, "doubled_lines"), (stray > fixed.STRAY_SINGLES_OVER, "broken_spacing"), (F.col("held"), "page_furniture")]
    named = F.when(F.col("told"), "TRANSCRIPT").when(F.col("text_pages") >= 0.9 * F.col("pages"), "TEXT").when(F.col("text_pages") <= 0.1 * F.col("pages"), "OCR").otherwise("HYBRID")
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in raised]))
    return agg.select(
        book, "pages", "text_pages", "image_pages", "median_chars", F.bround(doubled, 3).alias("doubled_line_ratio"), F.bround(stray, 3).alias("stray_single_ratio"),
        named.alias("route"), F.array_join(flags, ",").alias("flags"),
    )


def median_whole(column: str) -> Column:
    """The exact median without its fraction."""
    return F.floor(F.percentile(column, 0.5)).cast("int")


def sidecars(files: DataFrame, stems: DataFrame, kind: str, endings: tuple[str, ...]) -> DataFrame:
    """For each stem the sibling files STEM-KIND.ENDING: (stem, chosen, extras), in the endings' order of preference.

    ``files``: name; ``stems``: stem. A stem without any has no row.
    """
    rank = F.create_map(*[F.lit(x) for n, e in enumerate(endings) for x in (e, n)])
    named = files.select("name", F.regexp_extract("name", rf"^(.*)-{kind}\.[^.]+$", 1).alias("stem"), F.try_element_at(rank, F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("rank"))
    held = named.where("rank is not null and stem <> ''").join(stems.select("stem").distinct(), "stem", "left_semi")
    cells = F.array_sort(F.collect_list(F.struct("rank", "name")))
    return held.groupBy("stem").agg(cells.alias("c")).select("stem", F.col("c")[0]["name"].alias("chosen"), F.transform(F.slice("c", 2, len(endings)), lambda x: x["name"]).alias("extras"))


def transcript_profile(texts: DataFrame, key: str, text: str) -> DataFrame:
    """chars, lines (line feeds and one), empty, looks_structured, preview."""
    t = F.col(text)
    feeds = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return texts.select(
        key, F.length(t).alias("chars"), (feeds + 1).alias("lines"), (T.strip(t) == "").alias("empty"), T.looks_structured(t).alias("looks_structured"), F.substring(t, 1, fixed.PREVIEW_LENGTH).alias("preview")
    )


def systematic_sample(df: DataFrame, order: str, samples: int) -> DataFrame:
    """Every step-th row from the first, ``samples`` at most; step = rows div samples.

    Row numbers come from a range partitioning and per-partition counts, not from one task.
    """
    total = df.agg(F.count("*").alias("__total"))
    numbered = with_row_number(df, order)
    step = F.greatest(F.lit(1), F.expr(f"__total div {max(1, samples)}"))
    return numbered.crossJoin(F.broadcast(total)).where(((F.col("rn") - 1) % step == 0) & ((F.col("rn") - 1) / step < samples)).drop("__total")


def with_row_number(df: DataFrame, order: str | list[Column], name: str = "rn") -> DataFrame:
    """1-based number of each row by a unique order, in two levels: rows by bucket, then inside each bucket.

    Buckets are hash-free ranges of the order column's approximate quantiles, so each task numbers one range.
    """
    order = [F.col(order)] if isinstance(order, str) else order
    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    from lectern.plans.cache import pinned

    ranged = pinned(ranged)
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__p", before.alias("__before"))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__i", inside).join(F.broadcast(sizes), "__p").withColumn(name, F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")


def tally(df: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """Frequencies with the place of first sight, which breaks ties."""
    return df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))


