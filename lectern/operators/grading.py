"""Vocabulary grading: a tier for each token, rates for each text, gates with reasons."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fixed, patterns
from lectern.functions import text as T


@dataclass(frozen=True)
class Gates:
    threshold: float = 0.05
    min_out_of_list: float = 0.0
    max_stretch: float = 0.15
    min_chars: int = 0
    min_expressions: int = 0


def known_chars(lexicon: DataFrame) -> DataFrame:
    """Distinct Han characters of all known words."""
    return lexicon.select(F.explode(T.han_chars(F.col("word"))).alias("ch")).distinct()


def cap_level(lexicon: DataFrame, cap: int) -> DataFrame:
    """Graded words over the cap go; ungraded ones and other sources stay."""
    level = T.level_ceiling(F.col("level"))
    return lexicon.where((F.col("source") != "graded") | level.isNull() | (level <= cap))


def decomposes(word: Column, known: Column) -> Column:
    """Whether a word of 2 to 8 characters splits into known shorter words; ``known``: those of its substrings.

    Reachability over places, folded left to right: place i is reached if some reached j
    has word[j:i] known.
    """
    n = F.length(word)
    start = F.array(F.lit(0))

    def step(reached, i):
        ok = F.exists(reached, lambda j: ((i - j) < n) & F.array_contains(known, F.substring(word, j + 1, i - j)))
        return F.when(ok, F.concat(reached, F.array(i))).otherwise(reached)

    return n.between(2, 8) & F.array_contains(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step), n)


def substrings(word: Column, most: int = 8) -> Column:
    n = F.least(F.length(word), F.lit(most))
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda k: F.substring(word, i, k)))))


def classify(tokens: DataFrame, lexicon: DataFrame, idioms: DataFrame) -> DataFrame:
    """``tokens`` (with column token) plus ``tier``: chengyu, known, composed, stretch, flagged; null without Han.

    Distinct tokens are graded once and joined back; word lists are joined by key, so
    neither side needs to fit anywhere.
    """
    words = tokens.where(T.has_han(F.col("token"))).select(F.col("token").alias("word")).distinct()
    listed = lexicon.select("word").distinct()
    chars = known_chars(lexicon)
    own = words.select("word", F.explode(T.han_chars(F.col("word"))).alias("ch")).join(chars.withColumn("hit", F.lit(1)), "ch", "left")
    own = own.groupBy("word").agg(F.bool_and(F.col("hit").isNotNull()).alias("chars_known"), F.count("*").alias("n_han"))
    parts = words.where(F.length("word").between(2, 8)).select("word", F.explode(substrings(F.col("word"))).alias("part"))
    parts = parts.join(listed.withColumnRenamed("word", "part"), "part", "left_semi").groupBy("word").agg(F.collect_set("part").alias("parts"))
    graded = words.join(own, "word", "left").join(parts, "word", "left")
    graded = graded.join(listed.withColumn("is_known", F.lit(True)), "word", "left").join(idioms.select("word").distinct().withColumn("is_idiom", F.lit(True)), "word", "left")
    splits = F.coalesce(decomposes(F.col("word"), F.col("parts")), F.lit(False))
    tier = (
        F.when(F.col("is_idiom"), "chengyu").when(F.col("is_known"), "known").when((F.col("n_han") == 1) & F.col("chars_known"), "known")
        .when(T.is_number(F.col("word")) & F.col("chars_known"), "composed").when(splits, "composed").when((F.col("n_han") >= 2) & F.col("chars_known"), "stretch").otherwise("flagged")
    )
    graded = graded.select(F.col("word").alias("token"), tier.alias("tier"))
    return tokens.join(graded, "token", "left")


def report(tiers: DataFrame, by: str) -> DataFrame:
    """Counts by tier and rates rounded to four places, 0.0 for an empty text."""
    count = lambda t: F.count_if(F.col("tier") == t).alias(t)
    out = tiers.groupBy(by).agg(F.count("tier").alias("counted"), *[count(t) for t in ("known", "chengyu", "composed", "stretch", "flagged")])
    rate = lambda part: F.when(F.col("counted") > 0, F.bround(F.col(part) / F.col("counted"), 4)).otherwise(0.0)
    return out.withColumn("out_of_list_rate", rate("flagged")).withColumn("stretch_rate", rate("stretch"))


def gate(reports: DataFrame, gates: Gates, chars: Column | None = None, expressions: Column | None = None) -> DataFrame:
    """``fail_reasons`` in fixed order and ``passed``; comparisons are strict and on rounded rates."""
    chars, expressions = chars if chars is not None else F.lit(0), expressions if expressions is not None else F.lit(0)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("out_of_list_rate") > gates.threshold, "out_of_list_rate>threshold"), F.when(F.col("out_of_list_rate") < gates.min_out_of_list, "out_of_list_rate<min (too easy — reach a little further)"),
            F.when(F.col("stretch_rate") > gates.max_stretch, "stretch_rate>max_stretch"), F.when(chars < gates.min_chars, F.format_string(f"too short (%d<{gates.min_chars} chars)", chars)),
            F.when(expressions < gates.min_expressions, F.format_string(f"too few expressions (%d<{gates.min_expressions})", expressions)),
        )
    )
    return reports.withColumn("fail_reasons", reasons).withColumn("passed", F.size("fail_reasons") == 0)


def book_verdict(gated: DataFrame, book: str) -> DataFrame:
    """(book, chapters, passed): a book passes if all its chapters do."""
    return gated.groupBy(book).agg(F.count("*").alias("chapters"), F.bool_and("passed").alias("passed"))


def expression_hits(texts: DataFrame, key: str, text: str, expressions: list[tuple[str, str | None]]) -> DataFrame:
    """The listed expressions that occur in each text, by pattern or literally, once each, in list order.

    Patterns are Python's; one that is wrong or has no counterpart raises a PatternError here, before any job.
    """
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(patterns.for_spark(rx)) if rx else F.col(text).contains(name), name) for name, rx in expressions]))
    return texts.select(key, hits.alias("expressions"), F.size(hits).alias("expression_count"))


def resolve_gates(given: Mapping[str, object], plan: Mapping[str, object]) -> Gates:
    """Each gate from the call, else from the plan's validation block, else the default; null in the call means not given."""
    chosen = {f.name: given[f.name] if given.get(f.name) is not None else plan.get(f.name, f.default) for f in fields(Gates)}
    return Gates(**chosen)


def resolved(given: Column, plan: Column, default: Column | None = None) -> Column:
    """The same rule for a column of a table: the call's value, the plan's, the default."""
    return F.coalesce(given, plan, *([default] if default is not None else []))


def report_lists(tiers: DataFrame, by: str, pos: str, most: int | None = None) -> DataFrame:
    """Per text flagged_tokens and stretch_tokens: most frequent first, then first seen; ``most`` caps the lists for display."""
    counted = tiers.where("tier in ('flagged', 'stretch')").groupBy(by, "tier", "token").agg(F.count("*").alias("n"), F.min(pos).alias("at"))
    listed = lambda tier: F.array_sort(F.collect_list(F.when(F.col("tier") == tier, F.struct((-F.col("n")).alias("n"), "at", "token"))))
    cut = (lambda x: F.slice(x, 1, most)) if most else (lambda x: x)
    out = counted.groupBy(by).agg(listed("flagged").alias("flagged"), listed("stretch").alias("stretch"))
    return out.select(by, *[cut(F.transform(t, lambda x: x["token"])).alias(f"{t}_tokens") for t in ("flagged", "stretch")])


def with_gloss(words: DataFrame, lexicon: DataFrame, key: str = "word") -> DataFrame:
    """Reading and gloss of each word, '' where the lexicon has none. ``lexicon``: one row a word."""
    rows = words.join(lexicon.select(F.col("word").alias(key), "reading", "gloss"), key, "left")
    return rows.withColumn("reading", F.coalesce("reading", F.lit(""))).withColumn("gloss", F.coalesce("gloss", F.lit("")))


def gloss_worthy(tiers: DataFrame, lexicon: DataFrame, by: str, pos: str) -> DataFrame:
    """(by, token, first_pos): distinct tokens that deserve a gloss: a book's own words, stretches and flagged ones."""
    own = lexicon.where("source = 'book'").select(F.col("word").alias("token")).distinct().withColumn("own", F.lit(True))
    rows = tiers.where("tier is not null").join(own, "token", "left").where(F.col("own") | F.col("tier").isin("stretch", "flagged"))
    return rows.groupBy(by, "token").agg(F.min(pos).alias("first_pos"))


#: Words of a list that may travel as one text, and of one that may travel to the workers.
MOST_SHOWN, MOST_SHARED = 100_000, 2_000_000


def short_list(words: DataFrame, most: int) -> DataFrame:
    """``words``, after a count that ends at ``most``: a longer list is an error and not a broadcast."""
    if words.limit(most + 1).count() > most:
        raise ValueError(f"a word list has over {most} rows")
    return words


def _banded(lexicon: DataFrame, bands: tuple[str, ...], other: str) -> DataFrame:
    band = F.when(F.col("level").isin(*bands), F.col("level")).otherwise(other)
    return lexicon.where("source <> 'personal'").select(band.alias("band"), "word")


def band_words(lexicon: DataFrame, bands: tuple[str, ...], other: str) -> DataFrame:
    """(band, place, word, n): a row a word, numbered from 0 in its band's order, and how many the band has.

    Unknown levels go to ``other``, personal words nowhere. Words are numbered by ranges, so that a band may have any number.
    """
    from lectern.operators.profile import with_row_number

    rows = with_row_number(_banded(lexicon, bands, other), [F.col("band"), F.col("word")])
    ends = rows.groupBy("band").agg(F.min("rn").alias("first"), F.count("*").alias("n"))  # a row for each listed band and one more
    return rows.join(F.broadcast(ends), "band").select("band", (F.col("rn") - F.col("first")).alias("place"), "word", "n")


def by_band(lexicon: DataFrame, bands: tuple[str, ...], other: str) -> DataFrame:
    """(band, words, n): sorted words of each band as an array, of a list of MOST_SHOWN words at most: see band_words()."""
    rows = _banded(short_list(lexicon, MOST_SHOWN), bands, other)
    return rows.groupBy("band").agg(F.array_sort(F.collect_list("word")).alias("words")).withColumn("n", F.size("words"))


#: Lines that are joined in one piece.
PIECE = 10_000


def joined(rows: DataFrame, by: list[str], order: list[str], line: Column, between: str) -> DataFrame:
    """(by, text, n): lines in their order as one text, and how many there are; joined in pieces, so that only pieces of a group meet in one task."""
    from lectern.operators.profile import with_row_number

    numbered = with_row_number(rows.select(*by, *order, line.alias("line")).where("line is not null"), [F.col(c) for c in (*by, *order)])
    pieces = numbered.groupBy(*by, F.floor(F.col("rn") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("c"))
    pieces = pieces.select(*by, "piece", F.array_join(F.col("c.line"), between).alias("text"), F.size("c").alias("n"))
    whole = pieces.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("c"), F.sum("n").alias("n"))
    return whole.select(*by, F.array_join(F.col("c.text"), between).alias("text"), "n")


def topic_words(lexicon: DataFrame) -> DataFrame:
    """A book's own words as one sorted array of (word, reading, gloss), MOST_SHOWN at most."""
    cells = F.array_sort(F.collect_list(F.struct("word", "reading", "gloss")))
    return short_list(lexicon.where("source = 'book'"), MOST_SHOWN).agg(cells.alias("topic"))


def best_definitions(entries: DataFrame, pos: str) -> DataFrame:
    """(word, reading, gloss): of a word's entries (reading, definitions) that with most definitions, the first of equals.

    The gloss holds two senses that don't begin with 'see ', or any two, shortened.
    """
    best = F.max_by(F.struct("reading", "definitions"), F.struct(F.size("definitions").alias("n"), (-F.col(pos)).alias("p"))).alias("e")
    rows = entries.groupBy("word").agg(best).select("word", "e.*")
    own = F.filter("definitions", lambda d: ~d.startswith("see "))
    senses = F.when(F.size(own) > 0, own).otherwise(F.col("definitions"))
    return rows.select("word", T.tone_marks(F.col("reading")).alias("reading"), T.gloss_short(F.array_join(F.slice(senses, 1, 2), "; ")).alias("gloss"))


def pending(outline: DataFrame, only: int | None = None, since: int | None = None) -> DataFrame:
    """Chapters (n, status) to write: the one asked for, those from a number on, or all that aren't done."""
    if only is not None:
        return outline.where(F.col("n") == only)
    if since is not None:
        return outline.where(F.col("n") >= since)
    return outline.where(F.col("status").isNull() | ~F.col("status").isin(*fixed.DONE))


def segment(texts: DataFrame, key: str, text: str, lexicon: DataFrame, total: float | None = None) -> DataFrame:
    """(key, pos, token): the likeliest split of each text's Han runs into listed words (word, freq).

    A word's probability is its frequency over their sum; a character that begins no listed
    word stands alone at frequency 1; of equally likely splits that with the longer word
    first. Other runs (letters and digits) are tokens, signs single ones. The lexicon, of
    MOST_SHARED words at most, travels to the workers; texts stay where they are.
    """
    from math import log

    words = {r["word"]: float(r["freq"]) for r in short_list(lexicon.select("word", "freq"), MOST_SHARED).collect()}
    size = log(total if total else max(1.0, sum(words.values())))
    longest = max(map(len, words), default=1)
    shared = texts.sparkSession.sparkContext.broadcast({w: log(max(f, 1e-9)) - size for w, f in words.items()})

    def split(run: str) -> list[str]:
        cost, n = shared.value, len(run)
        best: list[tuple[float, int]] = [(0.0, 0)] * (n + 1)
        for i in range(n - 1, -1, -1):
            ends = [i + 1, *[j for j in range(i + 2, min(n, i + longest) + 1) if run[i:j] in cost]]
            best[i] = max((cost.get(run[i:j], -size) + best[j][0], j) for j in ends)
        out, i = [], 0
        while i < n:
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        runs = re.compile(r"([一-鿿]+)|([A-Za-z0-9]+)|(.)", re.DOTALL)
        for df in batches:
            rows = []
            for k, t in zip(df[key], df[text], strict=True):
                tokens = [w for m in runs.finditer(t or "") for w in (split(m[1]) if m[1] else [m[0]])]
                rows += [(k, n, w) for n, w in enumerate(tokens)]
            yield pd.DataFrame(rows, columns=[key, "pos", "token"])

    return texts.select(key, text).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, pos int, token string")


def story_so_far(outline: DataFrame, book: str, chapter: int) -> DataFrame:
    """(book, so_far): a line for each earlier chapter, with its recap or else its summary."""
    said = F.coalesce(F.nullif("recap", F.lit("")), F.col("summary"), F.lit(""))
    line = F.concat(F.lit("- Ch "), F.col("n").cast("string"), F.lit(" "), F.coalesce("title", F.lit("")), F.lit(": "), said)
    cells = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return outline.where(F.col("n") < chapter).groupBy(book).agg(F.array_join(F.transform(cells, lambda c: c["line"]), "\n").alias("so_far"))


#: Spark's setting for the codec of Parquet files.
CODEC = "spark.sql.parquet.compression.codec"


def _large_rows(spark: SparkSession, column: str) -> None:
    """Settings of the session for Parquet files in which ``column`` holds texts of megabytes.

    A writer's buffers are looked at from the first row on, not from the hundredth; no least and greatest text is kept,
    for which each text would be decoded twice. Sorted words take 3.6 times the bytes in Snappy as in Zstandard, which is
    set unless the caller has chosen a codec; as it packs 14 to one, row groups are smaller, so that a reader that takes
    one whole has no more text than before.
    """
    spark.conf.set("parquet.page.size.row.check.min", "1")
    spark.conf.set(f"parquet.column.statistics.enabled#{column}", "false")
    if spark.conf.get(CODEC, None) is None:
        spark.conf.set(CODEC, "zstd")
        spark.conf.set("parquet.block.size", str(32 << 20))


def brief(outline: DataFrame, book: str, chapter: int, introduced: DataFrame, lexicon: DataFrame, gates: Gates, bands: tuple[str, ...], other: str) -> DataFrame:
    """(book, brief): a chapter's summary, the story so far, the limits, words introduced, topic words and words by band.

    ``outline``: book, n, title, summary, recap; ``introduced``: book, word, pos. Sections
    without content are left out; texts that a model should read can be put before it. A
    brief holds the whole lists, whatever their length: they are made into one text once, and
    books are dealt out to as many tasks as shuffles have, however small the outline.
    """
    here = outline.where(F.col("n") == chapter).select(book, "title", "summary")
    known = introduced.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")).select(book, F.array_join(F.transform("w", lambda x: x["word"]), "、").alias("known"))
    line = F.concat(F.lit("- **"), F.col("word"), F.lit("** "), F.col("reading"), F.lit(" — "), F.col("gloss"))
    topic = joined(lexicon.where("source = 'book'"), [], ["word", "reading", "gloss"], line, "\n").select(F.col("text").alias("topic"))
    rank = F.array_position(F.array(*map(F.lit, (*bands, other))), F.col("band"))
    groups = joined(_banded(lexicon, bands, other), ["band"], ["word"], F.col("word"), "、").select(F.struct(rank.alias("rank"), F.format_string("### %s  (%d words)\n%s", "band", "n", "text").alias("line")).alias("g"))
    groups = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["line"]), "\n").alias("vocabulary"))
    limits = f"- out of list: {gates.min_out_of_list:.0%} to {gates.threshold:.0%}\n- stretch: at most {gates.max_stretch:.0%}\n- length: at least {gates.min_chars} characters\n- expressions: at least {gates.min_expressions}"
    section = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {head}\n"), c))
    lists = topic.crossJoin(F.broadcast(groups)).select(F.nullif(F.concat_ws("\n\n", section("Topic words", F.col("topic")), section("Vocabulary", F.col("vocabulary"))), F.lit("")).alias("lists"))
    spark = outline.sparkSession
    rows = here.join(story_so_far(outline, book, chapter), book, "left").join(known, book, "left")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).crossJoin(F.broadcast(lists))  # one row; by a number alone, as a dealing by book is one with that of the joins, and small ones are put together
    parts = [
        F.concat(F.lit(f"# Chapter {chapter}: "), F.coalesce("title", F.lit(""))), section("Summary", F.col("summary")), section("Story so far", F.col("so_far")), F.lit(f"## Limits\n{limits}"),
        section("Already introduced", F.col("known")), "lists",
    ]
    _large_rows(spark, "brief")
    return rows.select(book, F.concat_ws("\n\n", *parts).alias("brief"))


def accept_chapter(outline: DataFrame, introduced: DataFrame, worthy: DataFrame, chapter: int, recap: str | None, book: str, status: str = "accepted") -> tuple[DataFrame, DataFrame, DataFrame]:
    """After a chapter: the outline with its status and recap, the introduced words with the new ones behind, and the new words.

    ``worthy``: (book, token, first_pos) as gloss_worthy() gives; only words not introduced
    before are new. ``introduced``: (book, word, pos).
    """
    here = F.col("n") == chapter
    outline = outline.withColumn("status", F.when(here, status).otherwise(F.col("status"))).withColumn("recap", F.when(here & F.lit(bool(recap)), F.lit(recap)).otherwise(F.col("recap")))
    new = worthy.withColumnRenamed("token", "word").join(introduced.select(book, "word"), [book, "word"], "left_anti")
    last = introduced.groupBy(book).agg(F.max("pos").alias("last"))
    place = F.row_number().over(Window.partitionBy(book).orderBy("first_pos"))
    added = new.withColumn("place", place).join(last, book, "left").select(book, "word", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast(introduced.schema["pos"].dataType).alias("pos"))
    return outline, introduced.select(book, "word", "pos").unionByName(added), new


def syllabus(words: DataFrame, definitions: DataFrame, bands: tuple[str, ...], most: str) -> DataFrame:
    """(word, level, reading, gloss) of the bands up to ``most``: words (band, word) with their dictionary entry, '' without one."""
    wanted = bands[: bands.index(most) + 1]
    rows = words.where(F.col("band").isin(*wanted)).select("word", F.concat(F.lit("HSK"), "band").alias("level"))
    return with_gloss(rows, definitions)


def chapter_of(outline: DataFrame, n: int, order: str) -> DataFrame:
    """The first entry of chapter ``n``; an error without one."""
    first = outline.where(F.col("n") == n).orderBy(order).limit(1)
    there = first.agg(F.count("*").alias("c")).select(F.when(F.col("c") == 0, F.raise_error(F.lit(f"chapter {n} not found"))).otherwise(F.lit(True)).alias("ok"))
    return first.crossJoin(F.broadcast(there)).drop("ok")  # one row each
