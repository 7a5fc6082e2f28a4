"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each document gets the base measures and rates in thousandths. Labelled documents are dealt
into two halves by id. The learning half gives each stratum (language) a path of joint
rules, from loose to tight: at each of LEVELS a rate's cutoff is the smallest that so few of
the half's good documents exceed, if low-quality ones exceed it at least twice as often; a
document is rejected if any rate exceeds its cutoff.

The holdout half decides how far along the path a stratum may go. Of its n good documents k
are rejected by a rule, and the hypothesis "the rule rejects more than ``limit`` of the good
ones" is tested by the exact binomial tail P(Bin(n, limit) <= k). Rules are tested in the
order of the path until the first that isn't proven (a fixed sequence, which needs no
correction over its steps), each at delta divided by the number of strata (Bonferroni). So
with probability 1 - delta every rule in use rejects at most ``limit`` of its stratum's good
documents, whatever the learning half suggested. Of the proven rules the one that rejects
most low-quality documents of the learning half is used, the loosest of equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import WORD_GAP, crc_mod, materialise

STRATA = ("en", "de", "fr", "es")
RATES = ("symbol_rate", "mark_rate", "upper_rate", "dup_line_rate", "repeat_rate")
CUTOFFS = (10, 20, 50, 100, 150, 200, 300, 400, 500, 700)
#: Thousandths of the learning half's good documents that a rate's cutoff may reject, along the path.
LEVELS = (0, 1, 2, 5, 10, 15, 20, 30, 50)
RUN = 8


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside windows of eight words that occur at least twice; needs n >= 9 to be more than 0."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _bound(hashes, lambda h: F.transform(F.sequence(F.lit(0), n - RUN), lambda i: F.xxhash64(*[h[i + k] for k in range(RUN)])))

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            twice = lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["x"] == s[k]["x"])) | ((k < last) & (s[F.least(k + 1, last)]["x"] == s[k]["x"]))
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), twice), lambda k: s[k]["i"]))

        zero = F.struct(F.lit(0).alias("t"), F.lit(0).alias("e"))
        step = lambda a, p: F.struct((a["t"] + p + RUN - F.greatest(a["e"], p)).alias("t"), (p + RUN).alias("e"))
        return F.aggregate(_bound(order, starts), zero, step, lambda a: a["t"])

    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(n > RUN, _bound(windows, some)).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base measures, base_failed and the rates; one row per input row."""
    text = F.coalesce(F.col("`text`"), F.lit(""))
    out = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`lang`").alias("lang"), text.alias("t"))
    out = out.withColumn("words", F.array_remove(F.split("t", WORD_GAP), ""))
    out = out.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    dropped = lambda pattern: (F.length("t") - F.length(F.regexp_replace("t", pattern, ""))).cast("long")
    out = out.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        dropped(r"[#*$%&|<>]+").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.size("words")).alias("n_repeat_words"), F.size("lines").alias("n_lines"),
        dropped("[!?]+").alias("n_marks"), dropped(r"\p{Lu}+").alias("n_upper"),
    )
    rate = lambda part, whole: F.expr(f"cast((1000 * {part}) div greatest({whole}, 1) as int)")
    return out.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
        rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_marks", "word_chars").alias("mark_rate"), rate("n_upper", "word_chars").alias("upper_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"),
    )


def stratum(strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(F.col("lang").isin(*strata), F.col("lang")).otherwise("other")


def exceeds(cutoffs: str) -> Column:
    """Whether any rate is over its cutoff in the map ``cutoffs``; a rate without one rejects nothing."""
    over = F.lit(False)
    for r in RATES:
        over = over | F.coalesce(F.col(r) > F.element_at(cutoffs, r), F.lit(False))
    return over


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), summed term by term in logs; 0 (no evidence) from the mean on."""
    zero = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        big, small = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (big + F.log1p(F.exp(small - big))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(0.0)).otherwise(F.aggregate(terms, zero, step, lambda a: a["total"]))


def evidence(measured: DataFrame, labels: DataFrame, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """One row per labelled document that passes the base: stratum, held (holdout half), good, the rates.

    A document counts once: labels that repeat agree or don't count at all, and of rows
    that share a doc_id each rate's largest value counts, in the first stratum by name.
    """
    known = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`quality`").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    rows = measured.where("not base_failed").join(known, "doc_id").withColumn("stratum", stratum(strata))
    rows = rows.groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.first("low").alias("low"), *[F.max(r).alias(r) for r in RATES])
    return rows.select("stratum", (crc_mod("doc_id", 2) == 0).alias("held"), (F.col("low") == 1).alias("good"), *RATES)


def paths(rows: DataFrame) -> DataFrame:
    """(stratum, level, cutoffs): the learning half's rules; a level that bounds no rate has no row."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("value")) for r in RATES])).alias("r")
    grid = F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: c < F.col("r.value"))).alias("passed")
    counts = rows.where("not held").select("stratum", rates, F.col("good").cast("long").alias("good"), (~F.col("good")).cast("long").alias("bad"))
    counts = counts.select("stratum", F.col("r.rate").alias("rate"), grid, "good", "bad").groupBy("stratum", "rate", "passed").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # at most strata x rates x (cutoffs + 1) rows from here on
    whole = counts.groupBy("stratum", "rate").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("passed", "good", "bad")).alias("cells"))
    steps = whole.select("stratum", "rate", "n_good", "n_bad", "cells", F.posexplode(F.array(*map(F.lit, CUTOFFS))).alias("at", "cutoff"))
    above = lambda part: F.aggregate(F.filter("cells", lambda c: c["passed"] > F.col("at")), F.lit(0).cast("long"), lambda a, c: a + c[part])
    steps = steps.select("stratum", "rate", "cutoff", "n_good", "n_bad", above("good").alias("k"), above("bad").alias("caught")).where("caught > 0 and caught * n_good >= 2 * k * n_bad")
    levels = steps.select("*", F.posexplode(F.array(*map(F.lit, LEVELS))).alias("level", "share")).where("1000 * k <= share * n_good")
    least = levels.groupBy("stratum", "level", "rate").agg(F.min("cutoff").alias("cutoff"))
    return least.groupBy("stratum", "level").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rate", "cutoff")))).alias("cutoffs"))


def cutoffs(measured: DataFrame, labels: DataFrame, limit: float = 0.05, delta: float = 0.05, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """One row per stratum with a proven rule: stratum, cutoffs (a map from rate to cutoff)."""
    rows = materialise(evidence(measured, labels, strata), "evidence")
    rules = materialise(paths(rows), "paths")
    hit = F.when(exceeds("cutoffs"), 1).otherwise(0).cast("long")
    held = F.col("held") & F.col("good")
    tests = rows.join(F.broadcast(rules), "stratum").groupBy("stratum", "level").agg(  # rules: strata x levels rows at most
        F.sum(held.cast("long")).alias("n"), F.sum(F.when(held, hit)).alias("k"), F.sum(F.when(~F.col("held") & ~F.col("good"), hit)).alias("caught")
    )
    tests = tests.withColumn("log_p", log_binomial_tail(F.coalesce("k", F.lit(0).cast("long")), F.col("n"), limit))
    upto = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    tests = tests.withColumn("proven", F.min(F.col("log_p") <= F.log(F.lit(delta / (len(strata) + 1)))).over(upto))
    best = tests.where("proven").groupBy("stratum").agg(F.max(F.struct("caught", (-F.col("level")).alias("loose"))).alias("b"))
    chosen = best.select("stratum", (-F.col("b.loose")).alias("level"))
    return materialise(rules.join(chosen, ["stratum", "level"]).select("stratum", "cutoffs"), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, limit: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, the rates and stratum.

    A null or empty text has no words and fails the base; a null or unlisted language is
    stratum 'other'; repeated rows are judged alike; rows of ``labels`` without id or
    label, and contradicting ones, don't count; an empty table gives no rows; further columns are ignored.
    """
    measured = materialise(measures(docs), "measures")
    limits = F.broadcast(cutoffs(measured, labels, limit, delta))  # a row per stratum at most
    out = measured.withColumn("stratum", stratum()).join(limits, "stratum", "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~exceeds("cutoffs")).alias("kept"), *RATES, "stratum"
    )
