"""Mixing sources to target weights by hierarchical budgeting.

The token budget is propagated through a domain-language-source tree by integer weights.
A node whose supply (its leaves' tokens times the most epochs) is less than its share
keeps its supply; what it can't use goes to its siblings in proportion to their weights.
As every level is filled against the supply of whole subtrees, a shortage reaches the
ancestors only where all siblings are exhausted. Each leaf then takes a prefix of the
stream formed by its seeded epochs: in each epoch its documents are ordered by a hash of
seed, epoch and id.

All of it is DataFrame arithmetic on longs. A leaf's rows are never ordered in one task:
tokens are summed per leaf and per bucket of the hash (which combines before the
shuffle), the bucket that the prefix ends in is found on those sums, and only that
bucket's rows are accumulated.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import join_heavy, keep_rows, materialise, text_key

BUCKETS = 4096
LEAF = ["domain", "lang", "source"]


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none. Each is as many runs of white space as end one."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    return (F.size(words) - F.when(F.element_at(words, -1) == "", 1).otherwise(0)).cast("long")


def weight_of(column: Column, weights: Mapping[str, int], default: int) -> Column:
    chosen = F.lit(default)
    for name, w in weights.items():
        chosen = F.when(column == name, w).otherwise(chosen)
    return chosen.cast("long")


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 hash bits of a document in an epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Share each parent's ``budget`` among children (``supply``, ``weight``); adds ``share``.

    Children are taken by supply per weight: those that their share exceeds come first and
    get their supply; the others divide the rest by weight, rounded on running sums so
    that nothing is lost.
    """
    key = [F.col(c) for c in parent] or [F.lit(1)]
    order = Window.partitionBy(*key).orderBy((F.col("supply") / F.col("weight")).asc_nulls_last(), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*key)
    out = children.withColumn("__used", F.coalesce(F.sum("supply").over(before), F.lit(0)))
    out = out.withColumn("__free", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    short = F.expr("supply * __free <= weight * (budget - __used)")
    out = out.withColumn("__short", short).withColumn("__short", F.min("__short").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("__rest", F.col("budget") - F.sum(F.when(F.col("__short"), F.col("supply")).otherwise(0)).over(all_of))
    out = out.withColumn("__w", F.when(F.col("__short"), 0).otherwise(F.col("weight")))
    out = out.withColumn("__total", F.sum("__w").over(all_of)).withColumn("__upto", F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.expr("(__rest * __upto) div greatest(__total, 1) - (__rest * (__upto - __w)) div greatest(__total, 1)")
    return out.withColumn("share", F.when(F.col("__short"), F.col("supply")).otherwise(part)).drop("__used", "__free", "__short", "__rest", "__w", "__total", "__upto")


def budgets(leaves: DataFrame, budget: Column, max_epochs: int, weights: dict[str, Mapping[str, int]], default: int = 1) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``supply`` and their ``share`` of ``budget``."""
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    level = leaves.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
    whole = level.agg(F.sum("supply").alias("all_supply"), F.sum("tokens").alias("all_tokens"))
    level = level.crossJoin(F.broadcast(whole))  # one row
    level = level.withColumn("budget", F.least(budget, F.col("all_supply"))).withColumn("weight", weight_of(F.col("domain"), weights.get("domain", {}), default))
    shares = fill(level, [], "domain").select("domain", F.col("share").alias("budget"))
    for depth in (2, 3):
        keys, child = LEAF[:depth], LEAF[depth - 1]
        level = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply"))
        level = level.join(shares, keys[:-1]).withColumn("weight", weight_of(F.col(child), weights.get(child, {}), default))
        shares = fill(level, keys[:-1], child).select(*keys, F.col("share").alias("budget"))
    return leaves.join(shares.withColumnRenamed("budget", "share"), LEAF)


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, Mapping[str, int]],
    budget_percent: int = 60,
    max_epochs: int = 4,
    seed: int = 17,
    default_weight: int = 1,
    keyed: bool = False,
) -> DataFrame:
    """One row per taken document and epoch.

    Columns: doc_id, domain, lang, source, epoch (from 0), n_tokens (words), taken_tokens
    (n_tokens, less only for the one document in which a leaf's prefix ends), order_key
    (the place in its epoch). The budget is ``budget_percent`` of all words; weights are
    positive integers by name, others ``default_weight``.

    A null domain, language or source is named 'unknown'. Texts without words are never
    taken. Rows that share a doc_id also share an order key; ties go by word count, then
    in any order: a leaf's taken tokens are exactly its share. An empty table gives no
    rows; further columns are ignored. ``keyed`` adds text_key (see shared.text_key).
    """
    named = [F.coalesce(c, F.lit("unknown")).alias(n) for c, n in ((domain, "domain"), (F.col("lang"), "lang"), (F.col("source"), "source"))]
    extra = [text_key(F.col("`text`")).alias("text_key")] if keyed else []
    rows = materialise(docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), *named, n_words(F.col("`text`")).alias("n_tokens"), *extra).where("n_tokens > 0"), "counts")
    total = rows.count()
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = budgets(leaves, F.expr(f"(all_tokens * {int(budget_percent)}) div 100"), max_epochs, weights, default_weight)
    plan = materialise(plan.select(*LEAF, "rows", F.expr("cast(share div tokens as int)").alias("whole"), F.expr("share % tokens").alias("rest")), "plan")
    held = join_heavy(rows, plan, LEAF, "rows", total).drop("rows")
    key = seeded(seed, F.col("whole"), F.col("doc_id"))
    bucket = F.expr(f"bucket_key div {2**60 // BUCKETS}")
    held = held.withColumn("bucket_key", key).withColumn("bucket", bucket)
    sums = held.where("rest > 0").groupBy(*LEAF, "bucket", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("before", F.sum("t").over(upto) - F.col("t")).where("before < rest and before + t >= rest")
    ends = ends.select(*LEAF, F.col("bucket").alias("end_bucket"), F.col("before").alias("end_before"))
    plan = materialise(plan.join(ends, LEAF, "left"), "ends")
    held = join_heavy(rows, plan, LEAF, "rows", total).drop("rows").withColumn("bucket_key", key).withColumn("bucket", bucket)
    # whole epochs, and of the last one the buckets before the end
    plain = held.withColumn("copies", F.col("whole") + F.when(F.col("bucket") < F.col("end_bucket"), 1).otherwise(0)).where("copies > 0")
    plain = plain.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("taken_tokens", F.col("n_tokens"))
    edge = held.where("bucket = end_bucket")
    order = Window.partitionBy(*LEAF, "bucket").orderBy("bucket_key", "n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("left", F.col("rest") - F.col("end_before") - F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("left > 0")
    edge = edge.withColumn("epoch", F.col("whole")).withColumn("taken_tokens", F.least("left", "n_tokens"))
    out = [*LEAF, "doc_id", "epoch", "n_tokens", "taken_tokens", *(["text_key"] if keyed else [])]
    taken = reduce(DataFrame.unionByName, [x.select(*out) for x in (plain, edge)])
    return taken.withColumn("order_key", seeded(seed, F.col("epoch"), F.col("doc_id")))


#: Production parameters: the domain of a source by its number, and the weights of the tree.
DOMAINS = ("web", "books", "reference", "forum")
WEIGHTS = {"domain": {"web": 40, "books": 25, "reference": 20, "forum": 15}, "lang": {"en": 55, "de": 15, "fr": 15, "es": 15}}


def domain_of_source() -> Column:
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d+)$", 1).cast("int")
    return F.when(number.isNotNull(), F.element_at(F.array(*map(F.lit, DOMAINS)), number % 4 + 1))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all columns, once for each epoch; a cut document stays whole.

    Rows without words (null or blank text) are not taken. A row is known by its doc_id,
    which may be null, and its text; rows that repeat both share the copies evenly. An
    empty table stays empty; working columns avoid the names of the table's own.
    """
    taken = mix(docs, domain_of_source(), WEIGHTS, keyed=True, **options)
    there = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), text_key(F.col("`text`")).alias("text_key"), F.lit(0).alias("copy"))
    both = taken.select("doc_id", "text_key", F.lit(1).alias("copy")).unionByName(there)
    kept = both.groupBy("doc_id", "text_key").agg(F.sum("copy").cast("long").alias("copies"), F.sum(1 - F.col("copy")).cast("long").alias("rows"))
    return keep_rows(docs, materialise(kept.where("copies > 0"), "taken"))
