"""Queries of user patterns, edit reviews, titles, selections and images on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import fidelity, grading, ledger, profile, titles
from lectern.plans.queries import WHITE, table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Patterns as users write them for Python, and the same in the signs of DuckDB's expressions; the last is a literal phrase.
_PATTERNS = [
    ("begins with a capital", r"\A[A-Z]", "^[A-Z]"),
    ("two digits", r"\d\d", r"\p{Nd}{2}"),
    ("a word with th", r"(?i)\bth\w+\b", r"(^|[^\p{L}\p{N}_])[tT][hH][\p{L}\p{N}_]+"),
    ("a line ends with a stop", r"(?m)\.$", r"(?m)\.$"),
    ("other signs", r"[^\w\s.,]", rf"[^\p{{L}}\p{{N}}_.,{WHITE}]"),
    ("letters beyond ASCII", r"(?![a-zA-Z0-9_])\w", r"[^\x00-\x7f]"),
    (" of the ", None, None),
]
_HITS = ", ".join(f"CASE WHEN {f'regexp_matches(text, {rx!r})' if rx else f'contains(text, {name!r})'} THEN {name!r} END" for name, _, rx in _PATTERNS).replace("\\\\", "\\")


@query(f"SELECT doc_id, expressions, len(expressions)::INT AS expression_count FROM (SELECT doc_id, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS expressions FROM documents)")
def pattern_hits(spark, d):
    return grading.expression_hits(table(spark, d, "documents"), "doc_id", "text", [(name, rx) for name, rx, _ in _PATTERNS])


@query(f"""SELECT p_partkey, list_filter([CASE WHEN c > {fixed.MAX_CHANGED} THEN 'changed_ratio ' || c || ' > {fixed.MAX_CHANGED} (too much of the text edited)' END,
 CASE WHEN s > {fixed.MAX_SPAN} THEN 'max_edit_span ' || s || ' > {fixed.MAX_SPAN} (an edit is a rewrite, not a local fix — use policy)' END,
 CASE WHEN g > {fixed.MAX_GROWTH} THEN 'net_growth ' || g || ' > {fixed.MAX_GROWTH} (text added/removed wholesale, not corrected)' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT p_partkey, round_even(p_size / (p_partkey * 2 + 1)::DOUBLE, 4) AS c, p_size % 40 AS s, round_even(abs(p_size % 7 - 3) / (p_partkey * 2 + 1)::DOUBLE, 4) AS g FROM part)""")
def edit_reasons(spark, d):
    """Sizes are odd, so that no share lies halfway between two of four places, where engines' rounding differs."""
    n = F.col("p_size")
    rows = table(spark, d, "part").withColumn("m", F.struct(n.alias("changed"), (n % 40).alias("longest"), (n % 7 - 3).alias("growth")))
    return rows.select("p_partkey", fidelity.edit_reasons(F.col("p_partkey") * 2 + 1, F.col("m")).alias("reasons"))


@query()
def title_fit(spark, d):
    """Part names in a title box; a glyph's width follows from its code."""
    names = table(spark, d, "part").select("p_partkey", "p_name")
    signs = names.select("p_name").distinct().select(F.explode(F.split("p_name", "")).alias("ch")).where("ch <> ''").distinct()
    glyphs = signs.select("ch", ((F.ascii("ch") % 8 + 2) / 16).alias("width"))
    return titles.fit_titles(names, "p_partkey", "p_name", glyphs, 480, 160, 0.93, 0.24)


@query("""SELECT label, list_sort(list_distinct(list_concat(a, b))) AS together, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS rest
FROM (SELECT label, list_distinct(list(vec_id % 50)) AS a, list_distinct(list(vec_id % 30 + 25)) AS b FROM embeddings GROUP BY label)""")
def selection_sets(spark, d):
    e = table(spark, d, "embeddings").groupBy("label").agg(F.collect_set(F.col("vec_id") % 50).alias("a"), F.collect_set(F.col("vec_id") % 30 + 25).alias("b"))
    together, rest = ledger.select_more(F.col("a"), F.col("b"))
    return e.select("label", together.alias("together"), rest.alias("rest"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')"


@query(f"""SELECT conv_id, turn, coalesce(list(w ORDER BY first_place) FILTER (WHERE w IS NOT NULL), []) AS words FROM (SELECT conv_id, turn, w, min(k) AS first_place FROM
 (SELECT conv_id, turn, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS w, generate_subscripts(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END, 1) AS k FROM (SELECT conv_id, turn, {_WORDS} AS ws FROM conversations WHERE text IS NOT NULL)) GROUP BY ALL) GROUP BY conv_id, turn""")
def distinct_words(spark, d):
    """Each turn's words, once, in the order in which they come."""
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", ledger.ordered_distinct(T.latin_words(F.col("text"))).alias("words"))


@query("""SELECT p_partkey, (p_partkey % 3)::INT AS images, c AS coverage, p_size * 7 < 100 AND c > 0.3 AS image_page FROM (SELECT *, round_even(least(a / (CASE WHEN w * 800 <> 0 THEN w * 800 ELSE 1 END)::DOUBLE, 1), 3) AS c FROM
 (SELECT p_partkey, p_size, (p_partkey % 10) * 60 AS w, (CASE WHEN p_partkey % 3 > 0 THEN abs((p_size * 10 - 20) * (400 - 0.5 * p_size)) ELSE 0 END + CASE WHEN p_partkey % 3 > 1 THEN 50.0 * 40 ELSE 0 END)::DOUBLE AS a FROM part))""")
def page_images(spark, d):
    """Images of a page, the share of it that they cover, and whether it is an image page."""
    n, k = F.col("p_size"), F.col("p_partkey")
    box = lambda *cells: F.struct(*[c.cast("double").alias(name) for name, c in zip(("x0", "top", "x1", "bottom"), cells, strict=True)])
    boxes = F.array(box(F.lit(20), n * 0.5, n * 10, F.lit(400)), box(F.lit(0), F.lit(40), F.lit(50), F.lit(0)))
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.slice(boxes, F.lit(1), (k % 3).cast("int")).alias("images"))
    share = profile.image_coverage(F.col("images"), (k % 10) * 60, F.lit(800))
    return rows.select("p_partkey", F.size("images").alias("images"), share.alias("coverage"), profile.is_image_page(n * 7, share).alias("image_page"))
