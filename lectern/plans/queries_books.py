"""Queries of whole workflows: restoring by a policy, cutting chapters, serving a catalogue, grading, page building, state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import catalog, draft, fidelity, grading, imaging, integrity, joins, layout, ledger, profile, restore
from lectern.plans.queries import _PIXELS, _pixels, grams_sql, lines_sql, no_space_sql, strip_sql, table, words_sql

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def key():
    return F.col("p_partkey")


def part(spark, d):
    return table(spark, d, "part")


# ------------------------------------------------------------------ restoring
# Documents as books: ten lines a page; the first page is front matter, two pages of sentences, one skipped, verse after that.
_POLICY = restore.Policy(
    ranges=(restore.PageRange.parse("0", "front_matter"), restore.PageRange.parse("1-2", "body"), restore.PageRange.parse("3", "skip"), restore.PageRange(4, None, "body", "verse")),
    furniture=(r"^\S+$", r"\|"), normalise=(("the", "THE"), ("THE ", "<the>")),
)
_BOOK_LINES = f"(SELECT doc_id, (k // 10)::INT AS page, (k % 10)::INT AS pos, text FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS k, unnest(ls) AS text FROM (SELECT doc_id, {lines_sql('text')} AS ls FROM documents)))"
_RESTORED = f"""l AS {_BOOK_LINES}, f AS (SELECT *, regexp_matches(text, '^[^\\s]+$') OR contains(text, '|') AS furniture, CASE WHEN page = 0 THEN 0 WHEN page <= 2 THEN 1 WHEN page = 3 THEN 2 ELSE 3 END AS r FROM l),
k AS (SELECT * FROM f WHERE NOT furniture),
b AS (SELECT *, coalesce(regexp_matches(lag(rtrim(text)) OVER (PARTITION BY doc_id, r ORDER BY page, pos), '[.!?…:”»)]$'), false) AS brk FROM k),
g AS (SELECT *, CASE r WHEN 0 THEN row_number() OVER (PARTITION BY doc_id, r ORDER BY page, pos) WHEN 1 THEN sum(brk::INT) OVER (PARTITION BY doc_id, r ORDER BY page, pos) ELSE 0 END AS para FROM b),
u AS (SELECT doc_id, r, para, CASE WHEN r = 3 THEN string_agg(text, chr(10) ORDER BY page, pos) ELSE string_agg(text, ' ' ORDER BY page, pos) END AS raw, count(*) AS n FROM g WHERE r <> 2 GROUP BY doc_id, r, para),
v AS (SELECT *, replace(replace(raw, 'the', 'THE'), 'THE ', '<the>') AS text, row_number() OVER (PARTITION BY doc_id ORDER BY r, para) - 1 AS unit FROM u)"""


def _book_lines(spark, d):
    rows = profile.exploded_lines(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.expr("cast(pos div 10 as int)").alias("page"), (F.col("pos") % 10).alias("pos"), F.col("line").alias("text"))


@query(f"WITH {_RESTORED} SELECT doc_id, unit::INT AS unit, CASE WHEN r = 3 THEN 'verse' ELSE 'para' END AS kind, text FROM v")
def restore_units(spark, d):
    return restore.restore(_book_lines(spark, d), "doc_id", _POLICY, strict=False)[0]


@query(f"""WITH {_RESTORED}, i AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page, pos) AS t FROM k GROUP BY doc_id), o AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY unit) AS t, count(*) AS n,
 sum((length(raw) - length(replace(raw, 'the', ''))) // 3)::BIGINT AS h1, sum((length(replace(raw, 'the', 'THE')) - length(replace(replace(raw, 'the', 'THE'), 'THE ', ''))) // 4)::BIGINT AS h2, (sum(n) FILTER (r = 1) - count(*) FILTER (r = 1))::BIGINT AS j FROM v GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS lines_in, count(*) FILTER (NOT furniture AND r <> 2) AS lines_out, count(*) FILTER (regexp_matches(text, '^[^\\s]+$')) AS d1 FROM f GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(i.t, '') AS a, coalesce(o.t, '') AS z FROM c LEFT JOIN i USING (doc_id) LEFT JOIN o USING (doc_id)),
m AS (SELECT x.doc_id, CASE WHEN length({no_space_sql('a')}) > 0 THEN length({no_space_sql('z')}) / length({no_space_sql('a')}) ELSE 1.0 END AS ratio, CASE WHEN len(p.g) > 0 THEN len(list_intersect(p.g, q.g)) / len(p.g) ELSE 1.0 END AS held
 FROM x JOIN {grams_sql('doc_id', "(SELECT doc_id, replace(replace(a, 'the', 'THE'), 'THE ', '<the>') AS text FROM x)")} p USING (doc_id) JOIN {grams_sql('doc_id', "(SELECT doc_id, z AS text FROM x)")} q USING (doc_id))
SELECT doc_id, lines_in, lines_out, d1 AS single_words, coalesce(j, 0)::BIGINT AS joins_made, coalesce(h1, 0) AS first_hits, coalesce(h2, 0) AS second_hits, coalesce(n, 0) AS paragraphs, round_even(ratio, 4) AS char_ratio, round_even(held, 4) AS ngram_containment,
 ratio BETWEEN 0.98 AND 1.02 AND held >= 0.995 AS gate_pass FROM c JOIN m USING (doc_id) LEFT JOIN o USING (doc_id)""")
def restore_report(spark, d):
    r = restore.restore(_book_lines(spark, d), "doc_id", _POLICY, strict=False)[1]
    return r.select(
        "doc_id", "lines_in", "lines_out", F.coalesce(F.try_element_at("furniture_dropped", F.lit(_POLICY.furniture[0])), F.lit(0)).alias("single_words"), "joins_made", F.col("normalisations")[0].alias("first_hits"),
        F.col("normalisations")[1].alias("second_hits"), "paragraphs", "char_ratio", "ngram_containment", "gate_pass",
    )


@query(f"""WITH l AS {_BOOK_LINES}, h AS (SELECT doc_id, list(k ORDER BY k) AS spots FROM (SELECT doc_id, page * 10 + pos AS k, text FROM l) WHERE text = (SELECT min(text) FROM (SELECT text, count(*) AS n FROM l GROUP BY text ORDER BY n DESC, text LIMIT 1)) GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(spots) = 1 THEN spots[1] END AS pos, CASE WHEN spots IS NULL THEN 'missing' WHEN len(spots) > 1 THEN 'ambiguous' END AS error, CASE WHEN len(spots) >= 2 THEN spots[2] END AS second FROM documents LEFT JOIN h USING (doc_id)""")
def anchor_errors(spark, d):
    lines = _book_lines(spark, d).select("doc_id", (F.col("page") * 10 + F.col("pos")).alias("pos"), "text")
    top = lines.groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").first()["text"]
    docs = table(spark, d, "documents").select("doc_id")
    second = joins.locate_anchor(lines, docs, "doc_id", "text", top, 2).select("doc_id", F.col("pos").alias("second"))
    return joins.locate_anchor(lines, docs, "doc_id", "text", top).join(second, "doc_id")


@query(f"""SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN lower(text) END, text) AS text FROM documents""")
def effective_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return restore.effective(docs, docs.where("doc_id % 4 = 0").withColumn("text", F.lower("text")), "doc_id")


@query(f"""WITH x AS (SELECT page_id, length({no_space_sql('html')}) AS n FROM pages) SELECT page_id % 7 AS book, count(*) AS pages_processed, (count(*) * 2)::BIGINT AS total_lines, sum(2 * n)::BIGINT AS total_chars, list(page_id::INT ORDER BY page_id) FILTER (page_id % 3 = 0) AS dedupe_pages FROM x GROUP BY 1""")
def extraction_totals(spark, d):
    line = F.struct(F.col("html").alias("text"))
    rows = table(spark, d, "pages").select((F.col("page_id") % 7).alias("book"), F.col("page_id").cast("int").alias("page"), F.array(line, line).alias("lines"), (F.col("page_id") % 3 == 0).alias("dedupe_applied"))
    return restore.extraction_totals(rows, "book").drop("per_page_chars")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN [(user_id % 50)::INT] ELSE list_transform(range(user_id % 50, user_id % 50 + event_id % 4 + 1), lambda x: x::INT) END AS wanted,
 CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 5 = 1 THEN false ELSE user_id % 9 > 0 AND (event_id % 7) / (user_id % 9) < 0.7 END AS dedupes FROM events""")
def page_specs(spark, d):
    n, u = F.col("event_id"), F.col("user_id") % 50
    spec = F.when(n % 3 == 0, "").when(n % 3 == 1, u.cast("string")).otherwise(F.format_string("%d-%d", u, u + n % 4))
    mode = F.when(n % 5 == 0, "on").when(n % 5 == 1, "off").otherwise("auto")
    return table(spark, d, "events").select("event_id", T.page_range(spec).alias("wanted"), profile.should_dedupe(mode, F.col("user_id") % 9, n % 7).alias("dedupes"))


# ------------------------------------------------------------------ sidecars
_ENDINGS = ["txt", "md", "doc", "markdown", "png"]


@query(f"""WITH f AS (SELECT p_brand AS stem, p_brand || '-transcript.' || e AS name, list_position({list(fixed.TRANSCRIPT_ENDINGS)}, e) AS rank FROM (SELECT DISTINCT p_brand, {_ENDINGS}[p_partkey % 5 + 1] AS e FROM part WHERE p_partkey % 3 = 0))
SELECT stem, list(name ORDER BY rank)[1] AS chosen, list(name ORDER BY rank)[2:] AS extras FROM f WHERE rank IS NOT NULL GROUP BY stem""")
def sidecars(spark, d):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (key() % 5 + 1).cast("int"))
    files = part(spark, d).where(key() % 3 == 0).select(F.concat("p_brand", F.lit("-transcript."), ending).alias("name")).distinct()
    return profile.sidecars(files, part(spark, d).select(F.col("p_brand").alias("stem")), "transcript", fixed.TRANSCRIPT_ENDINGS)


@query(f"SELECT doc_id, length(text)::INT AS chars, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS lines, {strip_sql('text')} = '' AS empty, regexp_matches(text, '(?m)^#{{1,6}}\\s|```') AS looks_structured, text[:1200] AS preview FROM documents")
def transcript_profile(spark, d):
    return profile.transcript_profile(table(spark, d, "documents"), "doc_id", "text")


# ------------------------------------------------------------------ cutting chapters
# Conversations as restored texts: each turn begins a paragraph with its number.
_TEXTS = "(SELECT conv_id AS book, string_agg('[' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10) AS text, max(turn) AS last FROM conversations GROUP BY conv_id)"
_PARAS = f"p AS (SELECT book, generate_subscripts(ps, 1) - 1 AS para, unnest(ps) AS text FROM (SELECT book, string_split(regexp_replace(text, '\\n+$', ''), chr(10) || chr(10)) AS ps FROM {_TEXTS})), o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY book ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p)"


def _texts(spark, d):
    cell = F.struct("turn", F.format_string("[%d] %s", "turn", "text").alias("t"))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("book")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return rows.select("book", F.concat(F.array_join(F.transform("c", lambda c: c["t"]), "\n\n"), F.lit("\n")).alias("text"))


def _anchors(spark, d):
    """Chapters begin with turns 1 and 3; figures belong to turns 1 and 2."""
    books = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("book")).agg(F.max("turn").alias("last"))
    cells = F.array(F.struct(F.lit(1).alias("n"), F.lit("[1] ").alias("anchor"), F.lit("One").alias("toc_label")), F.struct(F.lit(2).alias("n"), F.lit("[3] ").alias("anchor"), F.lit("Two").alias("toc_label")))
    return books.select("book", F.explode(cells).alias("c")).select("book", "c.*")


def _starts(spark, d):
    paras = draft.paragraphs(_texts(spark, d), "book", "text")
    located = draft.locate(_anchors(spark, d), _texts(spark, d), "book", "text")
    return draft.start_paragraphs(located, paras, "book"), paras, located


_LOCATED = f"""a AS (SELECT book, text, n, anchor, label, (length(text) - length(replace(text, anchor, ''))) // 4 AS hits, instr(text, anchor) - 1 AS at FROM {_TEXTS}, (VALUES (1, '[1] ', 'One'), (2, '[3] ', 'Two')) t(n, anchor, label)),
s AS (SELECT book, n, label, (SELECT max(para) FROM o WHERE o.book = a.book AND o.off <= a.at) AS para FROM a WHERE hits = 1)"""


@query(f"WITH {_PARAS}, {_LOCATED} SELECT a.book, a.n, CASE WHEN hits = 0 THEN 'anchor not found' WHEN hits > 1 THEN 'anchor ambiguous (' || hits || ' hits)' END AS error, s.para::INT AS para FROM a LEFT JOIN s USING (book, n)")
def draft_anchors(spark, d):
    starts, _, located = _starts(spark, d)
    return located.select("book", "n", "error").join(starts.select("book", "n", "para"), ["book", "n"], "left")


@query(f"""WITH {_PARAS}, {_LOCATED}, c AS (SELECT o.book, o.para, o.text, arg_max(s.n, s.n) AS n, arg_max(s.label, s.n) AS label FROM o JOIN s ON s.book = o.book AND s.para <= o.para GROUP BY ALL),
f AS (SELECT book, para, string_agg('![Fig ' || n || '](../images/fig0' || n || '.png)', chr(10) || chr(10) ORDER BY n) AS pictures FROM (SELECT book, para, unnest([1, 2]) AS n FROM s WHERE n = 1) GROUP BY ALL)
SELECT book, n, 'chapters/ch0' || n || '.md' AS file, label AS toc_label, count(*) AS paragraphs, '# ' || label || chr(10) || chr(10) || string_agg(text || coalesce(chr(10) || chr(10) || pictures, ''), chr(10) || chr(10) ORDER BY para) || chr(10) AS text FROM c LEFT JOIN f USING (book, para) GROUP BY book, n, label""")
def draft_chapters(spark, d):
    starts, paras, _ = _starts(spark, d)
    figures = starts.where("n = 1").select("book", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "para").withColumn("caption", F.format_string("Fig %d", "n")).withColumn("file", F.format_string("fig%02d.png", "n"))
    return draft.chapters(starts.select("book", "n", "toc_label", "para"), paras, figures, "book")


@query(f"WITH {_PARAS}, {_LOCATED}, t AS (SELECT book, count(*) AS total FROM o GROUP BY book), b AS (SELECT book, min(para) AS first FROM s GROUP BY book) SELECT book, CASE WHEN first IS NULL THEN 0 ELSE total - first END AS assigned, coalesce(first, 0) AS dropped, total, first IS NOT NULL AS ok FROM t LEFT JOIN b USING (book)")
def draft_accounting(spark, d):
    starts, paras, _ = _starts(spark, d)
    none = starts.limit(0).select("book", F.lit(0).alias("n"), F.col("para"), F.lit("").alias("caption"), F.lit("").alias("file"))
    made = draft.chapters(starts.select("book", "n", "toc_label", "para"), paras, none, "book")
    return draft.accounting(made, draft.front_matter(starts, paras, "book"), paras, "book")


_FIGURES = "(SELECT p_partkey, p_brand AS book, (p_partkey % 9)::INT AS para, (p_partkey % 12)::INT AS page, (p_partkey % 5)::INT AS idx FROM part)"


def _figures(spark, d):
    box = F.struct(*[(F.lit(k) + F.col("page") * 1.5).alias(c) for k, c in ((10.0, "x0"), (20.0, "top"), (300.0, "x1"), (410.0, "bottom"))])
    pages = part(spark, d).select(F.col("p_brand").alias("book")).distinct().withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("images", F.array_repeat(box, (F.col("page") % 4).cast("int")))
    figures = part(spark, d).select(F.col("p_brand").alias("book"), key().alias("n"), (key() % 9).cast("int").alias("para"), (key() % 12).cast("int").alias("page"), (key() % 5).cast("int").alias("index"))
    return figures, pages


@query(f"SELECT book, p_partkey AS n, CASE WHEN para < 2 THEN 'anchor in dropped front matter' WHEN page > 9 THEN 'page ' || page || ' not found' ELSE 'image index ' || idx || ' out of range on page ' || page || ' (has ' || (page % 4) || ')' END AS error FROM {_FIGURES} WHERE para < 2 OR page > 9 OR idx >= page % 4")
def figure_errors(spark, d):
    figures, pages = _figures(spark, d)
    starts = part(spark, d).select(F.col("p_brand").alias("book")).distinct().withColumn("para", F.lit(2))
    return draft.figure_errors(figures, starts, pages, "book")


@query(f"""WITH b AS (SELECT book, p_partkey AS n, round_even((10 + page * 1.5) * (300 / 72.0), 0) AS x0, round_even((20 + page * 1.5) * (300 / 72.0), 0) AS y0, round_even((300 + page * 1.5) * (300 / 72.0), 0) AS x1, round_even((410 + page * 1.5) * (300 / 72.0), 0) AS y1 FROM {_FIGURES} WHERE page <= 9 AND idx < page % 4)
SELECT book, n, least(480, x1 - x0)::INT AS width, (CASE WHEN x1 - x0 > 480 THEN round_even((y1 - y0) * 480 / (x1 - x0), 0) ELSE y1 - y0 END)::INT AS height FROM b""")
def figure_boxes(spark, d):
    figures, pages = _figures(spark, d)
    out = draft.figure_boxes(figures, pages, "book")
    return out.where("box.x0 is not null").select("book", "n", "width", "height")


# ------------------------------------------------------------------ archives and files
_LINKED = "(SELECT page_id % 5 AS book, 'OEBPS/p' || page_id || '.xhtml' AS name, '<p id=\"a' || page_id % 4 || '\"/><a href=\"#a1\"/><a href=\"p' || (page_id * 3 % 60) || '.xhtml#x\"/><a href=\"https://z\"/><img src=\"../OEBPS/./p' || (page_id + 5) || '.xhtml\"/>' AS html, page_id FROM pages)"


@query(f"""WITH f AS {_LINKED} SELECT book, name, '#a1' AS href, 'dead fragment' AS error FROM f WHERE page_id % 4 <> 1
UNION ALL SELECT book, name, 'p' || (page_id * 3 % 60) || '.xhtml#x', 'dead link' FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.book = f.book AND g.page_id = f.page_id * 3 % 60)
UNION ALL SELECT book, name, '../OEBPS/./p' || (page_id + 5) || '.xhtml', 'dead link' FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.page_id = f.page_id + 5)""")
def dead_links(spark, d):
    n = F.col("page_id")
    html = F.format_string('<p id="a%d"/><a href="#a1"/><a href="p%d.xhtml#x"/><a href="https://z"/><img src="../OEBPS/./p%d.xhtml"/>', n % 4, n * 3 % 60, n + 5)
    rows = table(spark, d, "pages").select((n % 5).alias("book"), F.format_string("OEBPS/p%d.xhtml", n).alias("name"), html.alias("html"))
    return integrity.dead_links(rows, "book", "name", "html", rows)


@query("SELECT c_custkey % 50 AS book, count(*) FILTER (c_acctbal < 0) AS errors, count(*) FILTER (c_acctbal < 0) = 0 AS passed FROM customer GROUP BY 1")
def integrity_verdict(spark, d):
    rows = table(spark, d, "customer").withColumn("book", F.col("c_custkey") % 50)
    return integrity.verdict(rows.select("book").distinct(), "book", [rows.where("c_acctbal < 0 and c_custkey % 2 = 0"), rows.where("c_acctbal < 0 and c_custkey % 2 = 1")])


@query("""SELECT p_brand AS file, p_name || p_partkey AS name, p_size::BIGINT AS bytes, md5(p_name) AS md5 FROM part p WHERE p_partkey % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_partkey % 47 = 1 AND q.p_partkey % 9 <> 0 AND q.p_partkey <= p.p_partkey)""")
def checksum_manifest(spark, d):
    size = F.when(key() % 47 == 1, "many").otherwise(F.col("p_size").cast("string"))
    line = F.when(key() % 9 == 0, F.when(key() % 2 == 0, "# note").otherwise(" ")).otherwise(F.concat_ws("\t", F.concat("p_name", key().cast("string")), size, F.md5("p_name")))
    return integrity.checksums(part(spark, d).select(F.col("p_brand").alias("file"), "p_partkey", line.alias("line")), "file", "p_partkey", "line")


@query("SELECT p_brand AS family, list_sort(list_distinct(list(p_size) FILTER (p_partkey % 4 > 0))) AS sizes, sum(p_partkey)::BIGINT AS bytes, list_has_all(list(p_size) FILTER (p_partkey % 4 > 0), [8, 10, 12]) AS ui_ready FROM part GROUP BY p_brand")
def font_families(spark, d):
    number = F.when(key() % 4 > 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise("_bold")
    files = part(spark, d).select(F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), number, F.lit(".cpfont")).alias("rel"), key().alias("size"))
    return integrity.font_families(files)


@query("""SELECT p_brand, name, newest::INT AS newest, listed::INT AS listed FROM (SELECT p_brand, p_name || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name || p_partkey) AS newest,
 row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 5 <> 0, lower(p_name || p_partkey), p_name || p_partkey) AS listed FROM part) WHERE newest <= 20 AND listed <= 24""")
def file_orders(spark, d):
    files = part(spark, d).select("p_brand", F.concat("p_name", key().cast("string")).alias("name"), F.col("p_size").alias("mtime"), (key() % 5 == 0).alias("is_folder"))
    newest = integrity.newest_files(files, ["p_brand"], 20).select("p_brand", "name", F.col("place").alias("newest"))
    return newest.join(integrity.listing(files, ["p_brand"], 24).select("p_brand", "name", F.col("place").alias("listed")), ["p_brand", "name"])


# ------------------------------------------------------------------ catalogue
_FILES = "(SELECT p_partkey % 3 AS root, CASE WHEN p_partkey % 10 = 0 THEN '/shared/' || p_size || '.epub' ELSE '/r' || (p_partkey % 3) || '/' || p_brand || '/' || p_size || p_type || '.epub' END AS path, CASE WHEN p_partkey % 10 = 0 THEN p_size || '.epub' ELSE p_brand || '/' || p_size || p_type || '.epub' END AS rel FROM part)"


def _files(spark, d):
    shared, r = key() % 10 == 0, (key() % 3).cast("string")
    name = F.concat(F.col("p_size").cast("string"), F.when(shared, "").otherwise(F.col("p_type")), F.lit(".epub"))
    rel = F.when(shared, name).otherwise(F.concat("p_brand", F.lit("/"), name))
    path = F.when(shared, F.concat(F.lit("/shared/"), name)).otherwise(F.concat(F.lit("/r"), r, F.lit("/"), rel))
    return part(spark, d).select((key() % 3).alias("root"), path.alias("path"), rel.alias("rel"), name.alias("name"), F.lit(1).alias("size"), F.lit(0.0).alias("mtime")).distinct()


@query(f"""WITH f AS (SELECT min(root) AS root, path, any_value(rel) AS rel FROM {_FILES} GROUP BY path), i AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY root, path) AS n FROM f),
m AS (SELECT *, regexp_extract(rel, '([^/]*)$', 1) AS name FROM i), t AS (SELECT *, CASE WHEN length(path) % 3 = 0 THEN 'T ' || name WHEN length(path) % 3 = 1 AND length(rel) % 2 = 0 THEN 'J ' || name ELSE regexp_replace(name, '\\.epub$', '') END AS title FROM m)
SELECT path, rel, sha1(CASE WHEN n = 1 THEN rel ELSE path END)[:12] AS id, title, CASE WHEN length(path) % 3 = 0 THEN 'Ann' ELSE '' END AS author, regexp_replace(title, '[^A-Za-z0-9._-]+', '-', 'g') AS slug FROM t""")
def library_scan(spark, d):
    files = _files(spark, d)
    n = F.length("path")
    own = files.select("path", F.when(n % 3 == 0, F.concat(F.lit("T "), "name")).alias("title"), F.when(n % 3 == 0, "Ann").otherwise("").alias("author"), F.lit("").alias("language")).distinct()
    other = files.select("path", F.when((n % 3 == 1) & (F.length("rel") % 2 == 0), F.concat(F.lit("J "), "name")).alias("title"), F.lit("").alias("author"), F.lit(None).cast("string").alias("language")).distinct()
    return catalog.library(files, own, other).select("path", "rel", "id", "title", "author", "slug")


_BOOKS = "(SELECT sha1(p_partkey::VARCHAR)[:12] AS id, p_name AS title, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS author, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_type[:2] END AS language, p_partkey::VARCHAR AS rel, p_partkey::DOUBLE AS mtime FROM part)"


def _books(spark, d):
    return part(spark, d).select(
        T.short_hash(key().cast("string")).alias("id"), F.col("p_name").alias("title"), F.when(key() % 11 == 0, "").otherwise(F.col("p_brand")).alias("author"),
        F.when(key() % 13 == 0, "").otherwise(F.substring("p_type", 1, 2)).alias("language"), key().cast("string").alias("rel"), key().cast("double").alias("mtime"),
    )


@query(f"""SELECT place::INT AS place, CASE WHEN language = '' THEN 'Unknown language' ELSE upper(language) END AS title, n || ' book(s)' AS summary, 'http://h/opds/languages/' || CASE WHEN language = '' THEN 'unknown' ELSE language END AS href FROM (SELECT lower(language) AS language, count(*) AS n, row_number() OVER (ORDER BY lower(language) = '', lower(language)) AS place FROM {_BOOKS} GROUP BY 1)
UNION ALL SELECT (1000 + row_number() OVER (ORDER BY author = '', lower(author), author))::INT, CASE WHEN author = '' THEN 'Unknown author' ELSE author END, count(*) || ' book(s)', 'http://h/opds/authors/' || sha1(author)[:10] FROM {_BOOKS} GROUP BY author""")
def group_index(spark, d):
    b = _books(spark, d)
    languages = catalog.group_index(catalog.grouped(b, F.lower("language"), "language"), "languages", "http://h")
    authors = catalog.group_index(catalog.grouped(b, F.col("author"), "author"), "authors", "http://h")
    return languages.unionByName(authors.withColumn("place", F.col("place") + 1000))


@query(f"SELECT id, 'author' AS kind FROM {_BOOKS} WHERE author = 'Brand#5' UNION ALL SELECT id, 'none' FROM {_BOOKS} WHERE language = '' UNION ALL SELECT id, 'language' FROM {_BOOKS} WHERE lower(language) = 'ec'")
def drill_down(spark, d):
    b = _books(spark, d)
    key = spark.range(1).select(catalog.author_key(F.lit("Brand#5")).alias("k")).first()["k"]
    out = [catalog.drill_down(b, "authors", key).select("id", F.lit("author").alias("kind")), catalog.drill_down(b, "languages", "unknown").select("id", F.lit("none").alias("kind")), catalog.drill_down(b, "languages", "EC").select("id", F.lit("language").alias("kind"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


_ENTRY = """'<entry><id>urn:book:' || id || '</id><title>' || title || '</title>' || CASE WHEN author <> '' THEN '<author><name>' || author || '</name></author>' ELSE '' END || '<link rel="http://opds-spec.org/acquisition" type="application/epub+zip" href="http://h/book/' || id || '/' || replace(title, ' ', '-') || '.epub"/></entry>'"""


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY lower(title), rel) AS rn, count(*) OVER () AS total FROM {_BOOKS}), w AS (SELECT * FROM n WHERE rn BETWEEN 11 AND 20)
SELECT '<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><id>urn:catalog:opds:search</id><title>Search (2)</title><updated>' || strftime(to_timestamp(max(mtime)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || '</updated>' ||
 '<link rel="self" href="http://h/opds/search?page=2&amp;q=cold" type="application/atom+xml;profile=opds-catalog;kind=acquisition"/><link rel="start" href="http://h/opds" type="application/atom+xml;profile=opds-catalog;kind=navigation"/>' ||
 '<link rel="search" href="http://h/opds/opensearch.xml" type="application/opensearchdescription+xml"/><link rel="search" href="http://h/opds/search?q={{searchTerms}}" type="application/atom+xml"/>' ||
 '<link rel="previous" href="http://h/opds/search?page=1&amp;q=cold" type="application/atom+xml;profile=opds-catalog;kind=acquisition"/>' || CASE WHEN any_value(total) > 20 THEN '<link rel="next" href="http://h/opds/search?page=3&amp;q=cold" type="application/atom+xml;profile=opds-catalog;kind=acquisition"/>' ELSE '' END ||
 string_agg({_ENTRY}, '' ORDER BY rn) || '</feed>' AS xml FROM w""")
def page_feed(spark, d):
    return catalog.page_feed(_books(spark, d), [F.lower("title"), F.col("rel")], 2, 10, "http://h", "/opds/search", "Search", "cold")


@query(f"""SELECT 'http://h/opds/languages/' || language AS href, '<entry><title>' || upper(language) || '</title><id>urn:nav:' || sha1('http://h/opds/languages/' || language)[:12] || '</id><content type="text">' || count(*) || ' book(s)</content><link rel="subsection" href="http://h/opds/languages/' || language || '" type="application/atom+xml;profile=opds-catalog;kind=acquisition"/></entry>' AS entry FROM (SELECT lower(language) AS language FROM {_BOOKS}) WHERE language <> '' GROUP BY language""")
def navigation_entries(spark, d):
    groups = catalog.grouped(_books(spark, d).where("language <> ''"), F.lower("language"), "language")
    return catalog.navigation_entries(catalog.group_index(groups, "languages", "http://h")).select("href", "entry")


@query(f"""SELECT rel, '{{"id":"' || id || '","rel":"' || rel || '","title":"' || title || '","author":"' || author || '","language":"' || language || '"}}' AS line, CASE WHEN count(*) OVER (PARTITION BY lower(author), lower(title)) > 1 THEN count(*) OVER (PARTITION BY lower(author), lower(title)) || ' books share this label' END AS note FROM {_BOOKS}""")
def library_report(spark, d):
    return catalog.report(_books(spark, d))


@query("SELECT p_brand, p_partkey, rn::INT AS rn FROM (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rn, count(*) OVER () AS n FROM part) WHERE rn > (ceil(n / 24.0) - 1) * 24")
def sheet_clamp(spark, d):
    return catalog.page(part(spark, d), [F.desc("p_size"), key()], 10**6, 24, clamp=True).select("p_brand", "p_partkey", "rn")


_NEXT = "(SELECT page_id, CASE WHEN page_id % 9 <> 8 THEN page_id + 1 WHEN page_id % 2 = 0 THEN page_id - 3 END AS next FROM pages)"


@query(f"""WITH RECURSIVE n AS {_NEXT}, w(chain, node, place) AS (SELECT page_id, page_id, 0 FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT w.chain, n.next, w.place + 1 FROM w JOIN n ON n.page_id = w.node WHERE n.next IS NOT NULL AND w.place < 5)
SELECT chain, 'u' || node AS url, min(place)::INT AS place FROM w GROUP BY ALL""")
def next_links(spark, d):
    n = F.col("page_id")
    following = F.when(n % 9 != 8, n + 1).when(n % 2 == 0, n - 3)
    links = table(spark, d, "pages").select(F.format_string("u%d", n).alias("url"), F.when(following.isNotNull(), F.format_string("u%d", following)).alias("next"))
    return joins.chase(links, table(spark, d, "pages").where(n % 5 == 0).select(n.alias("chain"), F.format_string("u%d", n).alias("url")), 6)


# ------------------------------------------------------------------ grading
@query("""SELECT p_partkey, p_name AS word, CASE WHEN p_size > 25 THEN p_type ELSE '' END AS reading, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS gloss FROM part""")
def gloss_join(spark, d):
    lexicon = part(spark, d).where("p_size > 25").select(key().cast("string").alias("word"), F.col("p_type").alias("reading"), F.col("p_brand").alias("gloss"))
    out = grading.with_gloss(part(spark, d).select("p_partkey", F.col("p_name").alias("shown"), key().cast("string").alias("word")), lexicon)
    return out.select("p_partkey", F.col("shown").alias("word"), "reading", "gloss")


@query("""SELECT band, (row_number() OVER (PARTITION BY band ORDER BY word) - 1) AS place, word, count(*) OVER (PARTITION BY band) AS n
FROM (SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type ELSE 'SUP' END AS band, p_name || p_partkey AS word FROM part WHERE p_partkey % 8 <> 0)""")
def vocabulary_bands(spark, d):
    rows = part(spark, d).select(F.concat("p_name", key().cast("string")).alias("word"), F.col("p_type").alias("level"), F.when(key() % 8 == 0, "personal").otherwise("graded").alias("source"))
    return grading.band_words(rows, ("ECONOMY", "PROMO"), "SUP")


_DEFS = "CASE p_size % 4 WHEN 0 THEN ['see ' || p_type] WHEN 1 THEN [p_type, 'see x', p_brand || ' ' || p_partkey, 'third'] WHEN 2 THEN [repeat(p_type, 9), repeat(p_brand, 9)] ELSE [p_name] END"


@query(f"""WITH b AS (SELECT arg_max(p_partkey, (len({_DEFS}), -p_partkey)) AS k FROM part GROUP BY p_name), e AS (SELECT p_name AS word, {_DEFS} AS defs FROM part WHERE p_partkey IN (SELECT k FROM b)),
g AS (SELECT word, array_to_string((CASE WHEN len(list_filter(defs, lambda x: NOT starts_with(x, 'see '))) > 0 THEN list_filter(defs, lambda x: NOT starts_with(x, 'see ')) ELSE defs END)[1:2], '; ') AS g FROM e)
SELECT word, 'hǎo ma' AS reading, CASE WHEN length(g) > 110 THEN rtrim(g[:107], ' ;,') || '...' ELSE g END AS gloss FROM g""")
def best_definitions(spark, d):
    t, b = F.col("p_type"), F.col("p_brand")
    defs = F.when(F.col("p_size") % 4 == 0, F.array(F.concat(F.lit("see "), t))).when(F.col("p_size") % 4 == 1, F.array(t, F.lit("see x"), F.concat(b, F.lit(" "), key().cast("string")), F.lit("third")))
    defs = defs.when(F.col("p_size") % 4 == 2, F.array(F.repeat(t, F.lit(9)), F.repeat(b, F.lit(9)))).otherwise(F.array("p_name"))
    return grading.best_definitions(part(spark, d).select(F.col("p_name").alias("word"), F.lit("hao3 ma5").alias("reading"), defs.alias("definitions"), "p_partkey"), "p_partkey")


@query("SELECT c_custkey AS n, coalesce(nullif(c_acctbal > 0, true), false) AS x FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING') AND false UNION ALL SELECT c_custkey, c_custkey >= 90 FROM customer WHERE c_nationkey % 3 <> 0 OR c_custkey >= 90")
def pending_chapters(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.when(F.col("c_nationkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 0, "accepted").otherwise("drafted-and-validated")).when(F.col("c_nationkey") % 3 == 1, "planned").alias("status"))
    late = grading.pending(rows, since=90).select("n", F.lit(True).alias("x"))
    return grading.pending(rows).where("n < 90").select("n", F.lit(False).alias("x")).unionByName(late)


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 5 = 0 THEN value * 2 END, 0.05) AS threshold FROM events")
def parameter_precedence(spark, d):
    n, v = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select("event_id", grading.resolved(F.when(n % 3 == 0, v), F.when(n % 5 == 0, v * 2), F.lit(0.05)).alias("threshold"))


_OUTLINE = "(SELECT conv_id AS book, turn AS n, role AS title, text AS summary, CASE WHEN turn % 2 = 0 THEN 'r' || turn END AS recap FROM conversations)"


@query(f"SELECT book, string_agg('- Ch ' || n || ' ' || title || ': ' || coalesce(recap, summary), chr(10) ORDER BY n) AS so_far FROM {_OUTLINE} WHERE n < 3 GROUP BY book")
def story_so_far(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("n"), F.col("role").alias("title"), F.col("text").alias("summary"), F.when(F.col("turn") % 2 == 0, F.format_string("r%d", "turn")).alias("recap"))
    return grading.story_so_far(rows, "book", 3)


@query(f"""WITH w AS (SELECT string_agg('- **' || p_name || p_partkey || '** ' || p_type || ' — ' || p_brand, chr(10) ORDER BY p_name || p_partkey) AS topic FROM part WHERE p_partkey % 50 = 0),
v AS (SELECT string_agg('### ' || band || '  (' || n || ' words)' || chr(10) || words, chr(10) ORDER BY band = 'SUP') AS vocabulary FROM (SELECT CASE WHEN p_type = 'ECONOMY' THEN 'ECONOMY' ELSE 'SUP' END AS band, count(*) AS n, string_agg(p_name || p_partkey, '、' ORDER BY p_name || p_partkey) AS words FROM part GROUP BY 1)),
s AS (SELECT book, string_agg('- Ch ' || n || ' ' || title || ': ' || coalesce(recap, summary), chr(10) ORDER BY n) AS so_far FROM {_OUTLINE} WHERE n < 2 GROUP BY book)
SELECT o.book, '# Chapter 2: ' || title || chr(10) || chr(10) || '## Summary' || chr(10) || summary || chr(10) || chr(10) || '## Story so far' || chr(10) || so_far || chr(10) || chr(10) || '## Limits' || chr(10) || '- out of list: 1% to 5%' || chr(10) || '- stretch: at most 15%' || chr(10) || '- length: at least 800 characters' || chr(10) || '- expressions: at least 5' ||
 CASE WHEN o.book % 2 = 0 THEN chr(10) || chr(10) || '## Already introduced' || chr(10) || 'b、a' ELSE '' END || chr(10) || chr(10) || '## Topic words' || chr(10) || topic || chr(10) || chr(10) || '## Vocabulary' || chr(10) || vocabulary AS brief FROM {_OUTLINE} o JOIN s USING (book), w, v WHERE n = 2""")
def chapter_brief(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("n"), F.col("role").alias("title"), F.col("text").alias("summary"), F.when(F.col("turn") % 2 == 0, F.format_string("r%d", "turn")).alias("recap"))
    known = rows.where("n = 0 and book % 2 = 0").select("book", F.posexplode(F.array(F.lit("b"), F.lit("a"))).alias("pos", "word"))
    lexicon = part(spark, d).select(F.concat("p_name", key().cast("string")).alias("word"), F.col("p_type").alias("level"), F.when(key() % 50 == 0, "book").otherwise("graded").alias("source"), F.col("p_type").alias("reading"), F.col("p_brand").alias("gloss"))
    return grading.brief(rows, "book", 2, known, lexicon, grading.Gates(0.05, 0.01, 0.15, 800, 5), ("ECONOMY",), "SUP")


_WORDS = r"SELECT conv_id AS book, turn, turn * 100000 + generate_subscripts(ws, 1) - 1 AS spot, unnest(ws) AS word FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') AS ws FROM conversations)"


@query(f"""WITH w AS ({_WORDS}), o AS (SELECT book, word, min(spot) AS spot FROM w WHERE turn = 0 GROUP BY ALL), n AS (SELECT book, word, min(spot) AS spot FROM w WHERE turn = 1 AND (book, word) NOT IN (SELECT book, word FROM o) GROUP BY ALL)
SELECT book, word, spot AS pos FROM o UNION ALL SELECT book, word, (SELECT max(spot) FROM o WHERE o.book = n.book) + row_number() OVER (PARTITION BY book ORDER BY spot) FROM n""")
def introduced_ledger(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), "turn", F.posexplode(T.latin_words(F.col("text"))).alias("i", "word"))
    t = t.select("book", "turn", (F.col("turn") * 100000 + F.col("i")).alias("at"), "word")
    before = t.where("turn = 0").groupBy("book", "word").agg(F.min("at").alias("pos"))
    worthy = t.where("turn = 1").groupBy("book", F.col("word").alias("token")).agg(F.min("at").alias("first_pos"))
    outline = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("n"), F.lit("planned").alias("status"), F.lit(None).cast("string").alias("recap"))
    return grading.accept_chapter(outline, before, worthy, 1, "done", "book")[1]


# ------------------------------------------------------------------ page building
_GLYPHS = "(SELECT l_orderkey AS page, l_suppkey % 3 AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_quantity * 10 AS x0, l_quantity * 10 + l_partkey % 7 AS x1, l_suppkey * 10.0 AS top, l_suppkey * 10.0 + 8 AS bottom, l_tax * 100 AS size, l_returnflag AS font, CASE WHEN l_linenumber = 5 THEN ' ' ELSE l_linestatus END AS text FROM lineitem)"


def _glyphs(spark, d):
    l = table(spark, d, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return l.select(
        F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 3).alias("line"), seq.alias("seq"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + F.col("l_partkey") % 7).alias("x1"), (F.col("l_suppkey") * 10.0).alias("top"),
        (F.col("l_suppkey") * 10.0 + 8).alias("bottom"), (F.col("l_tax") * 100).alias("size"), F.col("l_returnflag").alias("font"), F.when(F.col("l_linenumber") == 5, " ").otherwise(F.col("l_linestatus")).alias("text"),
    )


@query(f"""WITH g AS {_GLYPHS}, u AS (SELECT page, line, coalesce(median(x1 - x0) FILTER (x1 > x0), 2.0) AS usual FROM g GROUP BY ALL),
b AS (SELECT g.*, usual, x0 - lag(x1) OVER w AS gap, lag(text) OVER w AS prev, row_number() OVER w AS n FROM g JOIN u USING (page, line) WINDOW w AS (PARTITION BY page, line ORDER BY x0, seq)),
t AS (SELECT page, line, string_agg(CASE WHEN gap > 0.4 * usual AND text <> ' ' AND prev <> ' ' THEN ' ' || text ELSE text END, '' ORDER BY n) AS text FROM b GROUP BY ALL),
f AS (SELECT page, line, arg_max(font, (n, -spot)) AS font FROM (SELECT page, line, font, count(*) AS n, min(seq) AS spot FROM g GROUP BY ALL) GROUP BY ALL)
SELECT page, line, text, round_even(median(size), 1) AS size, font, round_even(min(g.x0), 1) AS x0, round_even(max(g.x1), 1) AS x1 FROM t JOIN f USING (page, line) JOIN (SELECT page, line, size, x0, x1 FROM g) g USING (page, line) GROUP BY page, line, text, font""")
def page_lines(spark, d):
    g = _glyphs(spark, d)
    return layout.spaced_text(g, ["page", "line"]).join(layout.line_style(g, ["page", "line"]), ["page", "line"]).select("page", "line", "text", "size", "font", "x0", "x1")


@query(f"""WITH g AS {_GLYPHS}, t AS (SELECT page, line, string_agg(text, '' ORDER BY x0, seq, text) AS text, round_even(min(top), 1) AS top FROM g GROUP BY ALL) SELECT page, list(text ORDER BY top, line) AS lines, sum(length(replace(text, ' ', '')))::BIGINT AS chars FROM t GROUP BY page""")
def page_records(spark, d):
    out = layout.page_records(_glyphs(spark, d), ["page"])
    return out.select("page", F.transform("lines", lambda l: l["text"]).alias("lines"), "chars")


@query(f"WITH g AS {_GLYPHS} SELECT page, list_sort(list_distinct(list(font))) AS fonts FROM g GROUP BY page")
def page_fonts(spark, d):
    return layout.fonts(_glyphs(spark, d), "page")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber, l_partkey, l_extendedprice) - 1)::INT AS pos FROM lineitem")
def reading_order(spark, d):
    rows = table(spark, d, "lineitem").withColumn("seq", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    return layout.in_reading_order(rows, ["l_orderkey"], "l_suppkey", "seq").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "pos")


# ------------------------------------------------------------------ images
@query(f"""WITH m AS (SELECT vec_id, p, list_avg(p) AS mean, list_stddev_pop(p) AS sd FROM {_PIXELS})
SELECT vec_id, list_transform(list_transform(p, lambda v: CASE WHEN sd > 0 THEN (v - mean) / (2.5 * sd) ELSE 0.0 END), lambda x: round(x, 6)) AS noise, CASE WHEN mean <= 42.5 THEN 0 WHEN mean <= 127.5 THEN 85 WHEN mean <= 212.5 THEN 170 ELSE 255 END AS band,
 list_transform(p, lambda v: least(255, round_even(255.0 * pow(v / 255.0, 0.85), 0))::INT) AS toned FROM m""")
def tone_and_noise(spark, d):
    rows = _pixels(spark, d)
    noise = F.transform(imaging.standardise(F.col("p")), lambda x: F.round(x, 6))
    return rows.select("vec_id", noise.alias("noise"), imaging.band_level(F.col("p")).alias("band"), imaging.tone(F.col("p")).alias("toned"))


@query("SELECT p_partkey, round(abs(sin(2 * pi() * (p_partkey % 256) / 85.0)), 9) AS weight FROM part")
def lattice_weights(spark, d):
    return part(spark, d).select("p_partkey", F.round(imaging.sparsity(key() % 256), 9).alias("weight"))


@query(f"""SELECT vec_id, flatten(list_transform(range(0, 4), lambda i: list_transform(range(0, 10), lambda x: p[greatest(0, least(len(p) - 1, x + [0, 1, 2, 1][i + 1] - 3)) + 1]))) AS flowed FROM {_PIXELS}""")
def strand_flow(spark, d):
    walk = F.array(*map(F.lit, (0, 1, 2, 1)))
    return _pixels(spark, d).select("vec_id", imaging.flow(F.col("p"), walk, 10, 4, 3).alias("flowed"))


@query()
def bounded_walks(spark, d):
    return part(spark, d).select("p_partkey", imaging.bounded_walk(F.transform(imaging.wave_targets(40, [(6.0, 17.0), (3.0, 9.0)]), lambda t: t * (key() % 5))).alias("walk"))


@query("SELECT p_partkey, (n + 5)::BIGINT AS number, (n // 4)::INT AS grid_row, (n % 4)::INT AS grid_col FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)")
def contact_sheet(spark, d):
    return imaging.grid_places(part(spark, d).select("p_partkey"), "p_partkey", 4, 5)


# ------------------------------------------------------------------ state
@query("SELECT event_id, event_id % 7 AS name FROM events WHERE event_id NOT IN (SELECT event_id * 3 FROM events)")
def remove_by_id(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 7).alias("name"))
    return ledger.remove_ids(e, e.select((F.col("event_id") * 3).alias("event_id")), "event_id").select("event_id", "name")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 <> 0 THEN 'known' ELSE 'new' END AS state FROM part")
def metadata_memo(spark, d):
    scan = part(spark, d).select("p_partkey", F.concat("p_name", key().cast("string")).alias("path"), F.col("p_size").alias("mtime"), F.lit(1).alias("size"))
    memo = scan.where(key() % 2 == 0).select("path", F.when(F.col("mtime") % 3 == 0, -1).otherwise(F.col("mtime")).alias("mtime"), "size", F.lit("t").alias("title"))
    known, new = ledger.fresh(scan, memo, ["path", "mtime", "size"])
    return known.select("p_partkey", F.lit("known").alias("state")).unionByName(new.select("p_partkey", F.lit("new").alias("state")))


@query("SELECT event_id, CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'ok' ELSE 'stale' END AS answer, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS queued FROM events")
def stale_handles(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey").alias("user_id")
    rows = joins.flagged(table(spark, d, "events").select("event_id", "user_id"), c.where("c_acctbal < 0").select(key), "user_id", "queued")
    return ledger.stale_handles(rows, c.where("c_acctbal > 0").select(key), "user_id").select("event_id", "answer", "queued")


@query("""WITH a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt, o_totalprice > 140000 AS ok FROM orders), s AS (SELECT o_custkey, min(attempt) FILTER (ok) AS first, max(attempt) AS last FROM a WHERE attempt <= 4 GROUP BY 1)
SELECT o_custkey, coalesce(first, last)::INT AS attempts, CASE WHEN first IS NOT NULL THEN 'accepted' WHEN last >= 4 THEN 'gave up' ELSE 'pending' END AS outcome FROM s""")
def rework_loop(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return ledger.rework(table(spark, d, "orders").select("o_custkey", n.alias("attempt"), (F.col("o_totalprice") > 140000).alias("passed")), "o_custkey", 3)


@query("SELECT p_brand, p_partkey, ((n - 1) // 5)::INT AS button_row, ((n - 1) % 5)::INT AS button_col FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def button_rows(spark, d):
    return ledger.in_rows(part(spark, d).select("p_brand", "p_partkey"), ["p_brand"], "p_partkey")


@query("""SELECT p_brand AS host, CASE WHEN bool_or(p_partkey % 2 = 1 AND p_partkey % 17 = 0) THEN '/sleep' ELSE '/.sleep' END AS folder FROM part GROUP BY p_brand""")
def push_folder(spark, d):
    rows = part(spark, d).select(F.col("p_brand").alias("host"), F.when(key() % 2 == 1, "/sleep").otherwise("/.sleep").alias("folder"), F.concat("p_name", F.when(key() % 17 == 0, ".BMP").otherwise(".png")).alias("name"))
    return ledger.choose_folder(rows, "/.sleep", "/sleep")


@query("SELECT event_id, nullif(list_position(['click', 'view', 'error'], event_type), 0)::BIGINT - 1 AS idx, user_id <= least(15, 20 * 1024 * 1024) AS admitted FROM events")
def setting_options(spark, d):
    from lectern.streaming.queue import admitted

    options = F.array(F.lit("click"), F.lit("view"), F.lit("error"))
    rows = admitted(table(spark, d, "events").withColumn("size", F.col("user_id")), 15)
    return rows.select("event_id", ledger.option_index(options, F.col("event_type")).alias("idx"), "admitted")


@query(f"""WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN text || ' and more words of no use at all to anybody' ELSE lower(text) || ' ' END AS t2, doc_id % 5 = 0 AS broken FROM documents),
m AS (SELECT x.doc_id, broken, CASE WHEN length({no_space_sql('text')}) > 0 THEN length({no_space_sql('t2')}) / length({no_space_sql('text')}) ELSE 1.0 END AS r, CASE WHEN len(a.g) > 0 THEN len(list_intersect(a.g, b.g)) / len(a.g) ELSE 1.0 END AS c
 FROM x JOIN {grams_sql('doc_id', 'x')} a USING (doc_id) JOIN {grams_sql('doc_id', '(SELECT doc_id, t2 AS text FROM x)')} b USING (doc_id))
SELECT doc_id, round_even(r, 4) AS char_ratio, round_even(c, 4) AS ngram_containment, r BETWEEN 0.98 AND 1.02 AND c >= 0.995 AS coverage_pass, r BETWEEN 0.98 AND 1.02 AND c >= 0.995 AND NOT broken AS passed FROM m""")
def book_coverage(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" and more words of no use at all to anybody"))).otherwise(F.concat(F.lower("text"), F.lit(" "))).alias("t2"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0).alias("errors"))
    return fidelity.coverage(docs, "doc_id", "text", "t2", "errors")


# ------------------------------------------------------------------ functions, lists, covers, panels
@query(f"""WITH w AS (SELECT item_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM (SELECT item_id, list_filter(regexp_split_to_array(text || ' &amp; x', '\\s+'), lambda x: x <> '') AS ws FROM benchmark)) SELECT item_id, pos::INT AS pos, replace(word, '&amp;', '&') AS word FROM w""")
def sql_functions(spark, d):
    from lectern.functions import sql

    sql.register(spark)
    table(spark, d, "benchmark").createOrReplaceTempView("lectern_benchmark")
    return spark.sql("SELECT item_id, w.pos, html_text(w.word) AS word FROM lectern_benchmark, LATERAL words(text || ' &amp; x') w")


@query("SELECT p_name || p_partkey AS word, 'HSK' || band AS level, CASE WHEN p_size > 20 THEN p_type ELSE '' END AS reading, CASE WHEN p_size > 20 THEN p_brand ELSE '' END AS gloss FROM (SELECT *, ['1', '2', '3', '7-9'][p_partkey % 4 + 1] AS band FROM part) WHERE band <> '7-9'")
def syllabus_list(spark, d):
    bands = ("1", "2", "3", "7-9")
    word = F.concat("p_name", key().cast("string")).alias("word")
    words = part(spark, d).select(word, F.element_at(F.array(*map(F.lit, bands)), (key() % 4 + 1).cast("int")).alias("band"))
    known = part(spark, d).where("p_size > 20").select(word, F.col("p_type").alias("reading"), F.col("p_brand").alias("gloss"))
    return grading.syllabus(words, known, bands, "3")


@query("""SELECT p_partkey, list_filter([CASE WHEN f NOT IN ('PNG', 'JPEG') THEN 'format ' || CASE WHEN f = '' THEN '?' ELSE f END || ' (need PNG or baseline JPEG)' END, CASE WHEN f = 'JPEG' AND p_partkey % 2 = 0 THEN 'progressive JPEG (renders as [Image] placeholder)' END,
 CASE WHEN p_partkey % 3 > 0 THEN 'mode RGB (need grayscale)' END, CASE WHEN p_size * 20 > 528 OR p_partkey % 900 > 792 THEN 'size ' || p_size * 20 || 'x' || p_partkey % 900 || ' (exceeds 528x792 panel)' END], lambda x: x IS NOT NULL) AS reasons,
 p_partkey % 4 IN (0, 3) AS inside FROM (SELECT *, ['PNG', 'JPEG', 'GIF', ''][p_partkey % 4 + 1] AS f FROM part)""")
def cover_reasons(spark, d):
    kind = F.element_at(F.array(F.lit("png"), F.lit("jpeg"), F.lit("gif"), F.lit(None).cast("string")), (key() % 4 + 1).cast("int"))
    path = F.element_at(F.array(F.lit("/lib/a/../b"), F.lit("/lib/../etc"), F.lit("/library/x"), F.lit("/lib")), (key() % 4 + 1).cast("int"))
    reasons = integrity.cover_reasons(kind, key() % 2 == 0, F.when(key() % 3 > 0, "RGB").otherwise("L"), F.col("p_size") * 20, key() % 900)
    return part(spark, d).select("p_partkey", reasons.alias("reasons"), integrity.inside(F.lit("/lib/"), path).alias("inside"))


@query("""WITH p AS (SELECT vec_id, (vec_id * 7) % 40 AS x, (vec_id * 3) % 60 AS y FROM embeddings), f AS (SELECT *, (20 - y) / 20.0 AS t, (y - 40 + 1) / 20.0 AS b, (10 - x) / 10.0 AS l, (x - 30 + 1) / 10.0 AS r FROM p)
SELECT vec_id, CASE WHEN greatest(t, b, l, r) <= 0 THEN NULL WHEN t = greatest(t, b, l, r) THEN 'top' WHEN b = greatest(t, b, l, r) THEN 'bottom' WHEN l = greatest(t, b, l, r) THEN 'left' ELSE 'right' END AS side FROM f""")
def mat_sectors(spark, d):
    n = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", imaging.mat_side((n * 7) % 40, (n * 3) % 60, 10, 20, 20, 20, 40, 60).alias("side"))


@query("SELECT vec_id AS image, 40::BIGINT AS width, 60::BIGINT AS height, 4::BIGINT AS bpp, true AS native, NULL::VARCHAR AS error, 54 + 64 + 20 * 60 AS size FROM embeddings")
def wallpaper_files(spark, d):
    px = _pixels(spark, d)
    made = imaging.wallpapers(px.select(F.col("vec_id").alias("image"), F.lit(8).alias("w"), (F.size("p") / 8).cast("int").alias("h"), F.col("p").alias("pixels")), "floyd", "edges", 40, 60)
    heads = imaging.bmp_header(made, "image", "content")
    return heads.select("image", "width", "height", "bpp", "native", "error").join(made.select("image", F.octet_length("content").alias("size")), "image")


@query("SELECT conv_id AS book, role AS title FROM conversations WHERE turn = 1 AND conv_id = (SELECT min(conv_id) FROM conversations WHERE turn = 1)")
def chapter_lookup(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("n"), F.col("role").alias("title"))
    return grading.chapter_of(rows, 1, "book").select("book", "title")


# Names, addresses and lines of the pages: heads, fences, figures and notes are structure.
_HEADS = ["'# '", "'```'", "' ![x'", "'[^1]: '", "'plain '", "'中'"]
# Characters inside and outside the wide ranges, and addresses as people paste them.
_SIGNS = ["中", "あ", "가", "、", "Ａ", "x", "㐀", "豈", "ー", "é"]
_ADDRESSES = ["http://[::1]:80/x", " https://h{}:8080/y", "h{}/z", "HTTP://h{}/x", "a//h{}/c", "<h{}:80> ", "\u00a0h{}\u3000two", "//", "x//[h{}]"]
_ADDRESS_SQL = " ".join(f"WHEN {k} THEN " + " || page_id || ".join(f"'{p}'" for p in a.split("{}")) for k, a in enumerate(_ADDRESSES)).replace("\u00a0", "' || chr(160) || '").replace("\u3000", "' || chr(12288) || '")


@query(f"""WITH p AS (SELECT page_id, [{", ".join(_HEADS)}][page_id % 6 + 1] AS head, url, page_id % 3 AS k, {_SIGNS!r}[page_id % {len(_SIGNS)} + 1] AS sign, CASE page_id % {len(_ADDRESSES)} {_ADDRESS_SQL} END AS address,
 chr(160) || chr(1) || ' ' || url || chr(12) || ' ' || chr(12288) || chr(10) || chr(133) || 'b' || chr(11) || 'c' || chr(8232) AS meta FROM pages)
SELECT page_id, page_id % 6 < 4 AS structure, page_id % 6 = 5 AS wide, {" OR ".join(f"unicode(sign) BETWEEN {low} AND {high}" for low, high in fixed.WIDE)} AS wide_sign, CASE k WHEN 0 THEN 'my-b-ok-' || page_id WHEN 1 THEN 'untitled' ELSE 'tar' || page_id END AS stem,
 trim({words_sql(f"split_part(string_split({strip_sql('address')}, '//')[-1], '/', 1)")}[1], '<>[] ') AS host, array_to_string({words_sql(f"regexp_replace(meta, '{fixed.NOT_XML}', '', 'g')")}, ' ') AS clean FROM p""")
def text_marks(spark, d):
    n = F.col("page_id")
    of = lambda values: F.get(F.array(*values), (n % len(values)).cast("int"))
    heads = of([F.lit(h.strip("'")) for h in _HEADS])
    name = F.when(n % 3 == 0, F.format_string("/x/My_B!ok %d.epub", n)).when(n % 3 == 1, "中文.txt").otherwise(F.format_string("TAR%d.tar", n))
    address = of([F.replace(F.lit(a), F.lit("{}"), n.cast("string")) for a in _ADDRESSES])
    meta = F.concat(F.lit("\u00a0\x01 "), "url", F.lit("\x0c \u3000\n\x85b\x0bc\u2028"))
    return table(spark, d, "pages").select(
        "page_id", T.is_structure(F.concat(heads, "url")).alias("structure"), T.is_wide_cjk(heads).alias("wide"), T.is_wide_cjk(of([F.lit(x) for x in _SIGNS])).alias("wide_sign"),
        T.stem_slug(name).alias("stem"), T.host_of_address(address).alias("host"), T.clean_metadata(meta).alias("clean"),
    )


@query("""WITH r AS (SELECT conv_id, role AS marker, min(turn) AS f FROM conversations GROUP BY ALL), n AS (SELECT conv_id, role AS marker, arg_max(text, turn) AS note FROM conversations WHERE turn % 2 = 0 GROUP BY ALL)
SELECT r.conv_id, r.marker, row_number() OVER (PARTITION BY r.conv_id ORDER BY f, r.marker)::INT AS number, note, CASE WHEN n.conv_id IS NULL THEN 'undefined footnote reference ' || r.marker END AS error FROM r LEFT JOIN n USING (conv_id, marker)""")
def footnote_definitions(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("role").alias("marker"), F.col("turn").alias("pos"), F.col("text").alias("note"))
    return integrity.footnotes(rows.drop("note"), rows.where("pos % 2 = 0"), "conv_id")
