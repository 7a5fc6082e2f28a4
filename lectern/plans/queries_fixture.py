"""Queries whose input is built from the driver's tables by a rule, for operators that need other shapes than these have.

Each SQL states the expected result from the same rule, not from the built input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import catalog, grading, imaging, integrity, joins, packaging, render
from lectern.plans.queries import LINE_END, strip_sql, table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def part(spark, d):
    return table(spark, d, "part")


def key():
    return F.col("p_partkey")

# Words of part names as Han characters, letter by letter.
LETTERS, HAN = "abcdefghijklmnopqrstuvwxyz", "我很快聪明火山第十一名二个从前没有大小中上下人天水好"


def _han(x):
    return F.translate(x, LETTERS, HAN)


_FIRST, _SECOND = (f"translate(split_part(p_name, ' ', {k}), '{LETTERS}', '{HAN}')" for k in (1, 2))
_LEX_SQL = f"(SELECT DISTINCT substring({_SECOND}, 1 + p_partkey % 3, 1 + p_size % 2) AS word FROM part WHERE p_partkey % 2 = 0)"
_TOKENS_SQL = f"""(SELECT p_partkey, 1 AS k, substring({_FIRST}, 1, 1 + p_partkey % 6) AS token FROM part
 UNION ALL SELECT p_partkey, 2, '第' || substring('一二三四五六七八九十', 1 + p_size % 10, 1) || substring('个名年', 1 + p_partkey % 3, p_partkey % 2) FROM part
 UNION ALL SELECT p_partkey, 3, substring({_SECOND}, 1, 2 + p_partkey % 5) FROM part UNION ALL SELECT p_partkey, 4, p_brand FROM part)"""
_TIERS_SQL = f"""tokens AS {_TOKENS_SQL}, lex AS (SELECT * FROM {_LEX_SQL} WHERE word <> ''), idiom AS (SELECT DISTINCT substring({_FIRST}, 1, 1 + p_partkey % 6) AS token FROM part WHERE p_partkey % 29 = 0),
chars AS (SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM lex),
tok AS (SELECT token, regexp_extract_all(token, '[一-鿿]') AS han FROM (SELECT DISTINCT token FROM tokens) WHERE regexp_matches(token, '[一-鿿]')),
ok AS (SELECT token, any_value(han) AS han, bool_and(c IN (SELECT ch FROM chars)) AS chars_known FROM (SELECT token, han, unnest(han) AS c FROM tok) GROUP BY token),
reach(token, i) AS (SELECT token, 0 FROM tok WHERE length(token) BETWEEN 2 AND 8 UNION SELECT r.token, r.i + length(word) FROM reach r JOIN lex ON substring(r.token, r.i + 1, length(word)) = word WHERE length(word) < length(r.token)),
tier AS (SELECT token, CASE WHEN token IN (SELECT token FROM idiom) THEN 'chengyu' WHEN token IN (SELECT word FROM lex) THEN 'known' WHEN len(han) = 1 AND chars_known THEN 'known'
 WHEN regexp_matches(token, '^第?[{fixed.NUMERALS}]+(个?[{fixed.MEASURES}])?$') AND chars_known THEN 'composed'
 WHEN EXISTS (SELECT 1 FROM reach r WHERE r.token = ok.token AND r.i = length(ok.token)) THEN 'composed' WHEN len(han) >= 2 AND chars_known THEN 'stretch' ELSE 'flagged' END AS tier FROM ok)"""


def _lexicon(spark, d):
    word = F.expr("substring(w, 1 + p_partkey % 3, 1 + p_size % 2)")
    rows = part(spark, d).where(key() % 2 == 0).withColumn("w", _han(F.split_part("p_name", F.lit(" "), F.lit(2))))
    return rows.select(word.alias("word")).where("word <> ''").distinct()


def _tokens(spark, d):
    p = part(spark, d).withColumn("a", _han(F.split_part("p_name", F.lit(" "), F.lit(1)))).withColumn("b", _han(F.split_part("p_name", F.lit(" "), F.lit(2))))
    cells = ["substring(a, 1, cast(1 + p_partkey % 6 as int))", "'第' || substring('一二三四五六七八九十', 1 + p_size % 10, 1) || substring('个名年', cast(1 + p_partkey % 3 as int), cast(p_partkey % 2 as int))", "substring(b, 1, cast(2 + p_partkey % 5 as int))", "p_brand"]
    return p.select("p_partkey", F.posexplode(F.array(*map(F.expr, cells))).alias("k", "token")).withColumn("k", F.col("k") + 1)


def _tiers(spark, d):
    tokens = _tokens(spark, d)
    idioms = tokens.where((F.col("k") == 1) & (key() % 29 == 0)).select(F.col("token").alias("word"))
    return grading.classify(tokens, _lexicon(spark, d), idioms)


@query(f"WITH RECURSIVE {_TIERS_SQL} SELECT p_partkey, k, token, tier FROM tokens LEFT JOIN tier USING (token)")
def tier_cascade(spark, d):
    return _tiers(spark, d).select("p_partkey", "k", "token", "tier")


@query(f"""WITH RECURSIVE {_TIERS_SQL}, t AS (SELECT p_partkey % 5 AS text, tier.tier, token, count(*) AS n, min(p_partkey * 10 + k) AS spot FROM tokens JOIN tier USING (token) WHERE tier IN ('flagged', 'stretch') GROUP BY ALL)
SELECT text, coalesce(list(token ORDER BY n DESC, spot, token) FILTER (tier = 'flagged'), [])[:3] AS flagged_tokens, coalesce(list(token ORDER BY n DESC, spot, token) FILTER (tier = 'stretch'), [])[:3] AS stretch_tokens FROM t GROUP BY text""")
def report_lists(spark, d):
    rows = _tiers(spark, d).withColumn("text", key() % 5).withColumn("pos", key() * 10 + F.col("k"))
    return grading.report_lists(rows, "text", "pos", 3)


@query(f"""WITH RECURSIVE {_TIERS_SQL}, own AS (SELECT token FROM tokens WHERE k = 2 AND p_partkey % 7 = 0)
SELECT p_partkey % 5 AS text, token, min(p_partkey * 10 + k) AS first_pos FROM tokens JOIN tier USING (token) WHERE tier IN ('stretch', 'flagged') OR token IN (SELECT token FROM own) GROUP BY ALL""")
def gloss_worthy(spark, d):
    rows = _tiers(spark, d).withColumn("text", key() % 5).withColumn("pos", key() * 10 + F.col("k"))
    own = _tokens(spark, d).where((F.col("k") == 2) & (key() % 7 == 0)).select(F.col("token").alias("word"), F.lit("book").alias("source"))
    return grading.gloss_worthy(rows, own, "text", "pos")


@query("SELECT p_name AS word, p_partkey FROM part WHERE p_partkey % 3 <> 0 OR NOT regexp_matches('L' || (p_size % 9) || p_type, '\\d') OR list_max(list_transform(regexp_extract_all('bands ' || (p_size % 9) || '-' || (p_size % 4), '\\d+'), lambda x: x::INT)) <= 4")
def level_cap(spark, d):
    level = F.format_string("bands %d-%d", F.col("p_size") % 9, F.col("p_size") % 4)
    rows = part(spark, d).select(F.col("p_name").alias("word"), "p_partkey", level.alias("level"), F.when(key() % 3 == 0, "graded").otherwise("book").alias("source"))
    return grading.cap_level(rows, 4).select("word", "p_partkey")


_SYLLABLE = "(CASE WHEN p_partkey % 3 = 0 THEN upper(w) WHEN p_partkey % 3 = 1 THEN upper(w[:1]) || w[2:] ELSE w END || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE (p_partkey % 6)::VARCHAR END)"


@query(f"""WITH s AS (SELECT p_partkey, {_SYLLABLE} AS syllable, CASE WHEN p_partkey % 6 = 0 THEN 5 ELSE p_partkey % 6 END AS tone FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'lu:' WHEN p_partkey % 5 = 1 THEN 'zhou' ELSE split_part(p_name, ' ', 1) END AS w FROM part)),
b AS (SELECT *, replace(replace(regexp_extract(syllable, '^([a-zA-Z:]+)', 1), 'u:', 'v'), 'U:', 'V') AS body FROM s), l AS (SELECT *, lower(body) AS low FROM b),
p AS (SELECT *, CASE WHEN contains(low, 'a') THEN instr(low, 'a') WHEN contains(low, 'e') THEN instr(low, 'e') WHEN contains(low, 'ou') THEN instr(low, 'o') ELSE length(regexp_extract(low, '^(.*[iouv])', 1)) END AS spot FROM l),
m AS (SELECT *, CASE low[spot] WHEN 'a' THEN 'āáǎàa' WHEN 'e' THEN 'ēéěèe' WHEN 'i' THEN 'īíǐìi' WHEN 'o' THEN 'ōóǒòo' WHEN 'u' THEN 'ūúǔùu' ELSE 'ǖǘǚǜü' END[tone] AS mark FROM p)
SELECT p_partkey, syllable, CASE WHEN spot = 0 THEN replace(body, 'v', 'ü') ELSE replace(replace(body[:spot - 1] || CASE WHEN body[spot] = upper(body[spot]) THEN upper(mark) ELSE mark END || body[spot + 1:], 'v', 'ü'), 'V', 'Ü') END AS marked FROM m""")
def tone_marks(spark, d):
    w = F.when(key() % 5 == 0, "lu:").when(key() % 5 == 1, "zhou").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    cased = F.when(key() % 3 == 0, F.upper(w)).when(key() % 3 == 1, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)
    s = F.concat(cased, F.when(key() % 6 == 0, "").otherwise((key() % 6).cast("string")))
    return part(spark, d).select("p_partkey", s.alias("syllable")).withColumn("marked", T.tone_mark(F.col("syllable")))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' .' || p_name || '/:' || p_brand || '?. ' WHEN 1 THEN '...' WHEN 2 THEN repeat(p_name, 12) || chr(7) ELSE repeat('é' || p_type, 9) END AS name FROM part),
c AS (SELECT p_partkey, name, regexp_replace(regexp_replace(regexp_replace(name, '^[ .]+', ''), '[/\\\\:*?"<>|]', '_', 'g'), '[\\x00-\\x1f\\x7f]', '', 'g') AS t FROM n),
k AS (SELECT *, list_max(list_filter(range(0, length(t) + 1), lambda i: strlen(t[:i]) <= 100)) AS cut FROM c)
SELECT p_partkey, name, coalesce(nullif(rtrim(t[:cut], ' .'), ''), 'book') AS safe FROM k""")
def safe_filename(spark, d):
    name = (
        F.when(key() % 4 == 0, F.concat(F.lit(" ."), "p_name", F.lit("/:"), "p_brand", F.lit("?. "))).when(key() % 4 == 1, "...").when(key() % 4 == 2, F.concat(F.repeat("p_name", F.lit(12)), F.lit("\x07")))
        .otherwise(F.repeat(F.concat(F.lit("é"), "p_type"), F.lit(9)))
    )
    return part(spark, d).select("p_partkey", name.alias("name")).withColumn("safe", T.safe_filename(F.col("name")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 2 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand || ' - ' || p_name ELSE p_name || ' - ' || p_brand END || '.epub' AS name FROM part")
def book_filename(spark, d):
    author, title = F.when(key() % 5 == 0, " ").otherwise(F.col("p_brand")), F.col("p_name")
    name = F.when(key() % 3 == 0, T.book_filename(author, title, 0)).when(key() % 3 == 1, T.book_filename(author, title, 1)).otherwise(T.book_filename(author, title, 2))
    return part(spark, d).select("p_partkey", name.alias("name"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(url || ' é|<%' || (page_id % 100) || '%zz%41', '%([0-9A-Fa-f]{2})', chr(1) || '\\1', 'g'), '%', '%25', 'g'), chr(1), '%'), ' ', '%20'), 'é', '%C3%A9'), '|', '%7C'), '<', '%3C'), '"', '%22') AS safe FROM pages""")
def encode_url(spark, d):
    url = F.concat("url", F.lit(" é|<%"), (F.col("page_id") % 100).cast("string"), F.lit("%zz%41"))
    return table(spark, d, "pages").select("page_id", T.encode_unsafe(url).alias("safe"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://h' || page_id || '/base/p' WHEN 1 THEN 'http://h' || page_id || '/r' WHEN 2 THEN 'ftp://z/a%20b' WHEN 3 THEN 'http://h' || page_id || '/x/' || page_id ELSE 'http://h' || page_id END AS url FROM pages""")
def build_url(spark, d):
    n = F.col("page_id")
    host = F.concat(F.lit("h"), n.cast("string"))
    server = F.when(n % 5 == 0, F.concat(host, F.lit("/base?q=1"))).when(n % 5 == 1, F.concat(F.lit("http://"), host, F.lit("/base/"))).when(n % 5 == 3, F.concat(host, F.lit("/x/"))).otherwise(host)
    path = F.when(n % 5 == 0, "p").when(n % 5 == 1, "/r").when(n % 5 == 2, "ftp://z/a b").when(n % 5 == 3, n.cast("string")).otherwise("")
    return table(spark, d, "pages").select("page_id", T.build_url(server, path).alias("url"))


@query("SELECT n, CASE WHEN n <= 10 THEN ['零','一','二','三','四','五','六','七','八','九','十'][n + 1] WHEN n < 20 THEN '十' || ['一','二','三','四','五','六','七','八','九'][n - 10] ELSE n::VARCHAR END AS word FROM (SELECT n_nationkey AS n FROM nation)")
def chinese_ordinal(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), T.ordinal_zh(F.col("n_nationkey")).alias("word"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE greatest(p_size, p_size % 7) END::INT AS ceiling, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '') END AS compact FROM part")
def level_ceiling(spark, d):
    level = F.when(key() % 4 == 0, "none").otherwise(F.format_string("bands %d-%d", "p_size", F.col("p_size") % 7))
    reading = F.when(key() % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return part(spark, d).select("p_partkey", T.level_ceiling(level).alias("ceiling"), T.compact_reading(reading).alias("compact"))


# A number as it is, and in forms that aren't one or read as another.
_PAGE_FORMS = ["{}", "-{}", "{}x", " {}", "+{}", "12345678901{}", "1_{}", "\u0663{}", "{}.0", "\u3000{}\n", "1__{}", "+ {}", ""]
_PAGE_SQL = " ".join(f"WHEN {k} THEN {v}" for k, v in {0: "u", 3: "u", 4: "u", 5: "('12345678901' || u)::BIGINT", 6: "('1' || u)::BIGINT", 7: "('3' || u)::BIGINT", 9: "u"}.items())


@query(f"SELECT event_id, greatest(1, CASE event_id % {len(_PAGE_FORMS)} {_PAGE_SQL} ELSE 1 END)::BIGINT AS page FROM (SELECT event_id, user_id::BIGINT AS u FROM events)")
def page_numbers(spark, d):
    parts = [f.partition("{}") for f in _PAGE_FORMS]
    forms = F.array(*[F.concat(F.lit(p), F.col("user_id").cast("string"), F.lit(q)) if mark else F.lit(p) for p, mark, q in parts])
    raw = F.get(forms, (F.col("event_id") % len(_PAGE_FORMS)).cast("int"))
    return table(spark, d, "events").select("event_id", T.page_number(raw).alias("page"))


_ENDINGS = [".PNG", ".epub", ".c.pdf", ".BMP", ".bmp", ""]


@query(f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'epub' WHEN 2 THEN 'pdf' WHEN 5 THEN 'other' ELSE 'image' END AS route, p_partkey % 6 IN (3, 4) AND p_partkey % 5 <> 0 AS sleeps,
 CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS family, printf('%.1f%%', p_size / 7.0 * 100) AS share FROM part""")
def suffix_routes(spark, d):
    dot = F.when(key() % 5 == 0, ".").otherwise("")
    path = F.concat(dot, F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(F.array(*map(F.lit, _ENDINGS)), (key() % 6 + 1).cast("int")))
    folder = F.concat(F.when(key() % 3 == 0, "/Fonts/").when(key() % 3 == 1, "/fonts/x/").otherwise("/books/"), "p_brand", F.when(key() % 3 == 0, "").otherwise("/y"))
    return part(spark, d).select("p_partkey", T.suffix_route(path).alias("route"), T.sleep_scan_accepts(path).alias("sleeps"), T.family_of_path(folder).alias("family"), T.percent(F.col("p_size") / 7.0).alias("share"))


@query("SELECT p_partkey, bpp <= 2 OR (len(lum) > 0 AND list_bool_and(list_transform(lum, lambda x: abs(x - (x >> 6) * 85) <= 21))) AS native, bpp > 1 AS grey FROM (SELECT p_partkey, [1, 2, 4, 8, 24][p_partkey % 5 + 1] AS bpp, CASE WHEN p_partkey % 5 = 4 THEN [] ELSE [0, (p_size * 5) % 256, 170 + p_partkey % 25] END AS lum FROM part)")
def native_palettes(spark, d):
    bpp = F.element_at(F.array(*map(F.lit, (1, 2, 4, 8, 24))), (key() % 5 + 1).cast("int"))
    lum = F.when(key() % 5 == 4, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.col("p_size") * 5 % 256, (key() % 25 + 170).cast("int")))
    return part(spark, d).select("p_partkey", T.native_palette(bpp, lum).alias("native"), T.has_greyscale(bpp).alias("grey"))


_ITEM = """'<item id="i' || p_partkey || '" href="' || replace(p_name, ' ', '/') || p_partkey || '.xhtml" media-type="' || lower(p_type) || '"/>'"""


def _packages(spark, d):
    """A package document for each brand: its parts are manifest items; every third is referenced, as are some that aren't there."""
    item = F.format_string('<item id="i%d" href="%s%d.xhtml" media-type="%s"/>', key(), F.replace("p_name", F.lit(" "), F.lit("/")), key(), F.lower("p_type"))
    ref = F.when(key() % 3 == 0, F.format_string('<itemref idref="i%d"/>', key())).when(key() % 31 == 1, F.format_string('<itemref linear="no" idref="z%d"/>', key())).otherwise("")
    rows = part(spark, d).where("p_brand <> 'Brand#1'").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i"), ref.alias("r")))).alias("c"))
    rows = rows.union(part(spark, d).where("p_brand = 'Brand#1'").select("p_brand").distinct().withColumn("c", F.array().cast(rows.schema["c"].dataType)))
    joined = lambda x: F.array_join(F.transform("c", lambda c: c[x]), "")
    return rows.select(F.col("p_brand").alias("book"), F.concat(F.lit("<package><manifest>"), joined("i"), F.lit("</manifest><spine>"), joined("r"), F.lit("</spine></package>")).alias("opf"))


@query("SELECT p_brand AS book, 'i' || p_partkey AS item, replace(p_name, ' ', '/') || p_partkey || '.xhtml' AS href, lower(p_type) AS media_type FROM part WHERE p_brand <> 'Brand#1'")
def manifest_items(spark, d):
    return integrity.parse_manifest(_packages(spark, d), "book", "opf")


@query("""SELECT p_brand AS book, 'dangling z' || p_partkey AS error FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 31 = 1 AND p_brand <> 'Brand#1'
UNION ALL SELECT p_brand, 'empty spine' FROM part GROUP BY p_brand HAVING p_brand = 'Brand#1' OR count(*) FILTER (p_partkey % 3 = 0 OR p_partkey % 31 = 1) = 0""")
def spine_errors(spark, d):
    return integrity.spine_errors(_packages(spark, d), "book", "opf")


def _le(n, size: int):
    """Little-endian hexadecimal digits of an integer."""
    byte = lambda k: F.lpad(F.hex(F.pmod(F.floor(n / (1 << 8 * k)).cast("long"), F.lit(256))), 2, "0")
    return F.concat(*[byte(k) for k in range(size)])


_BITMAP = """(SELECT p_partkey, (p_partkey * 37) % 2200 - 4 AS width, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END * ((p_partkey * 53) % 3200) AS h, CASE WHEN p_partkey % 23 = 0 THEN 2 ELSE 1 END AS planes, CASE WHEN p_partkey % 29 = 0 THEN 12 ELSE 40 END AS dib,
 [1, 2, 4, 8, 24, 32, 16][p_partkey % 7 + 1] AS bpp, CASE WHEN p_partkey % 7 = 5 THEN 3 WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS comp, CASE WHEN p_partkey % 17 = 0 THEN 300 WHEN p_partkey % 7 = 3 THEN 16 ELSE 0 END AS used,
 CASE WHEN p_partkey % 41 = 0 THEN 90000 ELSE 118 END AS off_bits, CASE WHEN p_partkey % 37 = 0 THEN 40 WHEN p_partkey % 11 = 0 THEN 70 ELSE 1200 END AS size FROM part)"""


@query(f"""WITH b AS (SELECT *, CASE WHEN used = 0 AND bpp <= 8 THEN (1 << bpp::INT) ELSE used END AS colours FROM {_BITMAP}),
e AS (SELECT *, CASE WHEN size < 54 THEN 'FileInvalid' WHEN p_partkey % 43 = 0 THEN 'NotBMP (missing ''BM'')' WHEN dib < 40 THEN 'DIBTooSmall (<40 bytes)' WHEN planes <> 1 THEN 'BadPlanes (!= 1)' WHEN bpp = 16 THEN 'UnsupportedBpp (expected 1, 2, 4, 8, 24, or 32)'
 WHEN comp <> 0 AND NOT (bpp = 32 AND comp = 3) THEN 'UnsupportedCompression (expected BI_RGB or BI_BITFIELDS for 32bpp)' WHEN colours > 256 THEN 'PaletteTooLarge' WHEN width <= 0 OR h = 0 THEN 'BadDimensions'
 WHEN width > 2048 OR abs(h) > 3072 THEN 'ImageTooLarge (max 2048x3072)' WHEN size < 54 + 4 * colours THEN 'FileInvalid' WHEN off_bits > size THEN 'SeekPixelDataFailed' END AS error FROM b),
q AS (SELECT *, list_transform(range(0, colours::BIGINT), lambda i: (((77 + 150 + 29) * ((i * 17 + p_partkey) % 256)) >> 8)::INT) AS palette FROM e)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN width END AS width, CASE WHEN error IS NULL THEN abs(h) END AS height, CASE WHEN error IS NULL THEN h < 0 END AS top_down, CASE WHEN error IS NULL THEN bpp::BIGINT END AS bpp,
 CASE WHEN error IS NULL THEN (width * bpp + 31) // 32 * 4 END AS row_bytes, CASE WHEN error IS NULL THEN palette[1:5] END AS first_colours,
 CASE WHEN error IS NULL THEN bpp <= 2 OR (colours > 0 AND list_bool_and(list_transform(palette, lambda x: abs(x - (x >> 6) * 85) <= 21))) END AS native FROM q""")
def bitmap_headers(spark, d):
    w, h = (key() * 37) % 2200 - 4, F.when(key() % 2 == 0, 1).otherwise(-1) * ((key() * 53) % 3200)
    bpp = F.element_at(F.array(*[F.lit(x) for x in (1, 2, 4, 8, 24, 32, 16)]), (key() % 7 + 1).cast("int"))
    comp, used = F.when(key() % 7 == 5, 3).when(key() % 19 == 0, 1).otherwise(0), F.when(key() % 17 == 0, 300).when(key() % 7 == 3, 16).otherwise(0)
    head = F.concat(
        F.when(key() % 43 == 0, "5858").otherwise("424D"), F.lit("00" * 8), _le(F.when(key() % 41 == 0, 90000).otherwise(118), 4), _le(F.when(key() % 29 == 0, 12).otherwise(40), 4), _le(w, 4), _le(h, 4),
        _le(F.when(key() % 23 == 0, 2).otherwise(1), 2), _le(bpp, 2), _le(comp, 4), F.lit("00" * 12), _le(used, 4), F.lit("00" * 4),
    )
    grey = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(*[_le((i * 17 + key()) % 256, 1)] * 3, F.lit("00")))
    size = F.when(key() % 37 == 0, 40).when(key() % 11 == 0, 70).otherwise(1200)
    content = F.substring(F.unhex(F.concat(head, F.array_join(grey, ""))), F.lit(1), size)
    out = imaging.bmp_header(part(spark, d).select("p_partkey", content.alias("content")), "p_partkey", "content")
    return out.select("p_partkey", "error", "width", "height", "top_down", "bpp", "row_bytes", F.slice("palette", 1, 5).alias("first_colours"), "native")


_SIDES = "(SELECT p_partkey, p_size * 53 + 7 AS w, (p_partkey % 97) * 31 + 5 AS h FROM part)"


@query(f"""WITH s AS (SELECT *, greatest(528 / w, 792 / h) AS cover, least(528 / w, 792 / h, 1.5) AS scale FROM {_SIDES}),
m AS (SELECT *, 1 - greatest(1, round_even(w * scale, 0)) * greatest(1, round_even(h * scale, 0)) / (528 * 792) AS mat FROM s)
SELECT p_partkey, CASE WHEN cover <= 1.5 OR mat < 0.06 THEN 'fill' ELSE 'mat' END AS fit, CASE WHEN w > 528 OR h > 792 THEN CASE WHEN w / h > 528 / 792 THEN 0 ELSE round_even((528 - 792 * (w / h)) / 2, 0) END ELSE (528 - w) // 2 END::BIGINT AS x,
 CASE WHEN w > 528 OR h > 792 THEN CASE WHEN w / h > 528 / 792 THEN round_even((792 - 528 / (w / h)) / 2, 0) ELSE 0 END ELSE (792 - h) // 2 END::BIGINT AS y, w > 528 OR h > 792 AS scaled FROM m""")
def fill_or_mat(spark, d):
    s = part(spark, d).select("p_partkey", (F.col("p_size") * 53 + 7).alias("w"), ((key() % 97) * 31 + 5).alias("h"))
    return s.select("p_partkey", imaging.fill_or_mat(F.col("w"), F.col("h")).alias("fit"), imaging.placement(F.col("w"), F.col("h")).alias("p")).select("p_partkey", "fit", "p.*")


@query("""WITH e AS (SELECT vec_id // 100 AS page, '<entry>' || vec_id || '</entry>' AS entry, vec_id FROM embeddings)
SELECT page, '<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><id>urn:all</id><title>All</title><updated>' || strftime(to_timestamp(max(vec_id) * 1000.5) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || '</updated>' || string_agg(entry, '' ORDER BY vec_id) || '</feed>' AS xml FROM e GROUP BY page""")
def feed_document(spark, d):
    """A document for each page of a hundred entries."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("page"), F.format_string("<entry>%d</entry>", "vec_id").alias("entry"), (F.col("vec_id") * 1000.5).alias("mtime"), F.col("vec_id").alias("rn"))
    return catalog.feeds(rows, ["page"], "urn:all", "All", "rn")


# Feeds of a brand's parts: every third an entry that leads to a feed, every fifth without link, every seventh with two book links.
def _feeds(spark, d):
    book = lambda href: F.concat(F.lit('<link rel="http://opds-spec.org/acquisition/open-access" type="application/epub+zip" href="'), href, F.lit('"/>'))
    n = key().cast("string")
    other = F.concat(F.lit('<link rel="alternate" type="application/atom+xml;kind=acquisition" href="/n'), n, F.lit('"/>'))
    links = F.when(key() % 5 == 0, '<link rel="alternate" type="application/epub+zip" href="/no"/>').when(key() % 3 == 0, other).when(key() % 7 == 0, F.concat(book(F.concat(F.lit("/get/"), n)), book(F.concat(F.lit("/b"), n, F.lit(".epub"))))).otherwise(F.concat(other, book(F.concat(F.lit("/get/"), n))))
    author = F.when(key() % 2 == 0, F.concat(F.lit("<author><name>"), "p_type", F.lit("</name></author>"))).otherwise("")
    entry = F.concat(F.lit("<entry><title>A &amp; "), "p_name", F.lit("</title><id>"), n, F.lit("</id>"), author, links, F.lit("</entry>"))
    rows = part(spark, d).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("c"), F.count("*").alias("n"))
    head = F.concat(F.lit('<feed><link rel="search" href="/s?q={searchTerms}"/><link rel="search" href="/d.xml"/>'), F.when(F.col("n") % 2 == 0, '<link rel="next" href="/p?a=1&amp;page=2"/>').otherwise('<link rel="previous" href="/p1"/>'))
    return rows.select(F.col("p_brand").alias("feed_id"), F.concat(head, F.array_join(F.transform("c", lambda c: c["e"]), ""), F.lit("</feed>")).alias("xml"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand AS feed_id, pos::INT AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'navigation' ELSE 'book' END AS kind, 'A & ' || p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS author,
 CASE WHEN p_partkey % 3 = 0 THEN '/n' || p_partkey WHEN p_partkey % 7 = 0 THEN '/b' || p_partkey || '.epub' ELSE '/get/' || p_partkey END AS href, p_partkey::VARCHAR AS id,
 CASE WHEN n % 2 = 0 THEN '/p?a=1&page=2' ELSE '' END AS next, CASE WHEN n % 2 = 0 THEN '' ELSE '/p1' END AS previous, '/s?q={searchTerms}' AS search FROM p WHERE p_partkey % 5 <> 0""")
def feed_parser(spark, d):
    return packaging.parse_feed(_feeds(spark, d), "feed_id", "xml")


def _archives(spark, d):
    p = part(spark, d)
    books = p.select(key().alias("book"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.lower(F.substring("p_type", 1, 2)).alias("language"), F.when(key() % 2 == 0, "images/c.png").alias("cover"))
    chapters = p.select(key().alias("book"), F.explode(F.sequence(F.lit(1), F.col("p_size") % 3 + 1)).alias("n"), "p_name").select("book", "n", F.format_string("Chapter %d", "n").alias("title"), F.format_string('<p id="a">%s</p><a href="#a">x</a><a href="ch01.xhtml">y</a>', "p_name").alias("body"))
    images = p.where(key() % 2 == 0).select(key().alias("book"), F.lit("images/c.png").alias("src"), F.encode("p_name", "UTF-8").alias("content"))
    return render.archives(books, chapters, images, "book")


@query("SELECT p_partkey AS book, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS author, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE lower(p_type[:2]) END AS language FROM part")
def epub_metadata(spark, d):
    cut = F.when(F.col("book") % 13 == 0, F.substring("content", F.lit(1), F.lit(40))).otherwise(F.col("content"))
    return packaging.epub_metadata(_archives(spark, d).withColumn("content", cut), "book", "content")


@query("""SELECT p_partkey AS book, pos::INT AS pos, name, pos = 0 AS stored FROM (SELECT p_partkey, generate_subscripts(f, 1) - 1 AS pos, unnest(f) AS name FROM (SELECT p_partkey,
 list_concat(list_concat(['mimetype', 'META-INF/container.xml', 'OEBPS/style.css', 'OEBPS/content.opf', 'OEBPS/nav.xhtml'], list_transform(range(1, p_size % 3 + 2), lambda n: 'OEBPS/ch0' || n || '.xhtml')), CASE WHEN p_partkey % 2 = 0 THEN ['OEBPS/images/c.png'] ELSE [] END) AS f FROM part))""")
def archive_entries(spark, d):
    return render.archive_entries(_archives(spark, d), "book", "content").select("book", "pos", "name", "stored")


@query("""SELECT p_partkey AS book, e AS error FROM (SELECT p_partkey, unnest(CASE p_partkey % 6 WHEN 0 THEN ['missing from zip: OEBPS/nav.xhtml'] WHEN 1 THEN ['not in manifest: OEBPS/more.txt'] WHEN 2 THEN ['OEBPS/ch01.xhtml dead fragment #b', 'OEBPS/ch01.xhtml dead link gone.xhtml']
 WHEN 3 THEN ['OEBPS/ch01.xhtml: not well-formed XML'] WHEN 4 THEN ['mimetype is not stored uncompressed'] ELSE []::VARCHAR[] END) AS e FROM part)""")
def archive_errors(spark, d):
    e = render.archive_entries(_archives(spark, d), "book", "content")
    n, first = F.col("book") % 6, F.col("name") == "OEBPS/ch01.xhtml"
    text = F.decode("data", "UTF-8")
    broken = F.when((n == 2) & first, F.replace(F.replace(text, F.lit('href="#a"'), F.lit('href="#b"')), F.lit('"ch01.xhtml"'), F.lit('"gone.xhtml"'))).when((n == 3) & first, F.replace(text, F.lit("</html>"), F.lit("")))
    e = e.withColumn("data", F.coalesce(F.encode(broken, "UTF-8"), "data")).withColumn("stored", F.col("stored") & (n != 4)).where((n != 0) | (F.col("name") != "OEBPS/nav.xhtml"))
    twice = F.when((n == 1) & (F.col("pos") == 0), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))  # in one pass, as books are made anew for each
    e = e.withColumn("more", F.explode(twice)).withColumn("name", F.when(F.col("more"), "OEBPS/more.txt").otherwise(F.col("name"))).withColumn("pos", F.when(F.col("more"), 99).otherwise(F.col("pos")))
    return render.archive_errors(e.drop("more"), "book")


# A chapter for each part: title, reading marks, notes, verse, a figure, glossary words.
def _chapters(spark, d):
    text = F.format_string(
        "# %s & co\n\nUse *%s* {cold|r%d} and {cold|q}[^a].\n\n[^a]: note *%d*\n[^b]: unused\n\n## More <%d>\n\n```verse\npoem {hot|}\nlast[^a]\n```\n\n![A \"b\"](../images/p%d.png)\n\n# Again[^z]\n\n[^z]: end",
        "p_name", "p_brand", "p_size", "p_size", key(), key(),
    )
    return part(spark, d).select(key().alias("chapter"), text.alias("md"), F.format_string("c%d", key()).alias("prefix"))


@query("""SELECT p_partkey AS chapter, p_name || ' & co' AS title, '<h1>' || p_name || ' &amp; co</h1>' || chr(10) ||
 '<p>Use <em>' || p_brand || '</em> <a class="glm" id="' || c || '-r2" href="#' || c || '-g2">cold<span class="rd">r' || p_size || '</span></a> and cold<span class="rd">q</span><a class="fnref" id="' || c || '-fr1" href="#' || c || '-fn1"><sup>1</sup></a>.</p>' || chr(10) ||
 '<h2>More &lt;' || p_partkey || '&gt;</h2>' || chr(10) || '<div class="verse"><p>poem <a class="glm" id="' || c || '-r0" href="#' || c || '-g0">hot</a></p><p>last<a class="fnref" id="' || c || '-fr1" href="#' || c || '-fn1"><sup>1</sup></a></p></div>' || chr(10) ||
 '<figure><img src="images/p' || p_partkey || '.png" alt="A &quot;b&quot;"/><figcaption>A &quot;b&quot;</figcaption></figure>' || chr(10) ||
 '<h1>Again<a class="fnref" id="' || c || '-fr2" href="#' || c || '-fn2"><sup>2</sup></a></h1>' || chr(10) ||
 '<section class="endnotes" epub:type="endnotes"><h2>Notes</h2><ul><li id="' || c || '-fn1"><sup>1</sup> note <em>' || p_size || '</em> <a class="fnback" href="#' || c || '-fr1">↩</a></li><li id="' || c || '-fn2"><sup>2</sup> end <a class="fnback" href="#' || c || '-fr2">↩</a></li></ul></section>' ||
 '<section class="glossary" epub:type="glossary"><h2>生词 New words</h2><ul><li id="' || c || '-g0"><span class="gw">hot</span> <span class="gp"></span> <span class="gg">' || p_type || '</span> <a class="gback" href="#' || c || '-r0">↩</a></li>' ||
 '<li id="' || c || '-g1"><span class="gw">cold</span> <span class="gp">a</span> <span class="gg"></span></li><li id="' || c || '-g2"><span class="gw">cold</span> <span class="gp">b</span> <span class="gg">&#x27;</span> <a class="gback" href="#' || c || '-r2">↩</a></li></ul></section>' AS body
 FROM (SELECT *, 'c' || p_partkey AS c FROM part)""")
def chapter_html(spark, d):
    rows = _chapters(spark, d)
    words = [(0, "hot", "", None), (1, "cold", "a", ""), (2, "cold", "b", "'")]
    glossary = part(spark, d).select(key().alias("chapter"), F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(w).alias("word"), F.lit(r).alias("reading"), (F.col("p_type") if g is None else F.lit(g)).alias("gloss")) for i, w, r, g in words])).alias("g")).select("chapter", "g.*")
    return render.chapter_bodies(rows, ["chapter"], "md", "prefix", glossary)


# What a model may put around a text: reasoning before a fence, on its line or the one above; fences that don't close; none.
_AROUND = [("<think>why\n</think> ```md\n", "\n```"), ("", ""), ("<think>a</think>\n\n```\n", "\n``` \n"), ("```json\r\n", ""), ("\u00a0", "\u3000\n"), ("x <think>\n</think>", "\n```"), ("```", "\n```\nafter"), ("<think>open ", "\n```")]
_AROUND_SQL = " ".join(f"WHEN {k} THEN {a!r} || text || {b!r}" for k, (a, b) in enumerate(_AROUND)).replace("\\n", "' || chr(10) || '").replace("\\r", "' || chr(13) || '").replace("\\xa0", "' || chr(160) || '").replace("\\u3000", "' || chr(12288) || '")
_BARE_SQL = f"(SELECT conv_id, turn, {strip_sql("regexp_replace(raw, '<think>.*?</think>', '', 'gs')")} AS t FROM (SELECT *, CASE (conv_id + turn) % {len(_AROUND)} {_AROUND_SQL} END AS raw FROM conversations))"


@query(f"""SELECT conv_id, turn, CASE WHEN t LIKE '```%' THEN {strip_sql(f"array_to_string(CASE WHEN {strip_sql('l[-1]')} = '```' THEN l[2:len(l) - 1] ELSE l[2:] END, chr(10))")} ELSE t END AS body
FROM (SELECT *, regexp_split_to_array(t, '{LINE_END}') AS l FROM {_BARE_SQL})""")
def fence_strip(spark, d):
    raw = F.get(F.array(*[F.concat(F.lit(a), "text", F.lit(b)) for a, b in _AROUND]), ((F.col("conv_id") + F.col("turn")) % len(_AROUND)).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.without_fences(raw).alias("body"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS hits FROM documents")
def literal_occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", joins.occurrences(F.col("text"), F.lit("the")).alias("hits"))
