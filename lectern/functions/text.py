"""Scalar text functions as Spark columns."""

from __future__ import annotations

import functools
import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import fixed

LATIN_WORD = r"[\p{L}\p{Nl}\p{No}]+"
HAN = r"[一-鿿]"


def no_space(x: Column) -> Column:
    """All Unicode white space removed."""
    return F.regexp_replace(x, f"[{fixed.WHITE}]+", "")


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, f"^[{fixed.WHITE}]+|[{fixed.WHITE}]+$", "")


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(x: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(x, f"[{fixed.WHITE}]+"), lambda w: w != "")


def latin_words(x: Column) -> Column:
    """Lower-cased runs of letters and letter-like numerals, without digits and underscores."""
    return F.regexp_extract_all(F.lower(x), F.lit(f"({LATIN_WORD})"), F.lit(1))


def lines_of(x: Column) -> Column:
    """Lines that hold more than white space."""
    return F.filter(F.split(x, fixed.LINE_END), lambda l: l.rlike(f"[^{fixed.WHITE}]"))


def digit_mask(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\p{Nd}+", "#"))


def has_han(x: Column) -> Column:
    return x.rlike(HAN)


def han_chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({HAN})"), F.lit(1))


def is_number(x: Column) -> Column:
    """Optional ordinal mark, numerals, then optionally a measure word."""
    return x.rlike(f"^第?[{fixed.NUMERALS}]+(个?[{fixed.MEASURES}])?$")


def is_self_doubled(line: Column) -> Column:
    """Whether a line, white space aside, is one text of at least eight characters twice."""

    def doubled(n: Column) -> Column:
        size = F.length(n)
        half = (size / 2).cast("int")
        return (size >= 16) & (size % 2 == 0) & (F.substring(n, F.lit(1), half) == F.substring(n, half + 1, half))

    return (F.length(line) >= 16) & bound(no_space(line), doubled)


def dedoubled(line: Column) -> Column:
    """A self-doubled line cut behind the last character of its first copy."""
    half = (F.length(no_space(line)) / 2).cast("int")
    chars = F.split(line, "")
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("cut"), F.lit(0).alias("at"))

    def step(a, c):
        seen = a["seen"] + F.when(c.rlike(f"^[{fixed.WHITE}]?$"), 0).otherwise(1)
        at = a["at"] + F.length(c)
        return F.struct(seen.alias("seen"), F.when((a["cut"] == 0) & (seen >= half), at).otherwise(a["cut"]).alias("cut"), at.alias("at"))

    cut = F.aggregate(chars, start, step, lambda a: a["cut"])
    return F.when(is_self_doubled(line), strip(F.substring(line, F.lit(1), cut))).otherwise(line)


def level_ceiling(x: Column) -> Column:
    """The largest integer in a string, else null."""
    return F.array_max(F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int")))


def compact_reading(x: Column) -> Column:
    """Spaces dropped from a reading unless it has capitals."""
    return F.when(x.rlike(r"\p{Lu}"), x).otherwise(F.replace(x, F.lit(" "), F.lit("")))


def gloss_short(x: Column, most: int = fixed.GLOSS_LENGTH) -> Column:
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 3), F.lit(" ;,")), F.lit("..."))).otherwise(x)


def blocks(md: Column) -> Column:
    """Markdown blocks divided by blank lines."""
    return F.filter(F.split(strip(md), r"\n\s*\n"), lambda b: strip(b) != "")


def without_headings(x: Column) -> Column:
    """Without heading and recap lines."""
    return F.regexp_replace(F.regexp_replace(x, r"(?m)^#.*$", ""), r"(?m)^RECAP:.*$", "")


def chapter_prose(x: Column) -> Column:
    """Fence lines dropped, heading marks dropped, the text of headings kept."""
    return F.regexp_replace(F.regexp_replace(x, r"(?m)^```.*$", ""), r"(?m)^#+\s*", "")


def is_structure(line: Column) -> Column:
    return line.rlike(r"^\s*(#|```|!\[|\[\^)")


def slug(x: Column, fallback: Column | None = None) -> Column:
    """ASCII words joined by hyphens, 60 characters at most; the fallback's, then 'book', for nothing left."""
    def one(c):
        s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
        return F.when(s != "", F.substring(s, 1, fixed.SLUG_LENGTH))

    return F.coalesce(one(x), one(F.lit("") if fallback is None else fallback), F.lit("book"))


def stem_slug(name: Column) -> Column:
    stem = F.lower(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", ""))
    s = F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s != "", s).otherwise("untitled")


def safe_filename(name: Column, most: int = 100) -> Column:
    """A file name of at most ``most`` UTF-8 bytes: unsafe characters become '_', control characters go."""
    chars = F.split(F.regexp_replace(name, r"^[ .]+", ""), "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(a, c):
        unsafe = F.lit(fixed.UNSAFE_IN_NAME).contains(c) & (c != "")
        put = F.when(unsafe, F.lit("_")).when(c.rlike(r"^[\x00-\x1f\x7f]$"), F.lit("")).otherwise(c)
        size = F.octet_length(put)
        full = a["full"] | (a["n"] + size > most)
        return F.struct(F.when(full, a["out"]).otherwise(F.concat(a["out"], put)).alias("out"), F.when(full, a["n"]).otherwise(a["n"] + size).alias("n"), full.alias("full"))

    kept = F.rtrim(F.aggregate(chars, start, step, lambda a: a["out"]), F.lit(" ."))
    return F.when(kept != "", kept).otherwise("book")


def book_filename(author: Column, title: Column, layout: int = 0) -> Column:
    """0: author - title, 1: title - author, 2: title; a blank author gives the title alone."""
    both = F.concat_ws(" - ", author, title) if layout == 0 else F.concat_ws(" - ", title, author)
    name = title if layout == 2 else F.when(F.trim(F.coalesce(author, F.lit(""))) == "", title).otherwise(both)
    return F.concat(safe_filename(name), F.lit(".epub"))


def ensure_protocol(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))


def extract_host(url: Column) -> Column:
    """Protocol and host: everything before the first slash behind them."""
    return F.regexp_extract(url, r"^((?:.*?://)?[^/]*)", 1)


def encode_unsafe(url: Column) -> Column:
    """Percent-encode, byte by byte, what a strict client won't take; escapes pass as they are."""
    parts = F.regexp_extract_all(url, F.lit(r"(%[0-9A-Fa-f]{2}|(?s:.))"), F.lit(1))
    bad = F.lit(fixed.UNSAFE_IN_URL)

    def one(c):
        escape = F.regexp_replace(F.hex(F.encode(c, "UTF-8")), r"(..)", "%$1")
        return F.when(F.length(c) == 3, c).when((c == "%") | c.rlike(r"[\x00-\x20]|[^\x00-\x7e]") | bad.contains(c), escape).otherwise(c)

    return F.array_join(F.transform(parts, one), "")


def build_url(server: Column, path: Column) -> Column:
    """A plain join: absolute paths stand alone, rooted ones follow the host, others the base."""
    base = F.regexp_extract(ensure_protocol(server), r"^([^?]*)", 1)
    joined = (
        F.when(path.contains("://"), path)
        .when(path == "", ensure_protocol(server))
        .when(path.startswith("/"), F.concat(extract_host(ensure_protocol(server)), path))
        .otherwise(F.concat(F.regexp_replace(base, r"([^/])$", "$1/"), path))
    )
    return encode_unsafe(joined)


def clean_metadata(x: Column) -> Column:
    """Characters that XML forbids dropped, white space of any kind collapsed."""
    return F.array_join(words_of(F.regexp_replace(x, fixed.NOT_XML, "")), " ")


def device_path(author: Column, title: Column, layout: int = 0) -> Column:
    """Where a book lies on a reader's card: its file name, sanitised and cut as the reader does it, below the root."""
    return F.concat(F.lit("/"), book_filename(author, title, layout))


def short_hash(x: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(x), 1, n)


def rfc3339(epoch_seconds: Column) -> Column:
    """UTC, seconds truncated; independent of the session's zone. Years of five digits have no sign."""
    t = F.timestamp_seconds(F.floor(epoch_seconds))
    return F.regexp_replace(F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), r"^\+", "")


def human_size(n: Column) -> Column:
    n = n.cast("double")
    return (
        F.when(n < 1024, F.format_string("%.0f B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1024**2))
    )


def unescape_html(x: Column) -> Column:
    """All character references, named and numeric; texts without an ampersand skip the worker."""
    return F.when(x.contains("&"), _unescaped(x)).otherwise(x)


@F.pandas_udf(StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def unescape_closed(x: Column) -> Column:
    """Character references that end with a semicolon; a name cut before it stays as it is."""
    return F.when(x.contains("&"), _unescaped_closed(x)).otherwise(x)


@F.pandas_udf(StringType())
def _unescaped_closed(x: pd.Series) -> pd.Series:
    one = lambda m: html.unescape(m[0]) if m[1].startswith("#") or m[1] in html.entities.html5 else m[0]
    return x.map(lambda t: re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9A-Za-z]+;)", one, t), na_action="ignore")


def html_text(page: Column, closed: bool = False) -> Column:
    """The body (all of it, where there is none), each tag a blank, references resolved: as browsers do, or only ``closed`` ones."""
    body = F.regexp_extract(page, r"(?s)<body[^>]*>(.*)</body>", 1)
    body = F.when(page.rlike(r"(?s)<body[^>]*>.*</body>"), body).otherwise(page)
    plain = F.regexp_replace(body, r"<[^>]+>", " ")
    return unescape_closed(plain) if closed else unescape_html(plain)


def without_fences(x: Column) -> Column:
    """Reasoning blocks removed; of a text that then begins with a code fence its first line, and its last one if that is a bare fence."""

    def inside(t: Column) -> Column:
        lines = F.split(t, fixed.LINE_END)
        kept = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
        closed = strip(F.try_element_at(kept, F.lit(-1))) == "```"
        kept = F.when(F.coalesce(closed, F.lit(False)), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(t.startswith("```"), strip(F.array_join(kept, "\n"))).otherwise(t)

    return bound(strip(F.regexp_replace(x, r"(?s)<think>.*?</think>", "")), inside)


def host_of_address(x: Column) -> Column:
    """What a pasted address names: after the last //, up to / or white space, without brackets at its ends; null if nothing is left."""
    rest = F.try_element_at(F.split(strip(x), "//"), F.lit(-1))
    first = F.get(words_of(F.split_part(rest, F.lit("/"), F.lit(1))), 0)
    return F.btrim(first, F.lit("<>[] "))


def ordinal_zh(n: Column) -> Column:
    """Chinese numerals for 0 to 19, digits from there on."""
    digits = F.array(*[F.lit(d) for d in "零一二三四五六七八九十"])
    teens = F.concat(F.lit("十"), F.try_element_at(digits, (n - 9).cast("int")))
    return F.when((n >= 0) & (n <= 10), F.try_element_at(digits, (n + 1).cast("int"))).when((n > 10) & (n < 20), teens).otherwise(n.cast("string"))


def tone_mark(syllable: Column) -> Column:
    """A numbered syllable (hao3, LU:4) with its tone mark: a or e takes it, then the o of ou, else the last vowel. Case stays."""
    pattern = r"^([a-zA-Z:]+)([1-5])?$"
    body = F.replace(F.replace(F.regexp_extract(syllable, pattern, 1), F.lit("u:"), F.lit("v")), F.lit("U:"), F.lit("V"))
    tone = F.coalesce(F.nullif(F.regexp_extract(syllable, pattern, 2), F.lit("")).cast("int"), F.lit(5))
    low = F.lower(body)
    spot = (
        F.when(low.contains("a"), F.instr(low, "a")).when(low.contains("e"), F.instr(low, "e")).when(low.contains("ou"), F.instr(low, "o"))
        .otherwise(F.length(F.regexp_extract(low, r"^(.*[iouv])", 1)))
    )
    marks = F.create_map(*[F.lit(x) for k, v in fixed.TONES.items() for x in (k, v)])
    vowel = F.substring(body, spot, F.lit(1))
    marked = F.substring(F.try_element_at(marks, F.lower(vowel)), tone, F.lit(1))
    marked = F.when(vowel == F.upper(vowel), F.upper(marked)).otherwise(marked)
    whole = F.concat(F.substring(body, F.lit(1), spot - 1), marked, F.substring(body, spot + 1, F.length(body)))
    whole = F.when(spot > 0, F.replace(whole, F.lit("V"), F.lit("Ü"))).otherwise(body)
    return F.when(syllable.rlike(pattern), F.replace(whole, F.lit("v"), F.lit("ü"))).otherwise(syllable)


def tone_marks(numbered: Column) -> Column:
    """All syllables of a reading."""
    return F.array_join(F.transform(words_of(numbered), tone_mark), " ")


def is_wide_cjk(ch: Column) -> Column:
    """Ideographs and full-width signs, between which a line may break."""
    return ch.rlike("[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in fixed.WIDE) + "]")


def luma(b: Column, g: Column, r: Column) -> Column:
    weighted = [c * w for c, w in zip((b, g, r), fixed.LUMA, strict=True)]
    return F.shiftright(weighted[0] + weighted[1] + weighted[2], 8)


def nearest_level(v: Column) -> Column:
    low, middle, high = fixed.LEVEL_BOUNDS
    return F.when(v <= low, 0).when(v <= middle, 1).when(v <= high, 2).otherwise(3)


@functools.cache
def _digits() -> tuple[str, str]:
    """All decimal digits but 0 to 9, and what each stands for."""
    others = [c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd"]
    return "".join(others), "".join(str(unicodedata.digit(c)) for c in others)


def page_number(x: Column) -> Column:
    """A text as a whole number of at least 1: white space around it, a sign, digits of any script and single _ between them; else 1.

    Numbers of over 18 digits are the largest long.
    """
    number = strip(x)
    ascii_ = F.when(number.rlike(r"[^\x00-\x7f]"), F.translate(number, *_digits())).otherwise(number)
    digits = F.regexp_replace(F.regexp_replace(ascii_, r"[+_]", ""), r"^0+(?=.)", "")
    value = F.when(F.length(digits) > 18, F.lit(2**63 - 1)).otherwise(digits.try_cast("long"))
    return F.when(number.rlike(r"^\+?\p{Nd}+(_\p{Nd}+)*$"), F.greatest(F.lit(1).cast("long"), value)).otherwise(F.lit(1).cast("long"))


def suffix_route(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif"), "image").when(ext == ".epub", "epub").when(ext == ".pdf", "pdf").otherwise("other")


def sleep_scan_accepts(name: Column) -> Column:
    return (name != "") & ~name.startswith(".") & F.lower(name).endswith(".bmp")


def native_palette(bpp: Column, lum: Column) -> Column:
    """Whether a palette (luma values, none for true colour) maps straight to the panel's levels."""
    return (bpp <= 2) | ((F.size(lum) > 0) & F.forall(lum, lambda x: F.abs(x - F.shiftright(x, 6) * 85) <= 21))


def has_greyscale(bpp: Column) -> Column:
    return bpp > 1


def percent(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", x * 100)


def recap(x: Column) -> Column:
    """What follows 'RECAP:' in the last line that isn't blank, whatever its case; null if that line is no recap."""
    last = strip(F.try_element_at(lines_of(x), F.lit(-1)))
    return F.when(F.upper(last).startswith("RECAP:"), strip(F.substring(last, F.lit(7), F.length(last))))


def without_recap(x: Column) -> Column:
    """The text before its recap line, ended by one line feed; as it is without one."""
    cut = F.regexp_replace(F.regexp_replace(x, f"[{fixed.WHITE}]+$", ""), r"(^|[\n\r])[^\n\r]*$", "")
    return F.when(recap(x).isNotNull(), F.concat(F.regexp_replace(cut, f"[{fixed.WHITE}]+$", ""), F.lit("\n"))).otherwise(x)


def page_range(spec: Column) -> Column:
    """'A-B' or 'N' as an array of page numbers; null for a blank spec, which means all."""
    lo = F.split_part(spec, F.lit("-"), F.lit(1)).cast("int")
    hi = F.nullif(F.split_part(spec, F.lit("-"), F.lit(2)), F.lit("")).cast("int")
    return F.when(F.coalesce(strip(spec), F.lit("")) != "", F.when(F.coalesce(hi, lo) >= lo, F.sequence(lo, F.coalesce(hi, lo))).otherwise(F.array().cast("array<int>")))


def looks_structured(x: Column) -> Column:
    return x.rlike(r"(?m)^#{1,6}\s|```")


def family_of_path(path: Column) -> Column:
    """The family of a path /fonts/NAME, else null."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when((F.size(parts) == 2) & (F.lower(F.try_element_at(parts, F.lit(1))) == "fonts"), F.try_element_at(parts, F.lit(2)))
