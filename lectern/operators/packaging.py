"""Book packages: feeds, metadata of archives, byte-identical archives."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.functions import text as T
from lectern.operators import render

# Marks by which a feed's reader knows links to books, to feeds and the search template.
ACQUISITION_MARK, EPUB_TYPE, FEED_MARK, SEARCH_MARK = "opds-spec.org/acquisition", "application/epub+zip", "application/atom+xml", "{searchTerms}"


def _links(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?s)(<(?:\w+:)?link\s[^>]*>)"), F.lit(1))


def _href(tags: Column, at: int) -> Column:
    return F.coalesce(F.try_element_at(F.transform(tags, lambda l: F.regexp_extract(l, r'\bhref="([^"]*)"', 1)), F.lit(at)), F.lit(""))


def parse_feed(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """Entries of Atom feeds: key, pos, kind, title, author, href, id, and the feed's next, previous and search links.

    A book has an acquisition link of an archive's type: the first whose address looks like
    an archive, else the first. An entry without one leads to a feed, by its last feed
    link. Entries without title or link go. A feed's own links are found once, and its
    text stays behind when its entries become rows.
    """
    whole = F.col(xml)
    plain = lambda l, name: F.regexp_extract(l, rf'\b{name}="([^"]*)"', 1)
    tag = lambda name: F.regexp_extract("e", rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", 1)
    related = lambda links, rel: F.filter(links, lambda l: plain(l, "rel") == rel)
    head = _links(F.regexp_replace(whole, r"(?s)<entry\b.*</entry>", ""))
    rows = feeds.select(
        key, *[_href(related(head, r), -1).alias(r) for r in ("next", "previous")],
        _href(F.filter(_links(whole), lambda l: (plain(l, "rel") == "search") & plain(l, "href").contains(SEARCH_MARK)), -1).alias("search"),
        F.regexp_extract_all(whole, F.lit(r"(?s)(<entry\b.*?</entry>)"), F.lit(1)).alias("entries"),
    )
    rows = rows.select(key, "next", "previous", "search", F.posexplode("entries").alias("pos", "e")).withColumn("all", _links(F.col("e")))
    books = F.filter("all", lambda l: plain(l, "rel").contains(ACQUISITION_MARK) & (plain(l, "type") == EPUB_TYPE) & (plain(l, "href") != ""))
    rows = rows.withColumn("books", books).withColumn("plain", F.filter("books", lambda l: plain(l, "href").contains(".epub") | plain(l, "href").contains("/epub/")))
    rows = rows.withColumn("feeds", F.filter("all", lambda l: plain(l, "type").contains(FEED_MARK) & (plain(l, "href") != "")))
    address = F.when(F.size("plain") > 0, _href(F.col("plain"), 1)).when(F.size("books") > 0, _href(F.col("books"), 1)).otherwise(_href(F.col("feeds"), -1))
    rows = rows.select(
        key, "pos", F.when(F.size("books") > 0, "book").otherwise("navigation").alias("kind"), tag("title").alias("title"), F.regexp_extract("e", r"(?s)<author>.*?<name>(.*?)</name>", 1).alias("author"),
        address.alias("href"), tag("id").alias("id"), "next", "previous", "search",
    )
    text = ("title", "author", "href", "id", "next", "previous", "search")
    return rows.where("title <> '' and href <> ''").select(key, "pos", "kind", *[T.unescape_html(F.col(c)).alias(c) for c in text])


def entry_by_title(entries: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The first entry of each feed with exactly the ``title`` that ``wanted`` (key, title) names; no row for a title that isn't there."""
    found = entries.join(wanted.select(key, "title").distinct(), [key, "title"])
    columns = [c for c in entries.columns if c not in (key, "title")]
    return found.groupBy(key, "title").agg(F.min_by(F.struct(*columns), "pos").alias("e")).select(key, "title", "e.*")


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("title", "author", "language")]))
def _metadata(content: pd.Series) -> pd.DataFrame:
    out = []
    for raw in content:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                opf = re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode())[1]
                xml = z.read(opf).decode()
            field = lambda name: (m[1].strip() if (m := re.search(rf"(?s)<dc:{name}[^>]*>(.*?)</dc:{name}>", xml)) else None)  # noqa: E731, B023
            out.append((field("title"), field("creator"), field("language")))
        except Exception:  # any broken archive has no metadata
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["title", "author", "language"])


def epub_metadata(files: DataFrame, key: str, content: str) -> DataFrame:
    """Title, author and language from an archive's package document; nulls for anything unreadable."""
    return files.select(key, _metadata(F.col(content)).alias("m")).select(key, "m.*")


def epub_bytes(title: str, author: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """An archive of (title, body) chapters; equal sources give equal bytes."""
    return render.archive(title, author, language, chapters, {})


def build_archives(chapters: DataFrame) -> DataFrame:
    """(book, title, author, language, pos, heading, body) -> (book, content): a book is one group, bounded by its size."""

    def build(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos")
        first = df.iloc[0]
        return pd.DataFrame({"book": [first["book"]], "content": [epub_bytes(first["title"], first["author"], first["language"], list(zip(df["heading"], df["body"], strict=True)))]})

    return chapters.groupBy("book").applyInPandas(build, f"book {chapters.schema['book'].dataType.simpleString()}, content binary")
