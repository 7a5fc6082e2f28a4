"""Feeds of a server as rows: pages followed from a start address, one task a feed.

Redirects are stepped by hand, a bounded number of them, and a page's size is bounded; whatever fails is a row with a
reason, and ends that feed. ``feed_pages`` reads the feeds of a table, ``FeedSource`` those of an option; ``crawl``
writes what it has read to a folder and goes on from there the next time.
"""

from __future__ import annotations

import base64
import html
import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.functions import fixed

PAGE = "feed string, start string, number int, url string, status int, body string, next string, error string"
_LINK = re.compile(r"(?s)<(?:\w+:)?link\s[^>]*>")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def fetch(url: str, most_bytes: int, timeout: float = 30.0, user: str = "", password: str = "") -> tuple[int, bytes, str, str | None]:
    """(status, body, the address at last, error). A name and a password are sent if both are given, and to the first host only."""
    opener, first = urllib.request.build_opener(_NoRedirect), urlsplit(url).netloc
    for _ in range(fixed.MAX_REDIRECTS + 1):
        if urlsplit(url).scheme not in ("http", "https"):
            return 0, b"", url, f"not a web address: {url}"
        request = urllib.request.Request(url, headers={"User-Agent": fixed.USER_AGENT})
        if user and password and urlsplit(url).netloc == first:
            request.add_header("Authorization", "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode())
        try:
            with opener.open(request, timeout=timeout) as answer:
                body = answer.read(most_bytes + 1)
                if len(body) > most_bytes:
                    return answer.status, b"", url, f"over {most_bytes} bytes from {url}"
                return answer.status, body, url, None if answer.status == 200 else f"HTTP {answer.status} from {url}"
        except urllib.error.HTTPError as e:
            if e.code in fixed.REDIRECTS and e.headers.get("Location"):
                url = urljoin(url, e.headers["Location"])
                continue
            return e.code, b"", url, f"HTTP {e.code} from {url}"
        except (OSError, ValueError) as e:
            return 0, b"", url, f"{type(e).__name__} from {url}"
    return 0, b"", url, f"over {fixed.MAX_REDIRECTS} redirects to {url}"


def next_link(body: str, url: str) -> str | None:
    """The address of the feed's last link to a next page, outside its entries."""
    found = None
    for link in _LINK.findall(re.sub(r"(?s)<entry\b.*</entry>", "", body)):
        given = dict(re.findall(r'\b(rel|href)="([^"]*)"', link))
        if given.get("rel") == "next" and given.get("href"):
            found = urljoin(url, html.unescape(given["href"]))
    return found


def walk(feed: str, start: str, number: int, most_pages: int, most_bytes: int, timeout: float, user: str = "", password: str = "") -> Iterator[tuple]:
    """Rows of PAGE from ``start``, page ``number`` of the feed, along its next links; a page met again ends it."""
    seen, url = set(), start
    while url and url not in seen and len(seen) < most_pages:
        seen.add(url)
        status, raw, at, error = fetch(url, most_bytes, timeout, user, password)
        body = None
        if error is None:
            try:
                body = raw.decode()
            except UnicodeDecodeError:
                error = f"not UTF-8 ({at})"
        following = None if error else next_link(body, at)
        yield feed, start, number, url, status, body, following if following not in seen else None, error
        url, number = following, number + 1


def feed_pages(feeds: DataFrame, most_pages: int = 1000, most_bytes: int = 20 << 20, timeout: float = 30.0, user: str = "", password: str = "") -> DataFrame:
    """(feed, start, number) -> rows of PAGE. Feeds are dealt out by hash; a feed's pages are read one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for feed, start, number in df.itertuples(index=False):
                for row in walk(feed, start, int(number), most_pages, most_bytes, timeout, user, password):  # a page at a time
                    yield pd.DataFrame([row], columns=[c.split()[0] for c in PAGE.split(", ")])

    tasks = int(feeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return feeds.select("feed", "start", F.col("number").cast("int")).repartition(tasks, "feed").mapInPandas(run, PAGE)


def crawl(spark: SparkSession, feeds: DataFrame, visited: str, **limits) -> DataFrame:
    """All pages of ``feeds`` (feed, the address) that ``visited``, a folder of pages, doesn't have; they are added to it.

    A feed goes on where its last good page pointed to; one whose last page had no next is finished; one that failed is
    tried again from the page that failed. Returns all pages of the folder, without rows of errors that a later read mended.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(visited)
    known = spark.read.schema(PAGE).parquet(visited) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else spark.createDataFrame([], PAGE)
    last = known.where("error is null").groupBy("feed").agg(F.max(F.struct("number", "next")).alias("last"))
    todo = feeds.select("feed").distinct().join(last, "feed", "left").where("last is null or last.next is not null")
    starts = todo.select("feed", F.coalesce("last.next", "feed").alias("start"), (F.coalesce("last.number", F.lit(0)) + 1).alias("number"))
    feed_pages(starts, **limits).write.mode("append").parquet(visited)
    pages = spark.read.schema(PAGE).parquet(visited)
    good = F.row_number().over(Window.partitionBy("feed", "number").orderBy(F.col("error").isNotNull(), "url"))
    return pages.withColumn("__n", good).where("__n = 1").drop("__n")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.feeds = json.loads(options.get("feeds", "[]"))
        self.limits = int(options.get("pages", 1000)), int(options.get("bytes", 20 << 20)), float(options.get("timeout", 30)), options.get("user", ""), options.get("password", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.feeds]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is not None:  # there is one even for no feeds
            yield from walk(partition.value, partition.value, 1, *self.limits)


class FeedSource(DataSource):
    """``spark.read.format("feed_pages").option("feeds", '["http://..."]')``: a partition a feed, rows of PAGE.

    Options: feeds (a JSON list), pages and bytes (bounds a feed and a page), timeout, user, password.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
