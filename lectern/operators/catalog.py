"""The catalogue of works: metadata precedence, ids, grouping, search, pages, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str, fields: list[str], last: dict[str, Column]) -> DataFrame:
    """Each field from the first source that isn't blank: primary, fallback, then the given expression."""
    right = fallback.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    rows = primary.join(right, key, "left")
    filled = [F.coalesce(F.nullif(F.col(f), F.lit("")), F.nullif(F.col(f"__{f}"), F.lit("")), last.get(f, F.lit(""))).alias(f) for f in fields]
    return rows.select(*[c for c in primary.columns if c not in fields], *filled)


def with_ids(books: DataFrame, rel: str = "rel", path: str = "path", root: str | None = None) -> DataFrame:
    """12 hex digits of the relative path's hash; of paths that collide all but the first (by ``root``, then path) hash their absolute path."""
    order = ([root] if root else []) + [path]
    n = F.row_number().over(Window.partitionBy(rel).orderBy(*order))
    return books.withColumn("id", F.when(n == 1, T.short_hash(F.col(rel))).otherwise(T.short_hash(F.col(path))))


def one_root(files: DataFrame, root: str = "root", path: str = "path") -> DataFrame:
    """Files found under several roots once: under the first of them."""
    n = F.row_number().over(Window.partitionBy(path).orderBy(root))
    return files.withColumn("__n", n).where("__n = 1").drop("__n")


def title_of_name(name: Column) -> Column:
    """A title from a file name: its stem with blanks for '_' and '-'; the name, if nothing is left."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    clean = T.clean_metadata(F.translate(stem, "_-", "  "))
    return F.when(clean != "", clean).otherwise(name)


def library(files: DataFrame, metadata: DataFrame, fallback: DataFrame) -> DataFrame:
    """The catalogue: (id, path, rel, title, author, language, size, mtime, slug).

    ``files``: root (its rank), path, rel, name, size, mtime; ``metadata`` and
    ``fallback``: path, title, author, language, null or '' where unknown. A book counts
    once, under the first root; a title comes from the name if nothing else gives one.
    """
    rows = with_ids(one_root(files), root="root")
    fields = ["title", "author", "language"]
    rows = rows.join(metadata.select("path", *fields), "path", "left")
    rows = with_fallback(rows, fallback, "path", fields, {"title": title_of_name(F.col("name"))})
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    return rows.select("id", "path", "rel", *fields, "size", "mtime", T.slug(F.col("title"), stem).alias("slug"))


def by_id(books: DataFrame, book_id: str, rescan=None) -> DataFrame:
    """The book of an id; a miss asks ``rescan`` for a fresh catalogue once."""
    found = books.where(F.col("id") == book_id)
    return rescan().where(F.col("id") == book_id) if rescan is not None and found.isEmpty() else found


def report(books: DataFrame) -> DataFrame:
    """(rel, line, note): each book as a JSON object, and how many books share its label on a device."""
    label = [F.lower("author"), F.lower("title")]
    n = F.count("*").over(Window.partitionBy(*label))
    line = F.to_json(F.struct(*[c for c in ("id", "rel", "title", "author", "language", "size") if c in books.columns]))
    return books.select("rel", line.alias("line"), F.when(n > 1, F.format_string("%d books share this label", n)).alias("note"))


def grouped(books: DataFrame, by: Column, name: str) -> DataFrame:
    """(name, n, place): groups in case-blind order, the blank one last."""
    from lectern.operators.profile import with_row_number

    rows = books.groupBy(by.alias(name)).agg(F.count("*").alias("n"))
    return with_row_number(rows, [F.col(name) == "", F.lower(name), F.col(name)], "place").withColumn("place", F.col("place").cast("int"))


def author_key(author: Column) -> Column:
    return T.short_hash(author, 10)


def group_index(groups: DataFrame, kind: str, base: str) -> DataFrame:
    """(place, title, summary, href) for the groups of grouped(): 'authors' by hashed key, 'languages' by code."""
    name = F.col(groups.columns[0])
    if kind == "authors":
        title, key = F.when(name != "", name).otherwise("Unknown author"), author_key(name)
    else:
        title, key = F.when(name != "", F.upper(name)).otherwise("Unknown language"), F.when(name != "", name).otherwise("unknown")
    return groups.select("place", title.alias("title"), F.format_string("%d book(s)", "n").alias("summary"), F.concat(F.lit(f"{base}/opds/{kind}/"), key).alias("href"))


def drill_down(books: DataFrame, kind: str, key: str) -> DataFrame:
    """The books of one group, by an author's key or a language's code; none for an unknown one."""
    if kind == "authors":
        return books.where(author_key(F.col("author")) == key)
    return books.where(F.lower("language") == ("" if key == "unknown" else key.lower()))


def duplicate_labels(books: DataFrame) -> DataFrame:
    """Case-blind author and title of more than one book."""
    return books.groupBy(F.lower("author").alias("author_key"), F.lower("title").alias("title_key")).agg(F.count("*").alias("n")).where("n > 1")


def search(books: DataFrame, term: str) -> DataFrame:
    """Title or author contains the term, case-blind; a blank term finds nothing."""
    term = term.strip().lower()
    if not term:
        return books.where(F.lit(False))
    return books.where(F.contains(F.lower("title"), F.lit(term)) | F.contains(F.lower("author"), F.lit(term)))


#: Rows that one task may sort for a page; behind them pages come from a numbering by ranges.
TOP = 10_000


def page(books: DataFrame, order: list[Column], number: int, size: int = 25, clamp: bool = False) -> DataFrame:
    """One page with has_prev and has_next; a page behind the end is empty, or with ``clamp`` the last one.

    The sort takes the first number * size + 1 rows only (a top-k), not the table. A page that lies deeper than TOP rows is
    found by row numbers in two levels, so that no task holds more than a range; ``order`` must then be unique.
    """
    number, total = max(1, number), None
    if clamp:
        total = books.count()
        number = min(number, max(1, -(-total // size)))
    if number * size < TOP:
        top = books.orderBy(*order).limit(number * size + 1)
        rows = top.withColumn("rn", F.row_number().over(Window.orderBy(*order))).withColumn("seen", F.count("*").over(Window.partitionBy(F.lit(1))))
    else:
        from lectern.operators.profile import with_row_number

        total = books.count() if total is None else total
        rows = with_row_number(books, order).withColumn("seen", F.lit(total))
        rows = rows.withColumn("rn", F.col("rn").cast("int")) if number * size < 1 << 31 else rows
    return rows.where((F.col("rn") > (number - 1) * size) & (F.col("rn") <= number * size)).select(*books.columns, "rn", F.lit(number > 1).alias("has_prev"), (F.col("seen") > number * size).alias("has_next"))


def xml_escape(x: Column, quotes: bool = True) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


ACQUISITION = "application/atom+xml;profile=opds-catalog;kind=acquisition"
NAVIGATION = "application/atom+xml;profile=opds-catalog;kind=navigation"


def link(rel: str, href: Column, kind: str | None = None, **more: Column) -> Column:
    """A link element; values are escaped."""
    cells = [F.lit(f'<link rel="{rel}" href="'), xml_escape(href), F.lit('"')]
    cells += [F.lit(f' type="{kind}"')] if kind else []
    for name, value in more.items():
        cells += [F.lit(f' {name}="'), xml_escape(value.cast("string")), F.lit('"')]
    return F.concat(*cells, F.lit("/>"))


def entries(books: DataFrame, base: str) -> DataFrame:
    """One Atom entry a book; an empty author gives no author element."""
    href = F.concat(F.lit(f"{base}/book/"), F.col("id"), F.lit("/"), T.slug(F.col("title"), F.col("rel")), F.lit(".epub"))
    author = F.when(F.col("author") != "", F.concat(F.lit("<author><name>"), xml_escape(F.col("author")), F.lit("</name></author>"))).otherwise("")
    entry = F.concat(F.lit("<entry><id>urn:book:"), F.col("id"), F.lit("</id><title>"), xml_escape(F.col("title")), F.lit("</title>"), author, F.lit('<link rel="http://opds-spec.org/acquisition" type="application/epub+zip" href="'), href, F.lit('"/></entry>'))
    return books.select("id", entry.alias("entry"))


def navigation_entries(rows: DataFrame, kind: str = ACQUISITION) -> DataFrame:
    """``rows`` (title, summary, href) with ``entry``; rows without title or href, which a client would drop, are errors."""
    title = T.clean_metadata(F.col("title"))
    summary = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit('<content type="text">'), xml_escape(T.clean_metadata(F.col("summary"))), F.lit("</content>"))).otherwise("")
    entry = F.concat(F.lit("<entry><title>"), xml_escape(title), F.lit("</title><id>urn:nav:"), T.short_hash(F.col("href")), F.lit("</id>"), summary, link("subsection", F.col("href"), kind), F.lit("</entry>"))
    blank = (title == "") | (F.col("href") == "")
    return rows.withColumn("entry", F.when(F.coalesce(blank, F.lit(True)), F.raise_error(F.lit("an entry needs a title and a link"))).otherwise(entry))


#: Entries that one document may have.
MOST_ENTRIES = 10_000


def feeds(rows: DataFrame, page: list[str], feed_id: str, title: str, order: str, links: list[Column] = ()) -> DataFrame:
    """An Atom document for each value of ``page``, of its entries (entry, mtime, and the order column); ``links`` stand at feed level.

    A document is one group; one of over MOST_ENTRIES entries is an error.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("entry").alias("e"))))
    head = f'<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><id>{feed_id}</id><title>{title}</title><updated>'
    sizes = rows.groupBy(*page).agg(F.count("*").alias("__n"))
    if not sizes.where(F.col("__n") > MOST_ENTRIES).isEmpty():  # before anything is collected
        raise ValueError(f"a feed has over {MOST_ENTRIES} entries: cut it into pages")
    made = rows.groupBy(*page).agg(cells.alias("c"), F.coalesce(T.rfc3339(F.max("mtime")), F.lit("1970-01-01T00:00:00Z")).alias("u"))
    return made.select(*page, F.concat(F.lit(head), F.col("u"), F.lit("</updated>"), *links, F.array_join(F.transform("c", lambda x: x["e"]), ""), F.lit("</feed>")).alias("xml"))


def feed(rows: DataFrame, feed_id: str, title: str, order: str, links: list[Column] = ()) -> DataFrame:
    """The Atom document of one page of entries: see feeds()."""
    return feeds(rows, [], feed_id, title, order, links)


def page_links(base: str, path: str, number: int, has_prev: bool, has_next: bool, term: str = "") -> list[Column]:
    """Feed-level links of a page: self, start, search, and the pages before and after, which keep the search term."""
    query = "&" + "q=" + term if term else ""
    at = lambda n: F.lit(f"{base}{path}?page={n}{query}")
    out = [link("self", at(number), ACQUISITION), link("start", F.lit(f"{base}/opds"), NAVIGATION)]
    out += [link("search", F.lit(f"{base}/opds/opensearch.xml"), "application/opensearchdescription+xml"), link("search", F.lit(f"{base}/opds/search?q={{searchTerms}}"), "application/atom+xml")]
    return out + ([link("previous", at(number - 1), ACQUISITION)] if has_prev else []) + ([link("next", at(number + 1), ACQUISITION)] if has_next else [])


def page_feed(books: DataFrame, order: list[Column], number: int, size: int, base: str, path: str, title: str, term: str = "") -> DataFrame:
    """One page of a book list as a feed; its title carries the page's number if there are others."""
    rows = page(books, order, number, size)
    number = max(1, number)
    marks = rows.agg(F.max("has_next").alias("n")).first()["n"]  # one value
    named = f"{title} ({number})" if number > 1 or marks else title
    made = entries(rows, base).join(rows.select("id", "rn", "mtime"), "id")
    return feed(made, f"urn:catalog:{path.strip('/').replace('/', ':')}", named, "rn", page_links(base, path, number, number > 1, bool(marks), term))


def opensearch(base: str, title: str) -> str:
    """The search descriptor of a catalogue."""
    from xml.sax.saxutils import escape

    return (
        f'<?xml version="1.0" encoding="UTF-8"?><OpenSearchDescription xmlns="http://a9.com/-/spec/opensearch/1.1/"><ShortName>{escape(title)}</ShortName>'
        f'<Description>Search {escape(title)}</Description><InputEncoding>UTF-8</InputEncoding><Url type="{ACQUISITION}" template="{escape(base)}/opds/search?q={{searchTerms}}"/></OpenSearchDescription>'
    )


def sections(books: DataFrame) -> DataFrame:
    return books.agg(F.count("*").alias("total"), F.countDistinct("author").alias("authors"), F.countDistinct(F.lower("language")).alias("languages"))
