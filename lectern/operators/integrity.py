"""Archive and link checks: manifests, spines, dangling links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href) of all href attributes."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'(?i)href\s*=\s*"([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(hrefs).alias("pos", "href"))


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, anchor) of all id attributes."""
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r'(?i)\bid\s*=\s*"([^"]*)"'), F.lit(1)))).alias("anchor"))


def dangling_fragments(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Links inside a page whose fragment no element of that page has."""
    inner = links(pages, key, html).where(F.col("href").startswith("#")).withColumn("anchor", F.substring("href", F.lit(2), F.length("href")))
    return inner.join(anchors(pages, key, html), [key, "anchor"], "left_anti").select(key, "pos", "href")


def parse_manifest(opf: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, item, href, media_type) of the manifest's items."""
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<item\s[^>]*>)"), F.lit(1))
    attr = lambda name: F.regexp_extract("tag", rf'\b{name}="([^"]*)"', 1)
    return opf.select(key, F.explode(items).alias("tag")).select(key, attr("id").alias("item"), attr("href").alias("href"), attr("media-type").alias("media_type"))


def parse_spine(opf: DataFrame, key: str, xml: str) -> DataFrame:
    return opf.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r'(?s)<itemref\s[^>]*?idref="([^"]*)"'), F.lit(1))).alias("pos", "item"))


def spine_errors(opf: DataFrame, key: str, xml: str) -> DataFrame:
    """Spine references without an item, and empty spines."""
    spine = parse_spine(opf, key, xml)
    lost = spine.join(parse_manifest(opf, key, xml), [key, "item"], "left_anti").select(key, F.concat(F.lit("dangling "), "item").alias("error"))
    return lost.unionByName(opf.select(key).join(spine.select(key).distinct(), key, "left_anti").withColumn("error", F.lit("empty spine")))


def dead_links(files: DataFrame, book: str, name: str, html: str, entries: DataFrame) -> DataFrame:
    """(book, name, href, error) of links in a book's documents that lead nowhere.

    ``files``: the documents; ``entries``: (book, name) of everything in the archive. A
    bare fragment must be an id of its own document; of other local links the file part,
    resolved against the document's folder, must be an entry. Web and mail links pass.
    """
    return dead_references(files.select(book, name, *references(F.col(html))), book, name, entries)


def references(html: Column) -> tuple[Column, Column]:
    """hrefs and ids of a document: what its links point to, and what links may point to."""
    found = lambda rx: F.array_distinct(F.regexp_extract_all(html, F.lit(rx), F.lit(1)))
    return found(r'(?:href|src)="([^"]+)"').alias("hrefs"), found(r'id="([^"]+)"').alias("ids")


def dead_references(files: DataFrame, book: str, name: str, entries: DataFrame) -> DataFrame:
    """dead_links() of documents whose ``hrefs`` and ``ids`` are found already: see references()."""
    rows = files.select(book, name, F.explode("hrefs").alias("href"))
    inner = rows.where(F.col("href").startswith("#")).withColumn("anchor", F.substring("href", F.lit(2), F.length("href")))
    ids = files.select(book, name, F.explode("ids").alias("anchor"))
    lost = inner.join(ids, [book, name, "anchor"], "left_anti").select(book, name, "href", F.lit("dead fragment").alias("error"))
    outer = rows.where(~F.col("href").rlike("^(#|https?://|mailto:)"))
    folder = F.regexp_extract(name, r"^(.*/)?[^/]*$", 1)
    outer = outer.withColumn("target", resolve_path(F.concat(folder, F.regexp_extract("href", r"^([^#]*)", 1))))
    held = entries.select(book, F.col(name).alias("target")).distinct()
    return lost.unionByName(outer.join(held, [book, "target"], "left_anti").select(book, name, "href", F.lit("dead link").alias("error")))


def resolve_path(path):
    """A relative path without '.', '..' and empty parts; '..' at its start stays."""
    def step(a, part):
        up = (part == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != "..")
        return F.when((part == "") | (part == "."), a).when(up, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def verdict(books: DataFrame, book: str, errors: list[DataFrame]) -> DataFrame:
    """(book, errors, passed): how many rows the error tables have for each book; passed without any."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [e.select(book) for e in errors])
    counted = every.groupBy(book).agg(F.count("*").alias("errors"))
    return books.select(book).join(counted, book, "left").select(book, F.coalesce("errors", F.lit(0)).alias("errors"), F.col("errors").isNull().alias("passed"))


def checksums(lines: DataFrame, file: str, pos: str, text: str) -> DataFrame:
    """(name, bytes, md5) of a manifest's lines NAME<TAB>BYTES<TAB>MD5; comments and blank lines are skipped.

    Reading a file ends at the first line whose size is no number: rows before it stay.
    """
    from pyspark.sql import Window

    cell = lambda k: F.coalesce(F.get(F.split(F.col(text), "\t"), F.lit(k)), F.lit(""))
    rows = lines.where((T.strip(F.col(text)) != "") & ~F.col(text).startswith("#"))
    rows = rows.select(file, pos, cell(0).alias("name"), F.expr("try_cast(null as long)").alias("bytes"), cell(2).alias("md5"), T.strip(cell(1)).alias("size"))
    rows = rows.withColumn("bytes", F.when(F.col("size").rlike(r"^[+-]?\d+$"), F.col("size").cast("long")))
    broken = F.count_if(F.col("bytes").isNull()).over(Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("broken", broken).where("broken = 0").select(file, "name", "bytes", "md5")


def font_families(files: DataFrame) -> DataFrame:
    """(family, sizes, bytes, ui_ready) of font files (rel: FAMILY/NAME_SIZE.ending, size): the sizes as a sorted set."""
    from lectern.functions import fixed

    family, number = F.regexp_extract("rel", r"^([^/]+)/[^/]+$", 1), F.regexp_extract("rel", r"_(\d+)\.[^./]*$", 1)
    rows = files.select(family.alias("family"), F.nullif(number, F.lit("")).cast("int").alias("n"), "size").where("family <> ''")
    out = rows.groupBy("family").agg(F.array_sort(F.collect_set("n")).alias("sizes"), F.sum("size").alias("bytes"))
    return out.withColumn("ui_ready", F.size(F.array_except(F.array(*map(F.lit, fixed.UI_SIZES)), "sizes")) == 0)


def newest_files(files: DataFrame, by: list[str], most: int | None = None, newest: bool = True) -> DataFrame:
    """Files of each group by time, the newest first, names break ties: with ``place`` (from 1), ``most`` at most."""
    from pyspark.sql import Window

    time = F.col("mtime").desc() if newest else F.col("mtime").asc()
    rows = files.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(time, "name")))
    return rows.where(F.col("place") <= most) if most else rows


def listing(files: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """A folder's entries: folders first, then case-blind by name; with ``place``, ``most`` at most."""
    from pyspark.sql import Window

    rows = files.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(~F.col("is_folder"), F.lower("name"), "name")))
    return rows.where(F.col("place") <= most) if most else rows


def page_text(pages: DataFrame, key: str, html: str, closed: bool = False) -> DataFrame:
    return pages.select(key, T.html_text(F.col(html), closed).alias("body_text"))


def number_references(refs: DataFrame, doc: str, marker: str, pos: str) -> DataFrame:
    """Markers numbered by first reference in each document."""
    from pyspark.sql import Window

    first = refs.groupBy(doc, marker).agg(F.min(pos).alias("first_pos"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy("first_pos", marker)))


def checksum_report(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Each expected row with ``ok``: present and equal."""
    right = actual.select(key, F.col(value).alias("__actual"))
    return expected.join(right, key, "left").select(key, F.col(value), F.col("__actual").alias("actual"), F.coalesce(F.col("__actual") == F.col(value), F.lit(False)).alias("ok"))


def footnotes(refs: DataFrame, defs: DataFrame, doc: str) -> DataFrame:
    """(doc, marker, number, note, error): referenced notes in order of first reference; a reference without a note is an error.

    ``refs``: doc, marker, pos; ``defs``: doc, marker, pos, note, the last of a marker wins.
    """
    notes = defs.groupBy(doc, "marker").agg(F.max_by("note", "pos").alias("note"))
    numbered = number_references(refs, doc, "marker", "pos")
    rows = numbered.join(notes.withColumn("known", F.lit(True)), [doc, "marker"], "left")
    return rows.select(doc, "marker", "number", "note", F.when(F.col("known").isNull(), F.concat(F.lit("undefined footnote reference "), "marker")).alias("error"))


def spine_text(chapters: DataFrame, book: str, html: str) -> DataFrame:
    """(book, text): the texts of a book's documents in spine order (pos), a line feed between them."""
    rows = chapters.select(book, "pos", T.html_text(F.col(html)).alias("t"))
    cells = F.array_sort(F.collect_list(F.struct("pos", "t")))
    return rows.groupBy(book).agg(F.array_join(F.transform(cells, lambda c: c["t"]), "\n").alias("text"))


def inside(root, path):
    """Whether an absolute path, its '..' resolved, is the root or lies below it."""
    a, b = resolve_path(root), resolve_path(path)
    return (a == b) | b.startswith(F.concat(a, F.lit("/"))) | (a == "")


def cover_reasons(kind, progressive, mode, w, h):
    """Why an image can't be a cover as it is: format, coding, colour, size; empty for a fit one."""
    from lectern.functions import fixed

    named = F.upper(F.coalesce(kind, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(~named.isin("PNG", "JPEG"), F.concat(F.lit("format "), F.when(named == "", "?").otherwise(named), F.lit(" (need PNG or baseline JPEG)"))),
            F.when((named == "JPEG") & progressive, "progressive JPEG (renders as [Image] placeholder)"),
            F.when(~mode.isin("L", "1"), F.concat(F.lit("mode "), mode, F.lit(" (need grayscale)"))),
            F.when((w > fixed.PANEL_W) | (h > fixed.PANEL_H), F.format_string(f"size %dx%d (exceeds {fixed.PANEL_W}x{fixed.PANEL_H} panel)", w, h)),
        )
    )
