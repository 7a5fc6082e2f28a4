"""Restoring a document by a policy: furniture out, ranges treated each in its way, units normalised, fidelity measured.

A policy is a parameter, so ranges and replacements become expressions. Documents are
independent: every step works on all of them at once, keyed by document.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import fidelity, joins, reflow
from lectern.plans.cache import pinned

TREATS = ("skip", "front_matter", "body")
MODES = ("sentence", "prose", "verse")


@dataclass(frozen=True)
class PageRange:
    """Pages ``first`` to ``last`` (None: to the end) and how to treat them; ``reflow`` overrides the policy's mode."""

    first: int
    last: int | None
    treat: str
    reflow: str | None = None

    @classmethod
    def parse(cls, pages: str, treat: str, reflow: str | None = None) -> PageRange:
        """From 'A-B' or 'N'."""
        first, _, last = pages.partition("-")
        return cls(int(first), int(last) if last else int(first), treat, reflow)


@dataclass(frozen=True)
class AnchorRange:
    """Lines from one that equals ``start`` to one that equals ``end``, both included; ``end`` is sought from the start on.

    A text that occurs several times needs its occurrence, counted from 1.
    """

    start: str
    end: str
    treat: str
    reflow: str | None = None
    start_occurrence: int | None = None
    end_occurrence: int | None = None


@dataclass(frozen=True)
class Policy:
    ranges: tuple[PageRange | AnchorRange, ...]
    furniture: tuple[str, ...] = ()
    reflow: str = "sentence"
    dehyphenate: bool = False
    exceptions: tuple[str, ...] = ()
    normalise: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        for r in self.ranges:
            if r.treat not in TREATS:
                raise ValueError(f"unknown treat {r.treat!r}")
            if (r.reflow or self.reflow) not in MODES:
                raise ValueError(f"unknown reflow {r.reflow or self.reflow!r}")


def policy_of(document: Mapping) -> Policy:
    """A policy from its JSON document; what contradicts itself in it is an error."""
    ranges: list[PageRange | AnchorRange] = []
    for r in document["page_ranges"]:
        anchored = [k for k in ("start_anchor", "end_anchor") if k in r]
        if anchored and "pages" in r:
            raise ValueError("a range cannot mix pages with anchors")
        if len(anchored) == 1:
            raise ValueError("a range needs both start_anchor and end_anchor")
        if anchored:
            ranges.append(AnchorRange(r["start_anchor"], r["end_anchor"], r["treat"], r.get("reflow"), r.get("start_anchor_occurrence"), r.get("end_anchor_occurrence")))
        else:
            ranges.append(PageRange.parse(r["pages"], r["treat"], r.get("reflow")))
    return Policy(
        tuple(ranges), tuple(document.get("furniture", ())), document.get("reflow", "sentence"), document.get("dehyphenate", False), tuple(document.get("dehyphenate_exceptions", ())), tuple(document.get("normalize", {}).items())
    )


def anchored_spans(lines: DataFrame, doc: str, r: AnchorRange) -> DataFrame:
    """(doc, s, e, error): first and last line number (n) of an anchored range in each document."""
    docs, rows = lines.select(doc).distinct(), lines.select(doc, F.col("n").alias("pos"), "text")
    start = joins.locate_anchor(rows, docs, doc, "text", r.start, r.start_occurrence).select(doc, F.col("pos").alias("s"), F.col("error").alias("first"))
    later = rows.join(start.select(doc, "s"), doc).where("pos >= s").drop("s")
    end = joins.locate_anchor(later, docs, doc, "text", r.end, r.end_occurrence).select(doc, F.col("pos").alias("e"), F.col("error").alias("last"))
    said = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: anchor "), c)) for name, c in (("start", "first"), ("end", "last"))]
    return start.join(end, doc).select(doc, "s", "e", F.coalesce(*said).alias("error"))


def with_ranges(lines: DataFrame, doc: str, policy: Policy) -> DataFrame:
    """``lines`` with ``n`` (the line's number in its document) and ``holds``: for each of the policy's ranges whether it has the line."""
    if "n" not in lines.columns:
        lines = lines.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("page", "pos")) - 1)
    holds = []
    for k, r in enumerate(policy.ranges):
        if isinstance(r, PageRange):
            holds.append(_inside(r))
            continue
        span = anchored_spans(lines, doc, r).select(doc, F.struct("s", "e", "error").alias(f"__r{k}"))
        lines = lines.join(span, doc)
        cell = F.col(f"__r{k}")
        holds.append(F.when(cell["error"].isNotNull(), F.raise_error(cell["error"]).cast("boolean")).otherwise(F.col("n").between(cell["s"], cell["e"])))
    return lines.withColumn("holds", F.array(*holds)).drop(*[f"__r{k}" for k in range(len(policy.ranges))])


def flatten(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, page, pos, n, line fields): all lines of all pages in page order; ``n`` numbers a document's lines from 0."""
    rows = reflow.flatten(pages, doc)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("page", "pos")) - 1)


def range_errors(lines: DataFrame, doc: str, policy: Policy) -> DataFrame:
    """(doc, error): why the policy's ranges don't cut a document's lines into parts: lines in none or in several, ranges without a line."""
    lines, holds = with_ranges(lines, doc, policy), policy.ranges
    n = F.size(F.filter("holds", lambda h: h))
    seen = [F.count_if(F.col("holds")[k]).alias(f"r{k}") for k in range(len(holds))]
    rows = lines.groupBy(doc).agg(F.count_if(n == 0).alias("gaps"), F.count_if(n > 1).alias("overlaps"), *seen)
    empty = [F.when(F.col(f"r{k}") == 0, f"range {k + 1} matches no line") for k in range(len(holds))]
    errors = F.array_compact(F.array(F.when(F.col("gaps") > 0, "lines in no range"), F.when(F.col("overlaps") > 0, "lines in several ranges"), *empty))
    return rows.select(doc, F.explode(errors).alias("error"))


def _inside(r: PageRange) -> Column:
    return (F.col("page") >= r.first) & (F.col("page") <= r.last if r.last is not None else F.lit(True))


def _reflowed(lines: DataFrame, doc: str, mode: str) -> DataFrame:
    """(chunk, para, kind, text) of the body lines of one mode."""
    work = {"sentence": reflow.reflow_sentence, "prose": reflow.reflow_prose, "verse": reflow.verse}[mode]
    out = work(lines, "chunk")
    if "para" not in out.columns:
        out = out.withColumn("para", F.lit(0))
    return out.select("chunk", F.col("para").cast("int").alias("para"), F.lit("verse" if mode == "verse" else "para").alias("kind"), "text")


def restore(lines: DataFrame, doc: str, policy: Policy, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Units and report of all documents.

    ``lines``: doc, page, pos, text, for prose also x0, top, bottom. Units: (doc, unit,
    kind, text), numbered from 0. Report, one row a document: lines_in, lines_out,
    furniture_dropped (a map), joins_made, hyphens_resolved, normalisations (an array in
    the table's order), paragraphs, char_ratio, ngram_containment (four places), gate_pass.
    The baseline of the ratio holds every line but furniture, skipped ranges included.

    A line in no range or in several is an error; so is, if ``strict``, a page range that
    matches no line of a document (without it, short documents may end before a range).
    """
    if policy.furniture:
        rows = lines.withColumn("furniture", joins.first_pattern(F.col("text"), list(policy.furniture)))
    else:
        rows = lines.withColumn("furniture", F.lit(None).cast("string"))
    rows = with_ranges(rows, doc, policy)
    parts_of = F.size(F.filter("holds", lambda h: h))
    wrong = F.when(parts_of == 0, "ranges do not cover the whole document").when(parts_of > 1, "ranges overlap")
    rows = rows.withColumn("range", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("int")).otherwise((F.array_position("holds", True) - 1).cast("int"))).drop("holds", "n")
    rows = pinned(rows)  # every mode's reflow and the report read them
    paged = [k for k, r in enumerate(policy.ranges) if isinstance(r, PageRange)]
    if strict and paged:
        seen = rows.groupBy(doc).agg(F.array(*[F.count_if(F.col("range") == k) for k in paged]).alias("seen"))
        bare = seen.where(F.array_contains("seen", 0)).first()
        if bare:
            r = policy.ranges[paged[bare["seen"].index(0)]]
            raise ValueError(f"{doc} {bare[doc]}: page range {r.first}-{'' if r.last is None else r.last} matches no line")
    kept = rows.where("furniture is null").withColumn("chunk", F.struct(F.col(doc).alias("d"), F.col("range").alias("r")))
    treats = {k: (r.treat, r.reflow or policy.reflow) for k, r in enumerate(policy.ranges)}
    of = lambda pick: [k for k, t in treats.items() if pick(t)]
    front = kept.where(F.col("range").isin(of(lambda t: t[0] == "front_matter") or [-1]))
    verbatim = F.row_number().over(Window.partitionBy("chunk").orderBy("page", "pos")) - 1
    parts = [front.select("chunk", verbatim.cast("int").alias("para"), F.lit("para").alias("kind"), "text")]
    merged: list[DataFrame] = []
    flows: list[DataFrame] = []
    for mode in MODES:
        mine = of(lambda t, mode=mode: t == ("body", mode))
        if not mine:
            continue
        body = kept.where(F.col("range").isin(mine))
        if policy.dehyphenate:
            joined = reflow.dehyphenate(body, "chunk", policy.exceptions)
            merged.append(joined.groupBy("chunk").agg(F.sum("merged").alias("hyphens")))
            if mode == "prose":
                # a joined line keeps its first line's left edge and top, and its last line's bottom
                w = Window.partitionBy("chunk").orderBy("page", "pos")
                ends = F.sum(F.when(F.col("head").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
                marked = body.join(joined.select("chunk", "page", "pos", F.lit(1).alias("head"), F.col("text").alias("whole")), ["chunk", "page", "pos"], "left").withColumn("g", ends)
                body = marked.groupBy("chunk", "g").agg(
                    *[F.min_by(c, F.struct("page", "pos")).alias(c) for c in ("page", "pos", "x0", "top")], F.max_by("bottom", F.struct("page", "pos")).alias("bottom"), F.max("whole").alias("text")
                )
            else:
                body = joined
        if mode != "verse":
            flows.append(body.select("chunk"))
        parts.append(_reflowed(body, doc, mode))
    units = reduce(DataFrame.unionByName, parts)
    units = units.select(F.col("chunk.d").alias(doc), F.col("chunk.r").alias("range"), "para", "kind", "text")
    units = reflow.normalise(units, "text", list(policy.normalise)) if policy.normalise else units.withColumn("hits", F.array().cast("array<bigint>"))
    begins = kept.groupBy(doc, "range").agg(F.min(F.struct("page", "pos")).alias("begin"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy("begin", "para")) - 1
    units = units.join(begins, [doc, "range"])
    units = pinned(units)
    return units.select(doc, number.cast("int").alias("unit"), "kind", "text"), _report(rows, kept, units, merged, flows, doc, policy, of)


def _report(rows: DataFrame, kept: DataFrame, units: DataFrame, merged: list[DataFrame], flows: list[DataFrame], doc: str, policy: Policy, of) -> DataFrame:
    joined = lambda cells: F.array_join(F.transform(F.array_sort(F.collect_list(cells)), lambda c: c["t"]), "\n")
    skipped = of(lambda t: t[0] == "skip") or [-1]
    base = rows.groupBy(doc).agg(F.count("*").alias("lines_in"))
    before = kept.groupBy(doc).agg(joined(F.struct("page", "pos", F.col("text").alias("t"))).alias("before"), F.count_if(~F.col("range").isin(skipped)).alias("lines_out"))
    dropped = rows.where("furniture is not null").groupBy(doc, "furniture").agg(F.count("*").alias("n"))
    dropped = dropped.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("furniture", "n")))).alias("furniture_dropped"))
    hits = [F.coalesce(F.sum(F.col("hits")[k]), F.lit(0)).alias(f"h{k}") for k in range(len(policy.normalise))]
    flowing = of(lambda t: t[0] == "body" and t[1] != "verse") or [-1]
    after = units.groupBy(doc).agg(
        joined(F.struct("begin", "para", F.col("text").alias("t"))).alias("after"), F.count("*").alias("paragraphs"), F.count_if(F.col("range").isin(flowing)).alias("flowed"), *hits
    )
    # each line that comes to a flowing range and begins no paragraph there has been joined
    flows = flows or [kept.select("chunk").limit(0)]
    flow_lines = reduce(DataFrame.unionByName, flows).groupBy(F.col("chunk.d").alias(doc)).agg(F.count("*").alias("flow_lines"))
    hyphens = reduce(DataFrame.unionByName, merged).groupBy(F.col("chunk.d").alias(doc)).agg(F.sum("hyphens").alias("hyphens")) if merged else None
    out = base.join(before, doc, "left").join(dropped, doc, "left").join(after, doc, "left").join(flow_lines, doc, "left")
    out = out.join(hyphens, doc, "left") if hyphens is not None else out.withColumn("hyphens", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    normal = text("before")
    for old, new in policy.normalise:
        normal = F.replace(normal, F.lit(old), F.lit(new))
    ratio, held = fidelity.char_ratio(text("before"), text("after")), fidelity.containment(normal, text("after"))
    out = out.withColumn("ratio", ratio).withColumn("held", held)
    joins_made = zero("flow_lines") - zero("flowed")
    return out.select(
        doc, "lines_in", zero("lines_out").alias("lines_out"), F.coalesce("furniture_dropped", F.expr("cast(map() as map<string,bigint>)")).alias("furniture_dropped"), joins_made.alias("joins_made"), zero("hyphens").alias("hyphens_resolved"),
        F.array(*[zero(f"h{k}") for k in range(len(policy.normalise))]).cast("array<bigint>").alias("normalisations"), zero("paragraphs").alias("paragraphs"),
        F.bround("ratio", 4).alias("char_ratio"), F.bround("held", 4).alias("ngram_containment"), fidelity.gate(F.col("ratio"), F.col("held")).alias("gate_pass"),
    )


def markdown(units: DataFrame, doc: str) -> DataFrame:
    """(doc, text): units joined by blank lines, verse in fences, a line feed at the end."""
    cell = F.when(F.col("kind") == "verse", F.concat(F.lit("```verse\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    cells = F.array_sort(F.collect_list(F.struct("unit", cell.alias("t"))))
    return units.groupBy(doc).agg(F.concat(F.array_join(F.transform(cells, lambda c: c["t"]), "\n\n"), F.lit("\n")).alias("text"))


def effective(restored: DataFrame, corrected: DataFrame, doc: str) -> DataFrame:
    """(doc, text): the corrected text where there is one, else the restored."""
    return restored.join(corrected.select(doc, F.col("text").alias("__better")), doc, "left").select(doc, F.coalesce("__better", "text").alias("text"))


def summary(report: DataFrame, doc: str) -> DataFrame:
    """(doc, line): a report in words."""
    line = F.format_string(
        "lines %d -> %d, %d paragraphs, %d hyphens resolved; fidelity gate: %s (char_ratio=%s, ngram_containment=%s)", "lines_in", "lines_out", "paragraphs", "hyphens_resolved",
        F.when(F.col("gate_pass"), "PASS").otherwise("FAIL"), F.col("char_ratio").cast("string"), F.col("ngram_containment").cast("string"),
    )
    return report.select(doc, line.alias("line"))


def extraction_totals(pages: DataFrame, doc: str) -> DataFrame:
    """Per document pages_processed, total_lines, total_chars, per_page_chars (a map), dedupe_pages (sorted)."""
    chars = F.aggregate("lines", F.lit(0), lambda a, l: a + F.length(T.no_space(l["text"])))
    rows = pages.select(doc, "page", F.size("lines").alias("n"), chars.alias("chars"), "dedupe_applied")
    return rows.groupBy(doc).agg(
        F.count("*").alias("pages_processed"), F.sum("n").alias("total_lines"), F.sum("chars").alias("total_chars"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "chars")))).alias("per_page_chars"), F.array_sort(F.collect_list(F.when(F.col("dedupe_applied"), F.col("page")))).alias("dedupe_pages"),
    )
