"""Stages from the command line, over Parquet folders: python -m lectern STAGE ... Exit codes: 0 passed, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.cache import release


def _triage(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, bool]:
    from lectern.operators import profile

    pages = profile.page_profile(spark.read.parquet(a.input), a.key, a.text, (a.book,))
    return profile.route(pages, a.book), True


def _restore(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, bool]:
    from lectern.operators import restore

    policy = restore.policy_of(json.loads(Path(a.policy).read_text(encoding="utf-8")))
    units, report = restore.restore(spark.read.parquet(a.input), a.book, policy)
    report.write.mode("overwrite").json(f"{a.output}-report")
    return units, report.where(~F.col("gate_pass")).isEmpty()


def _verify(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, bool]:
    from lectern.operators import render

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(a.input).select("path", "content")
    errors = render.archive_errors(render.archive_entries(files, "path", "content"), "path")
    return errors, errors.isEmpty()


def _build(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, bool]:
    """Archives of all book folders below the input, or what is missing in them."""
    from lectern.operators import render
    from lectern.sources import readers

    tables = readers.book_folders(spark, a.input)
    if not tables["errors"].isEmpty():
        return tables["errors"], False
    return render.assemble(tables), True


def _grade(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, bool]:
    """Tiers of the tokens (Parquet: a key and ``token``) by a word list and a list of idioms."""
    from lectern.operators import grading
    from lectern.sources import readers

    words = readers.lexicon(spark, a.lexicon, "graded").select("word")
    idioms = readers.lexicon(spark, a.idioms, "idiom").select("word")
    return grading.classify(spark.read.parquet(a.input), words, idioms), True


def _syllabus(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, bool]:
    """The word list of a syllabus folder's bands with readings and glosses of a dictionary."""
    from lectern.operators import grading
    from lectern.sources import readers

    words = readers.word_lists(spark, a.input).drop("pos")
    entries = grading.best_definitions(readers.dictionary(spark, a.dictionary), "pos")
    bands = tuple(a.bands.split(","))
    return grading.syllabus(words, entries, bands, bands[-1]), True


def _query(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, bool]:
    from lectern.plans import registry

    return registry.QUERIES[a.name](spark, a.input), True


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    stages = parser.add_subparsers(dest="stage", required=True)
    for name, more in (("triage", ("--key", "--text", "--book")), ("restore", ("--policy", "--book")), ("verify", ()), ("build", ()), ("grade", ("--lexicon", "--idioms")), ("syllabus", ("--dictionary", "--bands")), ("query", ("--name",))):
        stage = stages.add_parser(name)
        stage.add_argument("input")
        stage.add_argument("output")
        for flag in more:
            stage.add_argument(flag, required=True)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"lectern-{a.stage}").getOrCreate()
    work = {"triage": _triage, "restore": _restore, "verify": _verify, "build": _build, "grade": _grade, "syllabus": _syllabus, "query": _query}
    rows, passed = work[a.stage](spark, a)
    rows.write.mode("overwrite").parquet(a.output)
    release(spark)
    return 0 if passed else 1


if __name__ == "__main__":
    sys.exit(main())
