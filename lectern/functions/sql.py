"""The engine's own functions for SQL texts: a scalar, an aggregate and a table function."""

from __future__ import annotations

import difflib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from lectern.functions import fixed


class Words:
    """words(text): a row (pos, word) for each run of anything but white space."""

    _gap = re.compile(f"[{fixed.WHITE}]+")

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate(w for w in self._gap.split(text or "") if w)


def register(spark: SparkSession) -> None:
    """Make html_text(x), longest_edit(a, b) and words(x) known to the session's SQL.

    html_text resolves character references, a batch at a time; longest_edit is the longest
    changed run over a group of pairs; words is a table function for LATERAL.
    """

    @F.pandas_udf(StringType())
    def html_text(x: pd.Series) -> pd.Series:
        return x.map(html.unescape, na_action="ignore")

    @F.pandas_udf(LongType())
    def longest_edit(a: pd.Series, b: pd.Series) -> int:
        most = 0
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                most = max(most, max(i2 - i1, j2 - j1) if tag != "equal" else 0)
        return most

    spark.udf.register("html_text", html_text)
    spark.udf.register("longest_edit", longest_edit)
    spark.udtf.register("words", F.udtf(Words, returnType="pos int, word string"))
