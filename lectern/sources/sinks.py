"""Writers: glossaries, reports, and a staged overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_glossary(rows: DataFrame, path: str) -> None:
    """A headed, tab-separated file in ``pos`` order (a glossary is a page, so one file)."""
    rows.orderBy("pos").select("word", "reading", "gloss").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\x00").csv(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object a row, without columns whose name begins with '_'."""
    public = [c for c in reports.columns if not c.startswith("_")]
    reports.select(F.to_json(F.struct(*public)).alias("value")).write.mode("overwrite").text(path)


def staged_overwrite(df: DataFrame, path: str) -> None:
    """Replace a table that ``df`` itself reads: write beside it, move the old one aside, move the new one in.

    A failed move puts the old table back. For a moment between the two moves nothing lies at ``path``: where others
    read meanwhile, use snapshots.SnapshotStore.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, stage, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{end}") for end in ("", ".staged", ".old"))
    df.write.mode("overwrite").parquet(stage.toString())
    fs = final.getFileSystem(conf)
    fs.delete(old, True)
    had = fs.exists(final)
    if had and not fs.rename(final, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(stage, final):
        if had:
            fs.rename(old, final)
        raise OSError(f"could not move the new table to {path}")
    fs.delete(old, True)
