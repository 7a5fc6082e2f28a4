"""Helpers that every corpus operator uses: shared working tables, safe column names and Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as every operator here counts it: the space and U+0009 to U+000D.
WS_BYTES = b" \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Groups with more than one row in so many are heavy: there are at most that many of them.
HEAVY = 256

_local_dir: list[str] = []
_written: dict[str, str | None] = {}  # folders that hold working tables, and the catalog's name of each bucketed one


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that would be
    another folder on each machine, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_dir:
            _local_dir.append(tempfile.mkdtemp(prefix="lectern-"))
            atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
        base = _local_dir[0]
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path below work_dir(), which release() deletes."""
    path = f"{work_dir(spark)}/lectern_{label}_{uuid.uuid4().hex}"
    _written[path] = None
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and values
    that depend on task layout (row numbers, names) are fixed once for all readers.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """As materialise(), one row for each ``key`` and bucketed by it: later joins on it move only their other side."""
    spark = df.sparkSession
    path = scratch(spark, label)
    name = path.rpartition("/")[2]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).dropDuplicates([key]).write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    _written[path] = name
    out = spark.table(name)
    out._lectern_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    name = _written.pop(path, None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete working tables that nothing reads any more (as materialise() and bucketed() gave them)."""
    for t in tables:
        path = getattr(t, "_lectern_path", None)
        if path in _written:
            _delete(t.sparkSession, path)


def working_tables() -> set[str]:
    """Folders of the working tables there are now, for release()."""
    return set(_written)


def release(spark: SparkSession, keep: DataFrame | None = None, before: set[str] = frozenset()) -> None:
    """Delete the working tables but ``keep`` and those of ``before``. A result that reads one and hasn't been written yet is lost."""
    for path in list(_written):
        if path != getattr(keep, "_lectern_path", None) and path not in before:
            _delete(spark, path)


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ensure_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose id and text ``kept`` names, each as often as it says.

    ``kept``: doc_id (null matches null), text_key, rows (how many rows of docs have them),
    copies (how many are given); one row for each doc_id and text_key. Where these differ,
    the copies are dealt evenly to the equal rows, whose other columns may vary; only
    such rows are ordered in a window.
    """
    doc_id, key, i, k, n, c, at = spare(docs, "kept_id", "kept_key", "row_id", "row_key", "rows_", "copies_", "at_")
    kept = kept.select(F.col("doc_id").alias(i), F.col("text_key").alias(k), F.col("rows").alias(n), F.col("copies").alias(c))
    keyed = docs.withColumn(doc_id, F.col("`doc_id`").cast("long")).withColumn(key, text_key(F.col("`text`")))
    same = F.col(doc_id).eqNullSafe(F.col(i)) & (F.col(key) == F.col(k))
    columns = [F.col(f"`{x}`") for x in docs.columns]
    found = keyed.join(kept.where(F.col(c) == F.col(n)), same).select(*columns)  # each row stands for itself
    others = kept.where(F.col(c) != F.col(n))
    if others.isEmpty():
        return found
    # copies are dealt evenly to the rows of a key; the first ones get what is left over
    odd = keyed.join(others, same).withColumn(at, F.row_number().over(Window.partitionBy(i, k).orderBy(F.lit(1))))
    share = F.floor(F.col(c) / F.col(n)) + F.when(F.col(at) <= F.col(c) % F.col(n), 1).otherwise(0)
    odd = odd.withColumn(at, share.cast("int")).where(F.col(at) > 0).withColumn(at, F.explode(F.sequence(F.lit(1), F.col(at))))
    return found.unionByName(odd.select(*columns))


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner equi-join on ``keys``, unique in ``right``, where a few keys may hold most rows of ``left``.

    ``weight`` is the number of rows of ``left`` for each row of ``right``, ``total`` their
    sum. Keys of more than a 1/HEAVY of all rows are HEAVY at most, by arithmetic, and are
    broadcast; all others meet in a shuffle in which no key has more rows than that.
    """
    heavy = F.col(weight) * HEAVY > F.lit(total)
    few, many = right.where(heavy), right.where(~heavy)
    near = left.join(F.broadcast(few), keys)
    far = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys)
    return near.unionByName(far.select(*near.columns))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20):
    """Cut a batch so that no piece much exceeds ``most_bytes`` (a single longer row stands alone)."""
    rows = batch.num_rows
    if not rows:
        return
    per = max(1, int(rows * most_bytes // max(1, batch.nbytes)))
    for at in range(0, rows, per):
        yield batch.slice(at, per)


#: What a worker process has remembered and can do without after a task: see tidy().
forgotten: list[Callable[[], None]] = []


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow; after a task its worker, which later stages use again, forgets its memos and gives memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for forget in forgotten:
                forget()
            give_back()

    return tidied


def give_back() -> None:
    """Memory that this process has freed goes back to the machine, for the JVM beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null")).cast("binary")) % mod


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


BATCHES = "batch long, doc_ids array<long>, sizes array<long>, texts binary"


def gather(most: int):
    """For mapInArrow: documents (doc_id, text) of about ``most`` bytes become one row of BATCHES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        ids: list = []
        raws: list[bytes] = []
        size = 0

        def row():
            cells = [number, ids, [len(r) for r in raws], pack_bytes(b"".join(raws))]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["batch", "doc_ids", "sizes", "texts"])

        for whole in batches:
            for batch in slices(whole, most):
                for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                    if ids and size + len(raw) > most:
                        yield row()
                        number, ids, raws, size = number + 1, [], [], 0
                    ids.append(doc_id)
                    raws.append(raw)
                    size += len(raw)
        if ids:
            yield row()

    return run


def open_batch(sizes: list[int], texts: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes of a batch, the same as an array, and the place where each document ends."""
    raw = unpack_bytes(texts)
    return raw, np.frombuffer(raw, np.uint8), np.cumsum(np.array(sizes, np.int64))


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high half of each hash, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def occupied(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that have entries, and of no others."""
    if not len(sorted_buckets):
        return []
    begin = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]]))
    return list(zip(sorted_buckets[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(sorted_buckets)], strict=True))
