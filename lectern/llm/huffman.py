"""Token-id files in canonical, length-limited Huffman code.

A file set is a folder with two Parquet tables, written and read by Spark:

``codebook``  id, length           the canonical code follows from the lengths
``blocks``    shard, seq, doc_ids, doc_tokens, n_tokens, checkpoints, payload

A block holds whole documents, in ascending doc_id order over (shard, seq), and is decoded
on its own: the bit offset of every 128th id is a checkpoint, so all stretches between
checkpoints are decoded together, each step one look-up of the next bits in a table.

Texts are read and tokenised once, where they lie: each task also leaves one row with its
counts of ids, so lengths follow from counts over the whole corpus without another look at
the tokens; the driver sees one count for each id of the vocabulary at most. Only ids, in
two bytes where the vocabulary allows, are put in order, by a range partitioning and never
in one task, and encoded as they arrive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.shared import discard, materialise, scratch, slices, text_bytes
from lectern.llm.tokens import tokenizer

STRIDE = 128
#: Most bits of a code; more only where there are too many ids for that.
LIMIT = 16
BLOCK_TOKENS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge); of as many as n symbols need, if that is more."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    limit = max(limit, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    merged, is_leaf, levels = leaves, np.ones(n, bool), []
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        merged, is_leaf = both[by], by < n
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        mine = int(is_leaf[:need].sum())
        lengths[:mine] += 1
        need = 2 * (need - mine)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical code of the ids in ``ids`` with ``lengths`` bits."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.limit = int(lengths.max()) if len(lengths) else 1
        by = np.lexsort((ids, lengths))
        ids, lengths = ids[by], lengths[by]
        first = np.concatenate([[0], np.cumsum(np.left_shift(1, self.limit - lengths))])[:-1] if len(ids) else np.zeros(0, np.int64)
        top = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[ids] = (first >> (self.limit - lengths)).astype(np.uint64)
        self.length[ids] = lengths
        self.table_id, self.table_length = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int32)
        spans = np.left_shift(1, self.limit - lengths)
        used = int(spans.sum())
        self.table_id[:used] = np.repeat(ids, spans)
        self.table_length[:used] = np.repeat(lengths, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every STRIDE-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        length = self.length[ids]
        start = np.cumsum(length) - length
        at = (start & 31).astype(np.uint64)
        placed = self.code[ids] << (np.uint64(64) - at - length.astype(np.uint64))
        word = start >> 5
        begin = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[begin]] += np.add.reduceat(placed >> np.uint64(32), begin)
        out[word[begin] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), begin)
        bits = int(start[-1] + length[-1])
        return out.astype(">u4").tobytes()[: -(-bits // 8)], start[::STRIDE]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All stretches between checkpoints advance together."""
        b = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
        wide = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        lanes = len(checkpoints)
        out = np.zeros((STRIDE, lanes), np.uint32)
        at = checkpoints.astype(np.int64)
        mask, shift = np.uint32((1 << self.limit) - 1), 32 - self.limit
        rest = n - (lanes - 1) * STRIDE
        for t in range(min(STRIDE, n)):
            if t == rest and lanes > 1:
                at = at[:-1]  # the last stretch has ended
            elif t >= rest and lanes == 1:
                break
            bits = (wide[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[t, : len(at)] = self.table_id[bits]
            at = at + self.table_length[bits]
        return out.T.reshape(-1)[:n]


_TOKENS = "doc_id long, n_tokens long, ids binary, counts binary"
_TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def _tokenise(path: str, end_id: int, kind: str):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = tokenizer(path).encode_all, np.zeros(0, np.int64)
        for whole in batches:
            for batch in slices(whole):
                ids, ends = encode(text_bytes(batch.column(1)), end)
                n = np.bincount(ids, minlength=len(total))
                n[: len(total)] += total
                total = n
                ids = ids.astype(kind)
                cells = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.concatenate([[0], ends]) * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends, prepend=0)), cells, pa.nulls(len(ends), pa.binary())], schema=_TOKENS_ARROW)
        used = np.flatnonzero(total)
        if len(used):
            counts = np.stack([used, total[used]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], schema=_TOKENS_ARROW)

    return run


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab().values(), default=0) < 1 << 16 else "<u4"


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """A row for each document, with its ids (end id included) in 2 or 4 bytes each, and a row of counts from each task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("`text`"))
    return materialise(rows.mapInArrow(_tokenise(tokenizer_path, end_id, _width(tokenizer_path)), _TOKENS), "tokens")


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            ids, n = np.frombuffer(raw.as_py(), "<i8").reshape(2, -1)
            if len(ids) and ids[-1] >= len(total):
                total = np.concatenate([total, np.zeros(ids[-1] + 1 - len(total), np.int64)])
            total[ids] += n
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])


_BLOCKS = "shard int, seq long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, checkpoints array<long>, payload binary"
_BLOCKS_ARROW = pa.schema(
    [("shard", pa.int32()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()),
     ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def _encode(book, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, code = TaskContext.get().partitionId(), 0, book.value
        for whole in batches:
            for batch in slices(whole):
                cells, n = batch.column(2), batch.num_rows
                offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + n + 1]
                ids = np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)
                ends = (offsets - offsets[0]) // ids.itemsize
                at = 0
                while at < n:  # whole documents up to BLOCK_TOKENS, one at least
                    stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_TOKENS, side="right")) - 1)
                    payload, marks = code.encode(ids[ends[at] : ends[stop]])
                    row = [[shard], [seq], [batch.column(0)[at:stop].to_pylist()], [np.diff(ends[at : stop + 1])], [int(ends[stop] - ends[at])], [marks], [payload]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _BLOCKS_ARROW, strict=True)], schema=_BLOCKS_ARROW)
                    at, seq = stop, seq + 1

    return run


def write(tokens: DataFrame, path: str, kind: str) -> None:
    """Write the file set of ``tokens`` (as tokenise() gives them, ids of type ``kind``) to the folder ``path``."""
    spark = tokens.sparkSession
    counts = tokens.where("counts is not null").select("counts").mapInArrow(_sum_counts, "id long, n long")
    rows = sorted(tuple(r) for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect())  # one row for each id of the vocabulary
    ids, times = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
    lengths = code_lengths(times)
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist(), strict=True)), "id long, length long").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(Codebook(ids, lengths))
    ordered = tokens.where("ids is not null").select("doc_id", "n_tokens", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_encode(book, kind), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _decode(book):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, marks = (batch.column(i)[k].values for i in (2, 5))
                ends = np.cumsum(batch.column(3)[k].values.to_numpy())
                starts = np.concatenate([[0], ends[:-1]])
                ids = book.value.decode(batch.column(6)[k].as_py(), marks.to_numpy(), int(ends[-1])).astype("<u4")
                m, view = len(doc_ids), memoryview(ids)
                crcs = [zlib.crc32(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * m, pa.int32()), pa.array([batch.column(1)[k].as_py()] * m, pa.int64()), doc_ids, pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["shard", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    return run


def codebook(spark: SparkSession, path: str) -> Codebook:
    rows = spark.read.parquet(f"{path}/codebook").orderBy("id").collect()
    return Codebook(np.array([r["id"] for r in rows], np.int64), np.array([r["length"] for r in rows], np.int64))


def read(spark: SparkSession, path: str) -> DataFrame:
    """From the files, per document: doc_id, start (ids before it), n_tokens, ids_crc32."""
    book = spark.sparkContext.broadcast(codebook(spark, path))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    heads = blocks.select("shard", "seq", "n_tokens")
    shards = heads.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("shard", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("block_start")).join(shards, "shard")
    rows = blocks.mapInArrow(_decode(book), "shard int, seq long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(heads, ["shard", "seq"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Encode all documents, write the file set and read it back.

    A null or empty text is the end id alone. Null ids come first; rows that share an id
    follow each other in no fixed order. An empty table gives empty files and no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "huffman")
    tokens = tokenise(docs, tokenizer_path, end_id)
    write(tokens, path, _width(tokenizer_path))
    discard(tokens)
    return read(spark, path)
