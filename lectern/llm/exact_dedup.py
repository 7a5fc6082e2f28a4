"""Exact de-duplication by deterministic block naming.

Each text, without white space, is cut into fixed-size blocks. Equal blocks meet in one
task, which sorts them and gives each distinct content an integer name; no digest
decides. Then adjacent names are paired and the distinct pairs are named in the same
way, level by level, until every document has one name: two documents of as many
blocks share it exactly when their texts are equal.

Skew: within an Arrow batch equal blocks are sent once, so a block that a third of all
rows hold reaches its task once per batch. Members refer to their batch's representative
by row number, a key without hot values. Pairs are pre-aggregated with ``distinct``. Groups
of more than 1/256 of all rows are given to their rows by a broadcast of 256 rows at most.

Memory: blocks are small, so that the 10,000 rows of an Arrow batch stay small too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import WS_BYTES, discard, ensure_columns, join_heavy, keep_rows, materialise, slices, text_bytes, tidy

BLOCK_BYTES = 4096

_BASE = "uid long, doc_id long, idx int, rep_uid long, rep_idx int, block binary, n_blocks int, n_points long, text_sha256 string, text_key binary"
_BASE_ARROW = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("idx", pa.int32()), ("rep_uid", pa.int64()), ("rep_idx", pa.int32()),
     ("block", pa.binary()), ("n_blocks", pa.int32()), ("n_points", pa.int64()), ("text_sha256", pa.string()), ("text_key", pa.binary())]
)


def _cut(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, 4 << 20):
                seen: dict[bytes, tuple[int, int]] = {}
                out: list[tuple] = []
                ids = batch.column(0).to_pylist()
                points = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
                for doc_id, n, raw in zip(ids, points, text_bytes(batch.column(1)), strict=True):
                    text = raw.translate(None, WS_BYTES)
                    sha = hashlib.sha256(text).hexdigest()
                    raw_key = hashlib.md5(raw).digest()
                    n_blocks = max(1, -(-len(text) // block_bytes))
                    for k in range(n_blocks):
                        block = text[k * block_bytes : (k + 1) * block_bytes]
                        rep = seen.setdefault(block, (uid, k))
                        out.append((uid, doc_id, k, *rep, block if rep == (uid, k) else None, n_blocks, n, *((sha, raw_key) if k == 0 else (None, None))))
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _BASE_ARROW, strict=True)], schema=_BASE_ARROW)

    return run


def _name_sorted(keys: int):
    """Number the distinct key tuples of sorted rows; the task's number makes names unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = (TaskContext.get().partitionId() << 40) - 1, None
        for whole in batches:
            for batch in slices(whole, 4 << 20):
                names = []
                for key in zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True):
                    if key != last:
                        name, last = name + 1, key
                    names.append(name)
                begin = keys if keys == 1 else 0  # blocks have served their turn, pairs are joined on
                yield pa.RecordBatch.from_arrays([*batch.columns[begin:], pa.array(names, pa.int64())], names=[*batch.schema.names[begin:], "name"])

    return run


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: uid, doc_id, n_points, text_sha256, text_key, n_blocks, name.

    (n_blocks, name) is the text's identity: equal exactly for equal normalised texts.
    text_key tells original texts apart. A null text counts as empty; a null doc_id is
    carried as it is.
    """
    base = materialise(
        ensure_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(_cut(block_bytes)), _BASE), "blocks"
    )
    sent = base.where("block is not null").select("block", "uid", "idx")
    names = sent.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_name_sorted(1)), "uid long, idx int, name long")
    names = names.toDF("rep_uid", "rep_idx", "name")
    named = materialise(base.select("uid", "idx", "rep_uid", "rep_idx", "n_blocks").join(names, ["rep_uid", "rep_idx"]).select("uid", "idx", "n_blocks", "name"), "names")
    done = named.where("n_blocks = 1").select("uid", "name")
    level, old = named.where("n_blocks > 1").select("uid", "idx", "name"), None
    width = level.agg(F.max("idx")).first()[0]
    while width:
        pairs = level.groupBy("uid", F.expr("idx div 2").cast("int").alias("idx")).agg(
            F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("l"), F.coalesce(F.max(F.expr("if(idx % 2 = 1, name, null)")), F.lit(-1)).alias("r")
        )
        pair_names = pairs.select("l", "r").distinct().sortWithinPartitions("l", "r").mapInArrow(_name_sorted(2), "l long, r long, name long")
        level = materialise(pairs.join(pair_names, ["l", "r"]).select("uid", "idx", "name"), "pairs")
        discard(old)
        old, width = level, width // 2
    done = done.unionByName(level.select("uid", "name")) if width == 0 else done
    heads = base.where("idx = 0").select("uid", "doc_id", "n_points", "text_sha256", "text_key", "n_blocks")
    out = materialise(heads.join(done, "uid"), "identities")
    discard(base, named, old)
    return out


def _judged(docs: DataFrame, block_bytes: int) -> DataFrame:
    rows = identities(docs, block_bytes)
    best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "text_key", "uid"))
    groups = rows.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size"))
    return join_heavy(rows, materialise(groups, "groups"), ["n_blocks", "name"], "group_size", rows.count())


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; null is empty. Of a group
    the row with most code points in the original stays, then the smallest doc_id (null
    last), then the first row read: of repeated rows exactly one is kept. An empty table
    gives no rows; further columns are ignored.
    """
    return _judged(docs, block_bytes).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of ``docs`` for each distinct text, with all columns: that which exact_duplicates() keeps.

    All null and blank texts are one group, of which one row stays. Null ids count as
    equal to each other only; rows that repeat id and text become one, whichever of them;
    an empty table stays empty; working columns avoid the names of the table's own.
    """
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    kept = _judged(docs, block_bytes).where(same).groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    return keep_rows(docs, materialise(kept.withColumn("copies", F.lit(1).cast("long")), "kept"))
