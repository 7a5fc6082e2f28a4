"""Packing by sum-of-squares placement into fixed-length sequences.

A document's full sequences stand alone. Its rest of r tokens goes to the fill level h
for which the sum over levels of (open sequences at that level) squared grows least; a
level array counts the open sequences. Moving a sequence from h to h + r changes the sum
by 2 (count[h + r] - count[h]) + 2; a new sequence and one that gets full change one
term only, as level 0 and the full level count none.

Each task packs the rows of its own partition with its own level array, so nothing is
shuffled and memory holds only the open sequences. When a task ends, what is still open
is cut and joined into full sequences; the last rest becomes sequences of power-of-two
lengths, which need no padding. Padding is thus 0 whatever the layout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import ensure_columns, slices, text_bytes, tidy
from lectern.llm.tokens import tokenizer

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_ARROW = pa.schema([(n, pa.int64()) for n in _NAMES])


class SumOfSquares:
    """Online packer. Pieces are (doc_id, start, ids, doc_tokens); ids as u32 bytes."""

    def __init__(self, capacity: int, first_sequence: int = 0):
        self.capacity, self._sequence = capacity, first_sequence
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self._open: dict[int, list[list[tuple]]] = {}
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            self.done.append((doc_id, start, length, zlib.crc32(ids), total, self._sequence, offset))
            offset += length
        self._sequence += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity
        whole = total - total % step
        for start in range(0, whole, step):
            self._close([(doc_id, start, ids[start * 4 : (start + step) * 4], total)])
        rest = total - whole
        if not rest:
            return
        count = self.levels
        gain = 2 * (count[rest:] - count[: step + 1 - rest]) + 2  # how the sum of squares changes
        # a level without an open sequence can't take it; a new sequence (level 0) always can
        gain = np.where(count[: step + 1 - rest] > 0, gain, np.iinfo(np.int64).max)
        gain[0] = 2 * count[rest] + 1
        if count[step - rest]:
            gain[step - rest] = 1 - 2 * count[step - rest]  # it is filled and counts no more
        level = int(np.argmin(gain))
        piece = (doc_id, whole, ids[whole * 4 :], total)
        pieces = [piece]
        if level:
            pieces = self._open[level].pop()
            pieces.append(piece)
            count[level] -= 1
        if level + rest == step:
            self._close(pieces)
        else:
            count[level + rest] += 1
            self._open.setdefault(level + rest, []).append(pieces)

    def finish(self) -> None:
        """Cut and join the open sequences; the last rest is split at powers of two."""
        queue = [p for level in sorted(self._open, reverse=True) for pieces in self._open[level] for p in pieces]
        left = sum(len(p[2]) // 4 for p in queue)
        self._open, self.levels = {}, np.zeros_like(self.levels)
        want, room, now = 0, 0, []
        for doc_id, start, ids, total in queue:
            while ids:
                if not room:
                    want = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    room, now = want, []
                part = ids[: room * 4]
                now.append((doc_id, start, part, total))
                ids, start = ids[len(part) :], start + len(part) // 4
                room -= len(part) // 4
                left -= len(part) // 4
                if not room:
                    self._close(now)


def _pack(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_all
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() << 40)

        def flush():
            rows, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)

        for whole in batches:
            for batch in slices(whole):
                ids, ends = encode(text_bytes(batch.column(1)), end)
                raw, at = ids.tobytes(), 0
                for doc_id, stop in zip(batch.column(0).to_pylist(), (4 * ends).tolist(), strict=True):
                    packer.add(doc_id, raw[at:stop])
                    at = stop
                if packer.done:
                    yield flush()
        packer.finish()
        if packer.done:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of a document in a sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or
    empty text is the end id alone. Repeated rows are packed each time they occur; a null
    doc_id is carried as it is; an empty table gives no rows; further columns are ignored.
    sequence_id is unique: the number of the task in its high bits, a counter in the low 40.
    """
    rows = ensure_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(tidy(_pack(tokenizer_path, capacity, end_id)), _OUT)
