"""Removal of byte strings of fixed length that an earlier document holds, by suffix sorting.

Suffixes that can begin with a common string must meet in one task. Each string (window)
of ``size`` bytes is assigned to the least 16-byte gram in it, by hash: equal windows have
equal grams at equal offsets. Consecutive windows with one gram form a run, stored once as
its context. Contexts are sent to the task of their gram and sorted there:

* Windows are suffixes of the joined contexts. They are sorted by gram and offset, then by
  a bottom-up mergesort whose comparisons find the common extension of two suffixes by
  binary search over prefix polynomial hashes: log2(size) look-ups a comparison, and all
  comparisons of a merge step run as one array operation.
* Neighbours that agree over ``size`` bytes are verified byte by byte; a class in which a
  hash lied is sorted by its bytes instead. Each group of equal windows gets the smallest
  document id, and documents with larger ids lose the window's bytes.

A gram that occurs once in the corpus can't begin a match, so grams are first counted by
task. All messages are arrays for a batch of documents and a bucket of grams, and only
buckets that a batch has grams for get one. Inside a batch equal grams and equal contexts
are sent once, so a passage that a third of all documents hold reaches its task once for
each batch. Where a passage ends, each document's context is its own; such windows differ
in their first or last bytes, by which they are told apart before anything is sorted, so a
common gram costs time in proportion to its contexts. Batches and buckets have bounded
bytes; the number of buckets follows the size of the corpus.

A gram of over HEAVY_RUNS runs is heavy: its contexts would be one task's. Its windows are
dealt one by one instead, by a hash of all their bytes. The hashes are counted first, as
the grams were, so that the windows at a passage's ends, which nothing shares, aren't sent
at all, and those inside it, which are equal everywhere, come once for each batch and meet
in as many tasks as they have hashes. Which grams are heavy depends on the corpus only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import BATCHES, buckets_of, gather, materialise, occupied, open_batch, pack_bytes, unpack_bytes

GRAM = 16
#: Null ids count as this in comparisons, and are given back as null.
LAST = (1 << 63) - 1
BATCH_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
#: Runs of a gram beyond which its windows are dealt by their own hashes.
HEAVY_RUNS = 4096
#: Windows sorted together, up to the end of the gram they end in (bounds a task's memory).
SORT_WINDOWS = 250_000
_BLOCK = 1 << 17
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)))
_BASE = 0x2545F4914F6CDD1D
_POWER = {s: _U(pow(_BASE, s, 1 << 64)) for s in (1, 2, 4, 8)}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of the 16 bytes from each place on, built by doubling."""
    h, reach = _BYTE[data], 1
    while reach < GRAM:
        h = h[:-reach] * _POWER[reach] + h[reach:]
        reach *= 2
    return _mix(h)


def runs(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows in joined documents that end at ``ends``: first window, windows, place and hash of the gram.

    Windows that cross a document's end don't count.
    """
    firsts, counts, places, hashes = [], [], [], []
    reach = size - GRAM + 1
    begins = np.concatenate([[0], ends[:-1]])
    for at in range(0, max(0, len(data) - size + 1), _BLOCK):
        part = data[at : at + _BLOCK + size - 1]
        h = gram_hashes(part)
        low = (h >> _U(20) << _U(20)) | np.arange(len(h), dtype=np.uint64)
        n = len(part) - size + 1
        span = 1
        while span * 2 <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[reach - span : reach - span + n]) if span < reach else low[:n]
        place = (low & _U(0xFFFFF)).astype(np.int64)
        start = np.arange(at, at + n)
        doc = np.searchsorted(ends, start, side="right")
        ok = np.flatnonzero(start + size <= ends[np.minimum(doc, len(ends) - 1)])
        if not len(ok):
            continue
        p = place[ok]
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)]))
        firsts.append(start[ok[new]])
        counts.append(np.diff(np.append(new, len(ok))))
        places.append(p[new] + at)
        hashes.append(_mix(h[p[new]] * _U(_BASE)))  # chosen for being small, so mixed anew for the buckets
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    first, count, place, h = (np.concatenate(x) for x in (firsts, counts, places, hashes))
    joined = np.flatnonzero((place[1:] == place[:-1]) & (first[1:] == first[:-1] + count[:-1]))  # a run cut by a block's end
    for j in joined[::-1]:
        count[j] += count[j + 1]
    keep = np.ones(len(first), bool)
    keep[joined + 1] = False
    del begins
    return first[keep], count[keep], place[keep], h[keep]


def _distinct_grams(h: np.ndarray, doc: np.ndarray):
    """Sorted distinct grams of a batch, the index of each run's, and whether several of its documents hold each."""
    grams, index = np.unique(h, return_inverse=True)
    least, most = np.full(len(grams), LAST), np.full(len(grams), -1)
    np.minimum.at(least, index, doc)
    np.maximum.at(most, index, doc)
    return grams, index, least < most


def _rows(out: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)


_SENT = "bucket long, batch long, grams binary, several binary, times binary"
_SENT_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _sent(batch: int, h: np.ndarray, doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A batch's distinct hashes, whether several of its documents have each, and how often it has each, by bucket."""
    hashes, index, several = _distinct_grams(h, doc)
    times = np.minimum(np.bincount(index, minlength=len(hashes)), 65535).astype(np.uint16)
    out = [(b, batch, hashes[x:y].tobytes(), several[x:y].tobytes(), times[x:y].tobytes()) for b, x, y in occupied(buckets_of(hashes, buckets))]
    return _rows(out, _SENT_KINDS, ["bucket", "batch", "grams", "several", "times"])


def _send_grams(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                _, data, ends = open_batch(rows.column(1)[k].as_py(), rows.column(2)[k].as_py())
                first, _, _, h = runs(data, ends, size)
                yield _sent(rows.column(0)[k].as_py(), h, np.searchsorted(ends, first, side="right"), buckets)

    return run


def _shared_grams(most: int):
    def run(table: pa.Table) -> pa.Table:
        """For one bucket: which of each batch's grams occur in other documents too, and which of these are heavy; no row for a batch that has none."""
        batch, bucket = table.column("batch").to_pylist(), table.column("bucket")[0].as_py()
        parts = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        several = np.concatenate([np.frombuffer(s, bool) for s in table.column("several").to_pylist()])
        runs_ = np.concatenate([np.frombuffer(t, np.uint16) for t in table.column("times").to_pylist()])
        _, index, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        inside = np.zeros(len(times), bool)
        inside[index[several]] = True
        cut = np.cumsum([len(p) for p in parts])[:-1]
        flags = np.split((inside | (times > 1))[index], cut)
        heavy = np.split((np.bincount(index, weights=runs_) > most)[index], cut)
        some = [(b, bucket, np.packbits(f).tobytes(), np.packbits(f & y).tobytes() if (f & y).any() else None) for b, f, y in zip(batch, flags, heavy, strict=True) if f.any()]
        return pa.Table.from_batches([_rows(some, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["batch", "bucket", "bits", "heavy"])])

    return run


def _told(hashes: np.ndarray, buckets: int, replies: list[dict], what: str) -> np.ndarray:
    """Of a batch's distinct hashes, those for which the replies have a bit."""
    spans = {b: (x, y) for b, x, y in occupied(buckets_of(hashes, buckets))}
    out = np.zeros(len(hashes), bool)
    for r in replies:
        if r[what]:
            x, y = spans[r["bucket"]]
            out[x:y] = np.unpackbits(np.frombuffer(r[what], np.uint8))[: y - x]
    return out


def window_hashes(grams: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window's bytes, from the hashes of grams that cover it."""
    h = np.zeros(len(start), np.uint64)
    for k, off in enumerate([*range(0, size - GRAM, GRAM), size - GRAM]):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + grams[start + off] + _U(k))
    return h


def _heavy_windows(data: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the given runs one by one: starts, their gram's places, hashes of their bytes."""
    total = int(count.sum())
    start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
    return start, np.repeat(place, count), window_hashes(gram_hashes(data), start, size) if total else np.zeros(0, np.uint64)


def _send_windows(size: int, buckets: int):
    """Hashes of the windows of heavy grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                batch, sizes, texts, replies = [rows.column(i)[k].as_py() for i in range(4)]
                _, data, ends = open_batch(sizes, texts)
                first, count, place, h = runs(data, ends, size)
                grams, index = np.unique(h, return_inverse=True)
                pick = np.flatnonzero(_told(grams, buckets, replies, "heavy")[index])
                start, _, own = _heavy_windows(data, first[pick], count[pick], place[pick], size)
                yield _sent(batch, own, np.searchsorted(ends, start, side="right"), buckets)

    return run


def _contexts(raw: bytes, data: np.ndarray, ends: np.ndarray, size: int, buckets: int, replies: list[dict], windows: list[dict]):
    """Runs whose gram is shared, and the batch's distinct contexts in order of first mention, by bucket.

    Gives runs as (first, count, context number) and contexts as (bucket, bytes, gram offset, windows, run of first mention).
    Of a heavy gram's runs each shared window is a run of its own, in the bucket of its hash.
    """
    first, count, place, h = runs(data, ends, size)
    grams, index = np.unique(h, return_inverse=True)
    shared, heavy = (_told(grams, buckets, replies, what)[index] for what in ("bits", "heavy"))
    if heavy.any():
        start, at, own = _heavy_windows(data, first[heavy], count[heavy], place[heavy], size)
        hashes, which = np.unique(own, return_inverse=True)
        some = _told(hashes, buckets, windows, "bits")[which]
        light = shared & ~heavy
        first, place, h = (np.concatenate([x[light], y[some]]) for x, y in ((first, start), (place, at), (h, own)))
        count = np.concatenate([count[light], np.ones(int(some.sum()), count.dtype)])
    else:
        first, count, place, h = first[shared], count[shared], place[shared], h[shared]
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(raw[f : f + c + size - 1], len(number)) for f, c in zip(first.tolist(), count.tolist(), strict=True)), np.int64, len(first))
    _, mention = np.unique(of, return_index=True)
    return (first, count, of), list(number), buckets_of(h, buckets)[mention], (place - first)[mention], count[mention]


def _send_contexts(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                batch, doc_ids, sizes, texts, replies, windows_ = [rows.column(i)[k].as_py() for i in range(6)]
                raw, data, ends = open_batch(sizes, texts)
                (first, _, of), contexts, bucket, offset, windows = _contexts(raw, data, ends, size, buckets, replies or [], windows_ or [])
                docs = np.full(len(contexts), LAST)
                np.minimum.at(docs, of, _known(doc_ids)[np.searchsorted(ends, first, side="right")])
                out = []
                order = np.argsort(bucket, kind="stable")
                for b, x, y in occupied(bucket[order]):
                    mine = order[x:y]
                    joined = b"".join([contexts[i] for i in mine.tolist()])
                    out.append((b, batch, offset[mine].astype(np.uint8).tobytes(), windows[mine].astype(np.uint8).tobytes(), pack_bytes(docs[mine].tobytes()), pack_bytes(joined)))
                yield _rows(out, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "batch", "offsets", "windows", "docs", "contexts"])

    return run


def _known(doc_ids: list[int | None]) -> np.ndarray:
    """Ids to compare; none counts as the largest."""
    return np.array([LAST if i is None else i for i in doc_ids], np.int64)


class SuffixOrder:
    """Prefix polynomial hashes of a text and the common extensions they tell."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.power = np.cumprod(np.concatenate([[1], np.full(len(data), _BASE)]).astype(np.uint64), dtype=np.uint64)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self.power[:-1], dtype=np.uint64)])

    def extension(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b, ``size`` at most (both are that long)."""
        pa_, pb = self.power[a], self.power[b]
        sa, sb = self.prefix[a], self.prefix[b]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), size)  # the first `low` bytes agree
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.prefix[a + mid] - sa) * pb == (self.prefix[b + mid] - sb) * pa_
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the suffix at a comes before that at b, by their first ``size`` bytes."""
        n = self.extension(a, b, size)
        inner = np.minimum(n, size - 1)
        return (n < size) & (self.data[a + inner] < self.data[b + inner])

    def sort(self, place: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
        """Order of the suffixes at ``place`` within each of the groups, which are contiguous: bottom-up mergesort."""
        n = len(place)
        order = np.arange(n)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        end = np.append(begin[1:], n)
        row = np.repeat(np.arange(len(begin)), end - begin)
        inside = np.arange(n) - begin[row]
        width, most = 1, int((end - begin).max()) if n else 0
        while width < most:
            # each element finds its rank in the sibling run: those before it there, equal ones first if the sibling is left
            side = inside // width % 2
            own = begin[row] + inside // (2 * width) * 2 * width
            other_lo = np.where(side == 0, np.minimum(own + width, end[row]), own)
            other_hi = np.where(side == 0, np.minimum(own + 2 * width, end[row]), np.minimum(own + width, end[row]))
            at = place[order]
            lo, hi = other_lo.copy(), other_hi.copy()
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                mine, theirs = at[open_], at[mid]
                left = side[open_] == 0
                # a left element goes before equals, a right one after them
                goes_on = np.where(left, self.less(theirs, mine, size), ~self.less(mine, theirs, size))
                lo[open_] = np.where(goes_on, mid + 1, lo[open_])
                hi[open_] = np.where(goes_on, hi[open_], mid)
            target = own + (inside - (own - begin[row]) - side * width) + (lo - other_lo)
            new = np.empty(n, np.int64)
            new[target] = order
            order = new
            width *= 2
        return order


def least_documents(data: np.ndarray, place: np.ndarray, group: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """For each suffix the smallest doc among those of its group that begin with the same ``size`` bytes."""
    if not len(place):
        return doc.copy()
    first = np.argsort(group, kind="stable")
    place, group, doc = place[first], group[first], doc[first]
    suffixes = SuffixOrder(data)
    order = suffixes.sort(place, group, size)
    p, g = place[order], group[order]
    near = np.flatnonzero(g[1:] == g[:-1])
    same = np.zeros(len(p), bool)
    agree = suffixes.extension(p[near], p[near + 1], size) >= size
    near = near[agree]
    span = np.arange(size)
    lied: set[int] = set()
    for at in range(0, len(near), 100_000):  # verification
        some = near[at : at + 100_000]
        equal = (data[p[some][:, None] + span] == data[p[some + 1][:, None] + span]).all(1)
        same[some[equal] + 1] = True
        lied |= set(g[some[~equal]].tolist())
    head = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(doc[order], head), np.diff(np.append(head, len(p))))
    out = np.empty(len(p), np.int64)
    out[order] = least
    for bad in lied:  # by the bytes themselves
        best: dict[bytes, int] = {}
        members = np.flatnonzero(group == bad)
        for m in members:
            w = data[place[m] : place[m] + size].tobytes()
            best[w] = min(best.get(w, LAST), int(doc[m]))
        for m in members:
            out[m] = best[data[place[m] : place[m] + size].tobytes()]
    back = np.empty(len(out), np.int64)
    back[first] = out
    return back


def _worth_sorting(data: np.ndarray, place: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that share their group and their first and last 8 bytes with others, in order of these finer groups, and their groups."""
    ends = np.lib.stride_tricks.sliding_window_view(data, 8)
    cells = np.empty((len(place), 3), np.uint64)
    cells[:, 0] = group
    cells[:, 1] = np.ascontiguousarray(ends[place]).view(np.uint64)[:, 0]
    cells[:, 2] = np.ascontiguousarray(ends[place + size - 8]).view(np.uint64)[:, 0]
    order = np.lexsort((cells[:, 2], cells[:, 1], cells[:, 0]))
    cells = cells[order]
    new = np.concatenate([[True], (cells[1:] != cells[:-1]).any(1)])
    finer = np.cumsum(new) - 1
    some = np.bincount(finer)[finer] > 1
    return order[some], finer[some]


def _portions(group: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about SORT_WINDOWS windows that hold whole groups; ``group`` is in order."""
    out, at = [], 0
    while at < len(group):
        stop = int(np.searchsorted(group, group[min(at + SORT_WINDOWS, len(group)) - 1], side="right"))
        out.append((at, stop))
        at = stop
    return out


def _least_documents(size: int):
    def run(table: pa.Table) -> pa.Table:
        """For one bucket: the smallest document of every window of every batch's contexts."""
        cells = {c: table.column(c).to_pylist() for c in ("batch", "offsets", "windows", "docs", "contexts")}
        number: dict[bytes, int] = {}
        offsets, windows, least, uses = [], [], [], []
        for o, w, d, c in zip(cells["offsets"], cells["windows"], cells["docs"], cells["contexts"], strict=True):
            o, w, d, joined, use, at = np.frombuffer(o, np.uint8).tolist(), np.frombuffer(w, np.uint8).tolist(), np.frombuffer(unpack_bytes(d), np.int64).tolist(), unpack_bytes(c), [], 0
            for off, win, doc in zip(o, w, d, strict=True):
                context = joined[at : at + win + size - 1]
                at += len(context)
                n = number.setdefault(context, len(number))
                if n == len(least):
                    offsets.append(off)
                    windows.append(win)
                    least.append(doc)
                elif doc < least[n]:
                    least[n] = doc
                use.append(n)
            uses.append(np.array(use, np.int64))
        data = np.frombuffer(b"".join(number), np.uint8)
        offset, window, doc = np.array(offsets, np.int64), np.array(windows, np.int64), np.array(least, np.int64)
        begin = np.cumsum(window + size - 1) - (window + size - 1)
        gram = np.ascontiguousarray(data[(begin + offset)[:, None] + np.arange(GRAM)]).view("V16").reshape(-1)
        _, gram = np.unique(gram, return_inverse=True)
        result = np.repeat(doc, window)
        heads = np.cumsum(window) - window
        # a gram with one context has nothing to compare
        several = np.flatnonzero((np.bincount(gram) > 1)[gram]) if len(gram) else gram
        several = several[np.argsort(gram[several], kind="stable")]
        upto = np.cumsum(window[several])
        at = 0
        while at < len(several):
            stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SORT_WINDOWS))
            stop = int(np.searchsorted(gram[several], gram[several[min(stop, len(several) - 1)]], side="right"))
            mine = several[at:stop]
            w, length = window[mine], window[mine] + size - 1
            local = np.cumsum(length) - length
            part = data[np.repeat(begin[mine] - local, length) + np.arange(length.sum())]
            inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            place = np.repeat(local, w) + inside
            group = np.repeat(gram[mine] * 64 + offset[mine], w) - inside
            some, group = _worth_sorting(part, place, group, size)
            owner = np.repeat(np.arange(len(mine)), w)[some]
            for x, y in _portions(group):
                result[heads[mine[owner[x:y]]] + inside[some[x:y]]] = least_documents(part, place[some[x:y]], group[x:y], doc[mine[owner[x:y]]], size)
            at = stop
        out = []
        for use in uses:
            w = window[use]
            cell = np.repeat(heads[use] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            out.append(pack_bytes(result[cell].tobytes()))
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"batch": pa.array(cells["batch"], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64()), "least": pa.array(out, pa.binary())})

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>"


def _remove(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                _, doc_ids, sizes, texts, replies, windows_, answers = [rows.column(i)[k].as_py() for i in range(7)]
                raw, data, ends = open_batch(sizes, texts)
                (first, count, of), contexts, bucket, _, windows = _contexts(raw, data, ends, size, buckets, replies or [], windows_ or [])
                least = {a["bucket"]: np.frombuffer(unpack_bytes(a["least"]), np.int64) for a in answers or []}
                order = np.argsort(bucket, kind="stable")
                joined = np.concatenate([least[b] for b in sorted(least)]) if least else np.zeros(0, np.int64)
                head = np.empty(len(contexts), np.int64)
                head[order] = np.cumsum(windows[order]) - windows[order]
                w = count
                cell = np.repeat(head[of] - (np.cumsum(w) - w), w) + np.arange(w.sum())
                start = np.repeat(first - (np.cumsum(w) - w), w) + np.arange(w.sum())
                ids = _known(doc_ids)
                gone = start[joined[cell] < ids[np.searchsorted(ends, start, side="right")]] if len(cell) else start
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, gone, 1)
                np.add.at(change, gone + size, -1)
                removed = np.cumsum(change[:-1]) > 0
                out = []
                for doc_id, end, n in zip(doc_ids, ends.tolist(), sizes, strict=True):
                    mask = removed[end - n : end]
                    kept = data[end - n : end][~mask].tobytes() if mask.any() else raw[end - n : end]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    spans = [{"start": a, "length": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                    out.append((doc_id, n, int(mask.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


_CONTEXTS = "bucket long, batch long, offsets binary, windows binary, docs binary, contexts binary"


def _replies(sent: DataFrame, most: int, name: str) -> DataFrame:
    """(batch, name): what the buckets say about each batch's hashes."""
    shared = sent.groupBy("bucket").applyInArrow(_shared_grams(most), "batch long, bucket long, bits binary, heavy binary")
    return materialise(shared.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits", "heavy")).alias(name)), name)


def routed(table: DataFrame, size: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Batches with the replies they got, and the contexts that they send."""
    grams = table.select("batch", "sizes", "texts").mapInArrow(_send_grams(size, buckets), _SENT)
    replies = _replies(grams, HEAVY_RUNS, "replies")
    heavy = replies.where(F.exists("replies", lambda r: r["heavy"].isNotNull()))
    if heavy.isEmpty():
        replies = replies.withColumn("windows", F.lit(None).cast(replies.schema["replies"].dataType))
    else:
        sent = table.select("batch", "sizes", "texts").join(heavy, "batch").mapInArrow(_send_windows(size, buckets), _SENT)
        replies = replies.join(_replies(sent, HEAVY_RUNS, "windows"), "batch", "left")
    known = table.join(replies, "batch", "left").select("batch", "doc_ids", "sizes", "texts", "replies", "windows")
    return known, known.mapInArrow(_send_contexts(size, buckets), _CONTEXTS)


def suffix_duplicates(docs: DataFrame, size: int = 50, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if a ``size``-byte string that covers it also starts in a document with a
    smaller doc_id (17 to 120 bytes are possible). Rows that share a doc_id don't remove
    from each other; a null doc_id counts as the largest; a null text is empty; texts
    shorter than ``size`` stay whole; an empty table gives no rows; further columns are
    ignored.
    """
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`"))
    table = materialise(rows.mapInArrow(gather(batch_bytes), BATCHES), "batches")
    total = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(32, -(-total // bucket_bytes))
    known, contexts = routed(table, size, buckets)
    least = contexts.groupBy("bucket").applyInArrow(_least_documents(size), "batch long, bucket long, least binary")
    answers = materialise(least.groupBy("batch").agg(F.collect_list(F.struct("bucket", "least")).alias("answers")), "least")
    return known.join(answers, "batch", "left").mapInArrow(_remove(size, buckets), _RESULT)
