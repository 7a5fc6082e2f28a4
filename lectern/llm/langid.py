"""Language identification by cross-parsing entropy.

For each learned language a suffix automaton of labelled text accepts exactly the
substrings of that text. A document is parsed greedily into the longest phrases that the
automaton accepts; with c phrases over n symbols and an automaton of N symbols the cross
entropy is c * log2(N) / n, and the language with least wins. The greedy parse only needs
the automaton's forward moves: where none exists the phrase ends and the next begins at
that symbol.

Symbols are the lower-cased letters and marks of the samples, of any script and number, and
one gap for all that stands between words; a letter that no sample holds is a phrase of its
own in every language. Moves are kept as double arrays (a state's moves lie at its base plus
the symbol, and each place names the state it belongs to), so a script of thousands of letters
costs no more than one of thirty.

The parse is a chain of table look-ups. All languages and many documents advance together,
one symbol a step, as one NumPy gather. Long texts are cut into lanes that are parsed at
once, each as if a phrase began with it, and then stitched: the true parse is followed from
border to border until it begins a phrase where the lane did, from where both agree. So the
count is that of the one greedy parse of the whole text.

The automata are built from whole texts of a bounded sample of labelled rows and broadcast:
at most 2 states and 3 moves a symbol.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import crc_mod, slices, tidy

LANE = 2048
UNKNOWN, GAP = 0, 1


@cache
def _unicode() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, does it belong to a word (letters and marks), its lower-case form."""
    kinds = np.array([unicodedata.category(chr(cp))[0] for cp in range(0x110000)])
    letter, lower = kinds == "L", np.arange(0x110000)
    for cp in np.flatnonzero(letter).tolist():
        lower[cp] = ord(chr(cp).lower()[0])
    return letter, letter | (kinds == "M"), lower


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@dataclass
class CrossParser:
    languages: list[str]
    symbol: np.ndarray  # code point -> symbol
    letter: np.ndarray  # code point -> is a letter
    base: np.ndarray  # state -> where its moves lie; the states of all languages follow each other
    owner: np.ndarray  # place -> state whose move lies there
    target: np.ndarray  # place -> state the move leads to
    roots: np.ndarray
    first: np.ndarray  # language x symbol -> state after the root, -1 for none
    sizes: np.ndarray  # symbols behind each automaton

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text; gaps in a row count as one."""
        sym = self.symbol[_points(text)]
        return sym[np.concatenate([[True], (sym[1:] != GAP) | (sym[:-1] != GAP)])] if len(sym) else sym

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score for each text: 1 - least / second least cross entropy (1 with one language).

        'und' and 0 for a text without a letter, or where nothing was learned.
        """
        some = [bool(t) and bool(self.languages) and bool(self.letter[_points(t)].any()) for t in texts]
        found = iter(self.phrases([self.symbols(t) for t, ok in zip(texts, some, strict=True) if ok]))
        names, scores = [], np.zeros(len(texts))
        for n, ok in enumerate(some):
            if not ok:
                names.append("und")
                continue
            cost = next(found) * np.log2(np.maximum(self.sizes, 2))
            order = np.argsort(cost, kind="stable")
            names.append(self.languages[order[0]])
            scores[n] = 1.0 if len(order) == 1 else 1 - cost[order[0]] / max(cost[order[1]], 1e-12)
        return names, scores

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of the greedy parse of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        lanes = [(n, at) for n, t in enumerate(texts) for at in range(0, len(t), LANE)]
        if not lanes:
            return out
        lanes.sort(key=lambda x: -min(LANE, len(texts[x[0]]) - x[1]))
        long = {n for n, t in enumerate(texts) if len(t) > LANE}
        counts, starts = self._lanes([texts[n][at : at + LANE] for n, at in lanes], np.array([n in long for n, _ in lanes]))
        marked: dict[tuple[int, int], np.ndarray] = {}
        for column, lane in enumerate(lanes):
            if lane[0] not in long:
                out[lane[0]] = counts[:, column]
        for column, lane in enumerate([x for x in lanes if x[0] in long]):
            marked[lane] = starts[:, :, column]
        for n in long:
            for k in range(len(self.languages)):
                out[n, k] = self._stitched(texts[n], k, [marked[n, at][:, k] for at in range(0, len(texts[n]), LANE)])
        return out

    def _lanes(self, lanes: list[np.ndarray], marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each lane (longest first), and for the marked ones at which symbols phrases begin."""
        lengths = np.array([len(x) for x in lanes])
        width, k = int(lengths[0]), len(self.languages)
        grid = np.zeros((width, len(lanes)), dtype=np.int32)
        for column, lane in enumerate(lanes):
            grid[: len(lane), column] = lane
        active = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")
        upto = np.concatenate([[0], np.cumsum(marked)])  # marked lanes among the first ones
        root = self.roots.astype(np.int32)[:, None]
        state = np.repeat(root, len(lanes), axis=1)
        count = np.zeros((k, len(lanes)), dtype=np.int64)
        starts = np.zeros((width, k, int(upto[-1])), dtype=bool)
        for t in range(width):
            m = active[t]
            c, now = grid[t, :m], state[:, :m]
            place = self.base[now] + c
            leads = self.owner[place] == now
            begins = ~leads | (now == root)
            go = np.where(leads, self.target[place], self.first[:, c])
            lost = go < 0  # the symbol occurs nowhere: it is a phrase of its own, and the next one begins after it
            count[:, :m] += begins
            state[:, :m] = np.where(lost, root, go)
            if upto[m]:
                starts[t, :, : upto[m]] = begins[:, marked[:m]]
        return count, starts

    def _stitched(self, text: np.ndarray, k: int, starts: list[np.ndarray]) -> int:
        """Phrases of a whole text, from where phrases begin in each of its lanes."""
        base, owner, target, first = (memoryview(x) for x in (self.base, self.owner, self.target, np.ascontiguousarray(self.first[k])))
        symbols, n = memoryview(np.ascontiguousarray(text, dtype=np.int32)), len(text)
        count = at = 0
        while at < n:
            lane, inside = divmod(at, LANE)
            if starts[lane][inside]:  # from here on the lane's phrases are the text's; its last one may go on
                begins = np.flatnonzero(starts[lane][inside : n - lane * LANE])
                count += len(begins) - 1
                at += int(begins[-1])
            count += 1
            state = first[symbols[at]]
            at += 1
            while state >= 0 and at < n:
                place = base[state] + symbols[at]
                if owner[place] != state:
                    break
                state = target[place]
                at += 1
        return count


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Forward moves of the suffix automaton of ``text``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return moves


def double_array(moves: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, owner and target of ``moves``, in a table that stays half empty.

    States of many moves come first. Each tries bases in a scattered order of its own until
    the places of its moves are free; should a round of tries fail, the table grows.
    """
    order = sorted((s for s in range(len(moves)) if moves[s]), key=lambda s: -len(moves[s]))
    room = 2 * sum(map(len, moves)) + 64
    base, owner, target = [0] * len(moves), [-1] * (room + symbols), [-1] * (room + symbols)
    for s in order:
        chars, at, tries = list(moves[s]), s * 2654435761 % room, 0
        while True:
            for c in chars:
                if owner[at + c] >= 0:
                    break
            else:
                break
            at, tries = (at + 40503) % room, tries + 1
            if tries > 2000:
                at, tries = room, 0
                owner += [-1] * (room + symbols)
                target += [-1] * (room + symbols)
                room = len(owner) - symbols
        base[s] = at
        for c, to in moves[s].items():
            owner[at + c], target[at + c] = s, to
    return np.array(base, np.int32), np.array(owner, np.int32), np.array(target, np.int32)


def fit(samples: dict[str, list[str]], symbols_per_language: int = 60_000) -> CrossParser:
    """Build the automata of each language's texts: whole ones, in order, until the bound is reached or passed."""
    letter, wordish, lower = _unicode()
    languages, points = sorted(samples), {}
    for name in languages:
        taken, size = [], 0
        for text in samples[name]:
            if size < symbols_per_language:
                taken.append(text)
                size += len(text)
        points[name] = lower[_points(" ".join(taken))]
    held = np.unique(np.concatenate([*points.values(), np.zeros(0, np.int64)]))
    alphabet = held[wordish[held]]
    by_lower = np.zeros(0x110000, np.int32)
    by_lower[alphabet] = np.arange(2, 2 + len(alphabet))
    symbol = np.where(wordish, by_lower[lower], GAP).astype(np.int32)
    width = 2 + len(alphabet)
    bases, owners, targets, roots, sizes = [], [], [], [], []
    first = np.full((len(languages), width), -1, np.int32)
    states = places = 0
    parser = CrossParser(languages, symbol, letter, *[np.zeros(0, np.int32)] * 3, np.zeros(0, np.int32), first, np.zeros(0, np.int64))
    for k, name in enumerate(languages):
        sym = by_lower[points[name]]
        sym[~wordish[points[name]]] = GAP
        sym = sym[np.concatenate([[True], (sym[1:] != GAP) | (sym[:-1] != GAP)])] if len(sym) else sym
        moves = automaton(sym.tolist())
        for c, to in moves[0].items():
            first[k, c] = to + states
        base, owner, target = double_array(moves, width)
        bases.append(base + places)
        owners.append(np.where(owner >= 0, owner + states, -1))
        targets.append(np.where(target >= 0, target + states, -1))
        roots.append(states)
        sizes.append(len(sym))
        states, places = states + len(base), places + len(owner)
    none = [np.zeros(0, np.int32)]
    parser.base, parser.owner, parser.target = (np.concatenate([*x, *none]).astype(np.int32) for x in (bases, owners, targets))
    parser.roots, parser.sizes = np.array(roots, np.int32), np.array(sizes, np.int64)
    return parser


def train(docs: DataFrame, per_language: int = 150, symbols_per_language: int = 60_000, longest: int = 1_000_000, hold_out: bool = True) -> CrossParser:
    """Learn from documents of each non-null lang, drawn by hashed id: ``per_language`` at most, whole texts.

    Drawing ends with the text that reaches ``symbols_per_language`` code points; texts of
    more than ``longest`` are not drawn, so the driver holds a bounded sample. With
    ``hold_out`` only ids whose crc32 modulo 5 is not 0 are used. Texts without a letter
    and rows without an id don't count, equal rows once; texts that share an id are told apart.
    """
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`lang`").alias("lang"), F.col("`text`").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= longest))
    if hold_out:
        rows = rows.where(crc_mod("doc_id", 5) != 0)
    rows = rows.withColumn("n", F.length("text")).withColumn("of_text", F.xxhash64("text"))
    # only ids, hashes and lengths are ranked; each map task keeps its best rows before the shuffle
    same = ["doc_id", "lang", "n", "of_text"]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "n", "of_text")
    drawn = rows.select(*same).distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = drawn.withColumn("before", before).where(F.col("before") < symbols_per_language).select(*same)  # per_language rows a language at most
    found = rows.join(F.broadcast(picked), same).groupBy(*same).agg(F.first("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"] or 0, hashlib.md5(r["text"].encode()).digest())):
        samples.setdefault(r["lang"], []).append(r["text"])
    return fit(samples, symbols_per_language)


def predict(docs: DataFrame, model: CrossParser) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is 'und' with score 0, and so is every text when
    nothing could be learned; repeated rows get the same result; an empty table gives no
    rows; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4 << 20):
                names, scores = shared.value.classify(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("`text`"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
