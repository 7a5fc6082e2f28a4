"""Toxicity scores from a gap-weighted subsequence kernel and a linear support vector machine.

Kernel: phi_u(s) sums decay**span over all places where the letters u occur in s in order,
four of them or, counted LONGER times, five, spanning at most seven characters. Signs between two letters, and blanks and signs
between words of one letter, are gaps that cost nothing: they are left out before spans are
measured, so "i.d.i.o.t" and "i d i o t" have the features of the plain form. A letter put
in lengthens the spans over it, each by one decay; the training set holds such forms of its
own insults, too. Nystrom landmarks are short letter strings picked by their odds between
labelled toxic and clean documents; a sentence x becomes K_zz^(-1/2) K(z, x), on which a
squared-hinge SVM is trained. Labels belong to documents, so a toxic document counts by
its highest-scoring sentence, chosen anew in each round; a clean one by its own highest.

The decision function is linear in phi, so the landmarks fold into one weight for each code:
a table of fixed size for four letters (2**20 floats, 4 MB), and a short list for five (those
that a landmark holds), which a bitmap of 1 MB guards. They are broadcast once. Scoring is
one pass over the texts without a shuffle, in blocks of bounded memory. A sentence of more
than WINDOW symbols is scored by windows that overlap by half: each of its subsequences lies
whole in one of them, so nothing of a text is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import crc_mod, ensure_columns, give_back, slices, tidy

ORDER, SPAN, DECAY, BITS = 4, 7, 0.7, 5
PATTERNS = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]
LONG_PATTERNS = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER)]
#: Weight of five letters in the kernel.
LONGER = 3.0
_BLOCK = 1 << 16
WINDOW = 48
LEAST_EVIDENCE = 6.0


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: symbol (0 a gap, 1-26 letters, 27-30 other letters, 31 white space), sentence mark, white space."""
    symbol = np.zeros(0x110000, dtype=np.uint8)
    points = np.arange(0x110000)
    symbol[0x3000:] = 27 + points[0x3000:] % 4
    for cp in range(0x3000):
        ch = chr(cp)
        if ch.isalpha():
            base = ord(ch.lower()[0])
            symbol[cp] = base - 96 if 97 <= base <= 122 else 27 + base % 4
    mark, space = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)
    mark[[ord(c) for c in ".!?;\n"]] = True
    space[[ord(c) for c in " \t\n\r\x0b\x0c"]] = True
    symbol[space] = 31
    return symbol, mark, space


_cache: list = []


def _lookup():
    if not _cache:
        _cache.append(_tables())
    return _cache[0]


def _free_gaps(sym: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Which places between two letters cost nothing: signs, and blanks between words of one letter or none."""
    if not len(sym):
        return np.zeros(0, bool)
    white, at = sym == 31, np.arange(len(sym))
    letter = (sym > 0) & ~white
    word = np.cumsum(white)  # of the word after each white space; word 0 is empty
    single = np.bincount(word, letter, minlength=int(word[-1]) + 2) <= 1
    free = (sym == 0) | (blank & single[np.maximum(word - 1, 0)] & single[word])
    before = np.maximum.accumulate(np.where(free, -1, at))
    after = np.minimum.accumulate(np.where(free, len(sym), at)[::-1])[::-1]
    return free & (before >= 0) & (after < len(sym)) & letter[before] & letter[np.minimum(after, len(sym) - 1)]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one symbol array: symbols, sentences as rows (start, end), document number of each sentence.

    A sentence longer than WINDOW symbols becomes windows of that length that overlap by half.
    """
    symbol, mark, space = _lookup()
    joined = "".join(["\n" + (t or "") + "\n" * (SPAN - 1) for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sym = symbol[points]
    lengths = np.array([len(t or "") for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + SPAN)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    stays = ~_free_gaps(sym, points == 32)
    first = (np.cumsum(stays) - 1)[first]  # a text's first line feed always stays
    sym, points = sym[stays], points[stays]
    ends = mark[points] & np.concatenate([space[points[1:]], [True]])
    starts = np.union1d(first, np.flatnonzero(ends[:-1]) + 1)
    stops = np.append(starts[1:], len(sym))
    windows = np.maximum(1, -(-(stops - starts) // (WINDOW // 2)) - 1)
    hop = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(starts, windows) + hop * (WINDOW // 2)
    stops = np.minimum(starts + WINDOW, np.repeat(stops, windows))
    return sym, np.column_stack([starts, stops]), np.searchsorted(first, starts, side="right") - 1


def _pairs(sym: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    n = len(sym)
    padded = np.concatenate([sym, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    return padded, {g: (padded[: n + SPAN - g] << BITS) | padded[g:] for g in range(1, SPAN - 2)}


def _codes(sym: np.ndarray):
    """For each pattern of four: its span and the code at each position. A code with a gap in it weighs nothing anywhere."""
    n = len(sym)
    _, low = _pairs(sym)
    high = {g: p[:n] << 2 * BITS for g, p in low.items()}
    code = np.empty(n, dtype=np.int32)
    for _, a, b, c in PATTERNS:
        np.bitwise_or(high[a], low[c - b][b : b + n], out=code)
        yield c + 1, code


def _long_codes(sym: np.ndarray):
    """The same for patterns of five."""
    n = len(sym)
    padded, low = _pairs(sym)
    high = {g: p[:n] << 3 * BITS for g, p in low.items()}
    code, tail = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
    for _, a, b, c, d in LONG_PATTERNS:
        np.left_shift(low[c - b][b : b + n], BITS, out=tail)
        np.bitwise_or(tail, padded[d : d + n], out=tail)
        np.bitwise_or(high[a], tail, out=code)
        yield d + 1, code


class LongWeights:
    """Weights of a few codes of five: a bitmap by hash sorts out nearly all other codes, a search the rest."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.codes, self.weights = codes.astype(np.int32), weights.astype(np.float32)  # codes in order
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._hash(self.codes)] = True

    @staticmethod
    def _hash(code: np.ndarray) -> np.ndarray:
        return (code.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(12)

    def add(self, code: np.ndarray, factor: float, out: np.ndarray) -> None:
        at = np.flatnonzero(self.maybe[self._hash(code)])
        if len(at) and len(self.codes):
            place = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
            ok = self.codes[place] == code[at]
            out[at[ok]] += self.weights[place[ok]] * np.float32(factor)


NO_LONG = LongWeights(np.zeros(0, np.int32), np.zeros(0, np.float32))


def position_values(sym: np.ndarray, weights: np.ndarray, long: LongWeights = NO_LONG) -> np.ndarray:
    """At each position the weighted sum over the subsequences that start there."""
    out = np.zeros(len(sym), dtype=np.float32)
    for at in range(0, len(sym), _BLOCK):
        part = sym[at : at + _BLOCK + SPAN]
        n = min(_BLOCK, len(sym) - at)
        sums = {span: np.zeros(len(part), np.float32) for span in range(ORDER, SPAN + 1)}
        got = np.empty(len(part), np.float32)
        for span, code in _codes(part):
            np.take(weights, code, out=got, mode="clip")
            sums[span] += got
        for span, total in sums.items():
            out[at : at + n] += total[:n] * np.float32(DECAY**span)
        if len(long.codes):
            for span, code in _long_codes(part):
                long.add(code[:n], LONGER * DECAY**span, out[at : at + n])
    return out


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by code of four letters
    long: LongWeights
    per_symbol: float
    bias: float
    slope: float
    offset: float

    def sentence_scores(self, sym: np.ndarray, sentences: np.ndarray) -> np.ndarray:
        """In blocks of sentences, so that memory doesn't follow the text's length."""
        out = np.zeros(len(sentences))
        for at in range(0, len(sentences), 20_000):
            start, stop = sentences[at : at + 20_000, 0], sentences[at : at + 20_000, 1]
            base = start[0]
            running = np.concatenate([[0.0], np.cumsum(position_values(sym[base : stop.max() + SPAN], self.weights, self.long), dtype=np.float64)])
            out[at : at + len(start)] = running[stop - base] - running[start - base] + self.per_symbol * (stop - start) + self.bias
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text: from its highest-scoring sentence."""
        if not texts:
            return np.zeros(0)
        sym, sentences, doc = symbols(texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, self.sentence_scores(sym, sentences))
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def _phi_rows(sym: np.ndarray, lengths: list[int], slot: np.ndarray, long: np.ndarray, width: int) -> np.ndarray:
    """Dense phi of consecutive pieces: the codes of four that have a slot, then the codes of five in ``long``."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros(len(lengths) * width)
    for span, code in _codes(sym):
        at = slot[code]
        ok = np.flatnonzero(at >= 0)
        np.add.at(out, row[ok] * width + at[ok], DECAY**span)
    for span, code in _long_codes(sym):
        at = np.minimum(np.searchsorted(long, code), len(long) - 1)
        ok = np.flatnonzero(long[at] == code) if len(long) else []
        np.add.at(out, row[ok] * width + (width - len(long)) + at[ok], LONGER * DECAY**span)
    return out.reshape(len(lengths), width)


def _landmarks(sym: np.ndarray, ends: np.ndarray, toxic: np.ndarray, how_many: int, size: int = 5) -> list[np.ndarray]:
    """Letter strings of ``size`` symbols, by log odds times the share of toxic documents that have them.

    Documents end at ``ends``; their strings are counted in blocks of documents.
    """

    def counted(wanted: int):
        """(codes, documents that have each) for blocks of documents of one label."""
        for at in range(0, len(ends), 200):
            last = min(at + 200, len(ends))
            begin = ends[at - 1] if at else 0
            part = sym[begin : ends[last - 1]]
            if len(part) < size:
                continue
            code = np.zeros(len(part) - size + 1, dtype=np.int64)
            letters = np.zeros(len(code), dtype=np.int8)
            for k in range(size):
                code = (code << BITS) | part[k : len(code) + k]
                letters += part[k : len(code) + k] > 0
            doc = np.searchsorted(ends[at:last] - begin, np.arange(len(code)), side="right")
            mine = (letters >= ORDER) & (toxic[at:last][np.minimum(doc, last - at - 1)] == wanted)
            pairs = np.unique(code[mine] * 256 + doc[mine])
            yield np.unique(pairs >> 8, return_counts=True)

    codes, t = np.zeros(0, np.int64), np.zeros(0)
    for own, n in counted(1):
        codes, index = np.unique(np.concatenate([codes, own]), return_inverse=True)
        t = np.bincount(index, weights=np.concatenate([t, n]), minlength=len(codes))
    codes, t = codes[t >= 2], t[t >= 2]  # no landmark otherwise
    c = np.zeros(len(codes))
    for own, n in counted(0):
        place = np.searchsorted(codes, own)
        known = np.flatnonzero(codes[np.minimum(place, len(codes) - 1)] == own) if len(codes) else []
        c[place[known]] += n[known]
    n_t, n_c = toxic.sum(), len(toxic) - toxic.sum()
    odds = np.log((t + 0.5) / (n_t + 1)) - np.log((c + 0.5) / (n_c + 1))
    evidence = odds * np.sqrt(t) * (odds > 0)
    rank = np.lexsort((codes, -evidence))[:how_many]
    rank = rank[: max(16, int((evidence[rank] >= LEAST_EVIDENCE).sum()))]  # strings that a few documents share by chance only add noise
    return [np.array([(codes[r] >> BITS * (size - 1 - k)) & 31 for k in range(size)], dtype=np.uint8) for r in rank]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps over blocks of rows; the last column (the bias) is hardly penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(rounds):
        left, right = np.diag(ridge), np.zeros(len(w))
        for at in range(0, len(x), 2000):
            part, goal = x[at : at + 2000].astype(np.float64), y[at : at + 2000]
            active = goal * (part @ w) < 1
            part, goal, c = part[active], goal[active], cost[at : at + 2000][active]
            left += (part * c[:, None]).T @ part
            right += part.T @ (c * goal)
        new = np.linalg.solve(left, right)
        step = np.abs(new - w).max()
        w = new if step > 1e-9 else w
        if step < 1e-6:
            break
    return w


def _platt(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    x = np.stack([f, np.ones_like(f)], 1)
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (goal - p)) - 1e-6 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _disguised(piece: np.ndarray, weights: np.ndarray, seed: int) -> list[np.ndarray]:
    """The sentence with a letter put into its most telling word, at two places."""
    values = position_values(piece, weights)
    at = int(np.argmax(np.convolve(values, np.ones(4), "full")[3:])) + 1
    at = min(at, len(piece) - 1)
    blanks = np.flatnonzero(piece == 31)
    left = int(blanks[blanks <= at].max()) + 1 if (blanks <= at).any() else 0
    right = int(blanks[blanks > at].min()) if (blanks > at).any() else len(piece)
    word = piece[left:right]
    if len(word) < ORDER:
        return []
    places = {1 + seed % (len(word) - 1), 1 + (seed + len(word) // 2) % (len(word) - 1)}
    return [np.concatenate([piece[:left], np.insert(word, k, 1 + (seed * 7 + k) % 26), piece[right:]]) for k in sorted(places)]


def _whole(codes: np.ndarray, letters: int) -> np.ndarray:
    """The codes without a gap in them."""
    full = np.ones(len(codes), dtype=bool)
    for k in range(letters):
        full &= (codes >> k * BITS) & 31 > 0
    return codes[full]


def fit(texts: list[str], labels: list[int], share: float | None = None, landmarks: int = 320, rounds: int = 3) -> ToxicityModel:
    """Train on labelled documents. ``share``: the toxic share among all labelled rows, for calibration.

    With one class or no document at all the model gives every text that class's share.
    """
    y = np.array([int(v == 1) for v in labels], dtype=np.int64)
    share = (y.mean() if len(y) else 0.0) if share is None else share
    flat = ToxicityModel(np.zeros(1 << BITS * ORDER, np.float32), NO_LONG, 0.0, 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if len(np.unique(y)) < 2:
        return flat
    parts = [symbols(texts[at : at + 200]) for at in range(0, len(texts), 200)]
    bases = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    sym = np.concatenate([p[0] for p in parts])
    sentences = np.concatenate([p[1] + b for p, b in zip(parts, bases, strict=False)])
    sentence_doc = np.concatenate([p[2] + 200 * k for k, p in enumerate(parts)])
    del parts
    marks = _landmarks(sym, np.cumsum([len(t or "") + SPAN for t in texts]), y, landmarks)
    if not marks:
        return flat
    z = np.concatenate([np.concatenate([m, np.zeros(SPAN, np.uint8)]) for m in marks])
    z_codes = _whole(np.unique(np.concatenate([c.copy() for _, c in _codes(z)])), ORDER)
    z_long = _whole(np.unique(np.concatenate([c.copy() for _, c in _long_codes(z)])), ORDER + 1)
    slot = np.full(1 << BITS * ORDER, -1, dtype=np.int32)
    slot[z_codes] = np.arange(len(z_codes))
    width = len(z_codes) + len(z_long)
    phi_z = _phi_rows(z, [len(marks[0]) + SPAN] * len(marks), slot, z_long, width)
    phi_z /= np.maximum(np.linalg.norm(phi_z, axis=1, keepdims=True), 1e-12)
    value, vector = np.linalg.eigh(phi_z @ phi_z.T)
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])

    def folded(beta: np.ndarray) -> tuple[np.ndarray, LongWeights]:
        w, by_code = np.zeros(1 << BITS * ORDER, dtype=np.float32), phi_z.T @ beta
        w[z_codes] = by_code[: len(z_codes)]
        return w, LongWeights(z_long, by_code[len(z_codes) :])

    model = ToxicityModel(*folded(np.ones(len(marks))), 0.0, 0.0, 1.0, 0.0)
    for turn in range(rounds):
        f = model.sentence_scores(sym, sentences)
        order = np.lexsort((-f, sentence_doc))
        place = np.arange(len(order)) - np.searchsorted(sentence_doc[order], sentence_doc[order])
        toxic = y[sentence_doc[order]] == 1
        rank = np.flatnonzero((toxic & ((place < 1) | ((place < 5) & (f[order] > 0 if turn else place < 3)))) | (~toxic & ((place < 5) | (order % 37 == turn))))
        picked = order[rank]
        pieces = [sym[a:b] for a, b in sentences[picked]]
        hits = y[sentence_doc[picked]] == 1
        # of toxic documents the highest sentence, which is likeliest to hold the insult
        spread = [p for n, piece in enumerate(pieces) if hits[n] and place[rank[n]] == 0 for p in _disguised(piece, model.weights, n + turn)] if turn else []
        sign = np.concatenate([np.where(hits, 1.0, -1.0), np.ones(len(spread))])
        cost = np.concatenate([np.where(hits, 50.0, 20.0), np.full(len(spread), 15.0)])
        pieces += spread
        x = np.ones((len(pieces), root.shape[1] + 2), np.float32)
        for at in range(0, len(pieces), 200):
            some = [np.concatenate([p, np.zeros(SPAN, np.uint8)]) for p in pieces[at : at + 200]]
            phi = _phi_rows(np.concatenate(some), [len(p) for p in some], slot, z_long, width)
            x[at : at + 200, :-2] = phi @ phi_z.T @ root
            x[at : at + 200, -2] = [len(p) / 100.0 for p in some]
        w = _svm(x, sign, cost)
        model = ToxicityModel(*folded(root @ w[:-2]), float(w[-2] / 100.0), float(w[-1]), 1.0, 0.0)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, sentence_doc, model.sentence_scores(sym, sentences))
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    # disguised forms weigh half as much as plain ones, together
    hidden = x[len(sign) - len(spread) :].astype(np.float64) @ w
    goals = np.concatenate([y, np.ones(len(hidden))])
    weight = np.concatenate([weight, np.full(len(hidden), 0.5 * share * len(y) / max(1, len(hidden)))])
    model.slope, model.offset = _platt(np.concatenate([best, hidden]), goals, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_points: int = 20_000_000, hold_out: bool = True) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled texts of each class, drawn by hashed id, whole texts.

    Drawing from a class ends before the text that would pass ``most_points`` code points,
    so the driver holds a bounded sample, whatever rows repeat. With ``hold_out`` only ids
    whose crc32 modulo 4 is not 2 are used. Repeated label rows count once; ids with labels
    of both classes, rows without a label or document, and null ids not at all. Texts that
    share an id are told apart; equal rows count once.
    """
    known = ensure_columns(labels, "doc_id", "toxic").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null and toxic in (0, 1)")
    if hold_out:
        known = known.where(crc_mod("doc_id", 4) != 2)
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picks = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * per_class ids
    rows = ensure_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).join(chosen, "doc_id")
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n", F.length("text")).withColumn("of_text", F.xxhash64("text"))
    same = ["doc_id", "toxic", "n", "of_text"]
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "n", "of_text")
    drawn = rows.select(*same).distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_class)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    fitting = drawn.withColumn("upto", upto).where(F.col("upto") <= most_points).select(*same)  # at most 2 * per_class rows
    found = rows.join(F.broadcast(fitting), same).groupBy(*same).agg(F.first("text").alias("text")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"]))
    total = sum(counts.values())
    model = fit([r["text"] for r in found], [r["toxic"] for r in found], counts.get(1, 0) / total if total else 0.0)
    del found
    give_back()
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text gets the score of an empty sentence; repeated rows are scored
    alike; an empty table gives no rows; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                values = shared.value.scores(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("`text`"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, unchanged and with all columns.

    Null and empty texts are scored as an empty sentence; repeated rows go or stay alike;
    an empty table stays empty; no column's name matters but ``text``.
    """
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                values = shared.value.scores(batch.column(batch.schema.names.index("text")).to_pylist())
                yield batch.filter(pa.array(values < threshold))

    return docs.mapInArrow(tidy(run), schema)
