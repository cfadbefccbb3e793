"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input joins a learned vector for the word (by hash), the mean of learned vectors for its character trigrams
(by hash), and the smoothed log-odds of the word and of its trigrams between toxic and other training documents. A text
is scored in all its windows of WINDOW words (a word of over PIECE characters counts as its overlapping pieces), STRIDE apart, so that they overlap. Each window runs through the network
in both directions; attention weighs its states; the text's score is that of its highest window.

Training: labels are those of documents; the loss of a document is that of its highest window. Rows may be a bounded
sample (max_docs, taken by a hash of the id and in equal parts from either label as far as they go), which one task
holds; scoring covers all documents. The seed is fixed, so reruns agree.

Defined results: null and empty texts have one window without words, whose score is the network's for no word.
Rows with a null label or id teach nothing; of rows that repeat an id the smallest text teaches. Without rows of both labels every score is 0. Repeated rows are scored each.
An empty table gives none.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textscan

WINDOW, STRIDE = 24, 8
#: Training documents at most, half of them toxic if there are as many; rounds over them; documents for each step; seed.
MAX_DOCS, EPOCHS, BATCH, SEED = 3000, 4, 32, 7
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 12
#: Words whose inputs a worker remembers; windows that run through the network together.
MEMORY, RUN = 100_000, 4096
#: Longer words (text without spaces) are cut into pieces of so many characters.
PIECE = 64
_EDGE = ".,;:!?\"'()[]{}|*-_<>"
_EDGES = np.zeros(256, bool)
_EDGES[[*_EDGE.encode(), 32, *range(9, 14)]] = True


def _crc_fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of five. A null id is not."""
    return F.coalesce(_crc_fold(id_col) == 0, F.lit(False))


def tokens(text: str | None) -> list[str]:
    """The text's words, as Words has them: lower-cased, without punctuation around; of one over PIECE characters its pieces of
    PIECE, half overlapping."""
    words = [w.strip(_EDGE) or w for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]


def trigrams(word: str) -> list[int]:
    """The rows of a word's character trigrams, its ends marked."""
    w = np.array([60, *map(ord, word), 62], np.uint64)
    return _trigram_rows(w[:-2], w[1:-1], w[2:]).tolist()


def _trigram_rows(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return (textscan.mixed(x | y << np.uint64(21) | z << np.uint64(42)) % np.uint64(CHAR_ROWS)).astype(np.int64)


class Words:
    """The words of some texts, found in all their bytes at once: hashes of the distinct ones, the texts' words as numbers
    of these (of, from bounds[i] to bounds[i + 1]), and the trigrams of any of them."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join([*texts, b""])
        view = np.frombuffer(data, np.uint8)
        space = np.concatenate([[True], (view == 32) | ((view >= 9) & (view <= 13))])
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        # Without punctuation around, unless there is nothing else.
        inner = np.flatnonzero(~_EDGES[view])
        first, past = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
        some = past > first
        starts[some], ends[some] = inner[first[some]], inner[past[some] - 1] + 1
        self.chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((view & 0xC0) != 0x80)])
        over = np.flatnonzero(before[ends] - before[starts] > PIECE)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        if len(over):
            at = np.flatnonzero((view & 0xC0) != 0x80)  # where each character begins
            cut = {i: [(int(at[c]), int(at[c + PIECE]) if c + PIECE < before[ends[i]] else int(ends[i])) for c in range(before[starts[i]], max(before[starts[i]] + 1, before[ends[i]] - PIECE // 2), PIECE // 2)] for i in over.tolist()}
            n = np.ones(len(starts), np.int64)
            n[over] = [len(cut[i]) for i in over.tolist()]
            place = np.cumsum(n) - n
            new = np.repeat(starts, n), np.repeat(ends, n)
            for i in over.tolist():
                new[0][place[i] : place[i] + n[i]], new[1][place[i] : place[i] + n[i]] = zip(*cut[i], strict=True)
            starts, ends = new
        self.bounds = np.searchsorted(starts, offsets)
        self.hashes, where, of = np.unique(textscan.run_hashes(view, starts, ends), return_index=True, return_inverse=True)
        self.of = of.reshape(-1)
        self.low, self.high = before[starts[where]], before[ends[where]]

    def trigrams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The trigram rows of these distinct words, one after the other, and how many each has: as many as characters."""
        sizes = self.high[words] - self.low[words]
        begins = np.cumsum(sizes) - sizes
        at = np.repeat(self.low[words] - begins, sizes) + np.arange(int(sizes.sum()))
        y = self.chars[at].astype(np.uint64)
        x, z = np.roll(y, 1), np.roll(y, -1)
        x[begins], z[begins + sizes - 1] = 60, 62
        return _trigram_rows(x, y, z), sizes


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode()


@dataclass
class Model:
    """known, odds: hashes of the known words, ascending, and their log-odds; the rest are weights."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    char_odds: np.ndarray = field(default_factory=lambda: np.zeros(CHAR_ROWS, np.float32))
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    trained: bool = False


DIM = WORD_DIM + CHAR_DIM + 2


def _initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"word": rng.normal(0, 0.05, (WORD_ROWS, WORD_DIM)), "char": rng.normal(0, 0.05, (CHAR_ROWS, CHAR_DIM))}
    for d in "fb":
        w |= {f"{d}x": rng.normal(0, 0.3, (DIM, 3 * HIDDEN)), f"{d}h": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"{d}c": np.zeros(3 * HIDDEN)}
    w |= {"att": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "att_c": np.zeros(HIDDEN), "att_v": rng.normal(0, 0.3, HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_c": np.array([-1.0])}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Runs windows, given as rows of a table of word inputs (row 0: no word). x: (rows, DIM)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the gates get from each input, for either direction; once for each distinct word."""
        return x @ self.w["fx"] + self.w["fc"], x @ self.w["bx"] + self.w["bc"]

    def run(self, both: tuple[np.ndarray, np.ndarray], at: np.ndarray, keep: bool = False):
        """Logits of windows at: (windows, WINDOW) rows of both; row 0 leaves the state as it is."""
        n, t = at.shape
        states = np.zeros((2, t, n, HIDDEN), np.float32)
        kept: list[list] = [[], []]
        real = (at > 0).astype(np.float32)[:, :, None]
        for d, name in enumerate("fb"):
            h, u, table = np.zeros((n, HIDDEN), np.float32), self.w[f"{name}h"], both[d]
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                g = table[at[:, i]]
                a = h @ u[:, : 2 * HIDDEN]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + a)
                z, r = zr[:, :HIDDEN] * real[:, i], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                if keep:
                    kept[d].append((i, h, z, r, c))
                h = states[d, i] = new
        s = np.concatenate([states[0], states[1]], 2).transpose(1, 0, 2)
        e = np.tanh(s @ self.w["att"] + self.w["att_c"])
        score = e @ self.w["att_v"] - 1e4 * (1 - real[:, :, 0])
        score[:, 0] += 1e4 * (real[:, :, 0].sum(1) == 0)
        a = np.exp(score - score.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, s)
        logit = pooled @ self.w["out"] + self.w["out_c"][0]
        return (logit, (real, kept, s, e, a, pooled)) if keep else logit

    def gradients(self, x: np.ndarray, both, at: np.ndarray, saved, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weights, and of x, from those of the logits."""
        real, kept, s, e, a, pooled = saved
        w, g = self.w, {}
        g["out"], g["out_c"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * w["out"]
        d_s = a[:, :, None] * d_pooled[:, None, :]
        d_a = np.einsum("nh,nth->nt", d_pooled, s)
        d_score = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["att_v"] = np.einsum("nt,nth->h", d_score, e)
        d_e = d_score[:, :, None] * w["att_v"] * (1 - e * e)
        g["att"], g["att_c"] = np.einsum("nti,ntj->ij", s, d_e), d_e.sum((0, 1))
        d_s = d_s + d_e @ w["att"].T
        d_x = np.zeros_like(x)
        for d, name in enumerate("fb"):
            u, own = w[f"{name}h"], d_s[:, :, d * HIDDEN : (d + 1) * HIDDEN]
            d_u, d_table = np.zeros_like(u), np.zeros_like(both[d])
            d_h = np.zeros((len(at), HIDDEN), np.float32)
            for i, h, z, r, c in reversed(kept[d]):
                d_h = d_h + own[:, i]
                d_c = d_h * z * (1 - c * c)
                d_z = d_h * (c - h) * z * (1 - z) * real[:, i]
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], 1)
                d_u[:, : 2 * HIDDEN] += h.T @ d_zr
                d_u[:, 2 * HIDDEN :] += (r * h).T @ d_c
                np.add.at(d_table, at[:, i], np.concatenate([d_zr, d_c], 1))
                d_h = d_h * (1 - z) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T
            g[f"{name}h"], g[f"{name}x"], g[f"{name}c"] = d_u, x.T @ d_table, d_table.sum(0)
            d_x += d_table @ w[f"{name}x"].T
        return g, d_x


def windows_of(rows: np.ndarray) -> np.ndarray:
    """All windows of a text's words, given as rows: (windows, WINDOW), zeros beyond the end; each word is in one at least."""
    n = max(1, -(-max(0, len(rows) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int64)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _inputs(model: Model, hashes: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(words + 1, DIM), of words given by hash and trigrams; row 0 is for no word."""
    x = np.zeros((len(hashes) + 1, DIM), np.float32)
    if len(hashes):
        begins = np.cumsum(sizes) - sizes
        x[1:, :WORD_DIM] = model.weights["word"][(hashes % np.uint64(WORD_ROWS)).astype(np.int64)]
        x[1:, WORD_DIM:-2] = np.add.reduceat(model.weights["char"][grams], begins) / sizes[:, None]
        if len(model.known):
            at = np.minimum(np.searchsorted(model.known, hashes), len(model.known) - 1)
            x[1:, -2] = np.where(model.known[at] == hashes, model.odds[at], 0)
        x[1:, -1] = np.add.reduceat(model.char_odds[grams], begins) / sizes
    return x


def _vocabulary(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of the distinct words, all trigrams, where each word's begin and how many they are, and the texts' words as
    numbers of the hashes. Texts are scanned some at a time."""
    parts, own, held = [], [], 0
    for k, text in enumerate(texts):
        own.append(_bytes(text))
        held += len(own[-1])
        if held > textscan.GROUP // 2 or k == len(texts) - 1:
            words = Words(own)
            parts.append((words.hashes, *words.trigrams(np.arange(len(words.hashes))), words.of, words.bounds))
            own, held = [], 0
    hashes, first, number = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    grams, sizes = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    out, base = [], 0
    for p in parts:
        numbered = number.reshape(-1)[base + p[3]]
        out += [numbered[a:b] for a, b in zip(p[4][:-1], p[4][1:], strict=True)]
        base += len(p[0])
    return hashes, grams, (np.cumsum(sizes) - sizes)[first], sizes[first], out


def train(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of (text, label) rows."""
    model, rng = Model(), np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], np.float32)
    if not 0 < labels.sum() < len(labels):
        return model
    hashes, grams, begins, sizes, texts = _vocabulary([t for t, _ in rows])
    # Documents that hold a word, by label; the same for trigrams.
    seen, held = np.zeros((2, len(hashes))), np.zeros((2, CHAR_ROWS))

    def grams_of(own: np.ndarray) -> np.ndarray:
        return grams[np.repeat(begins[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(int(sizes[own].sum()))]

    for own, y in zip(map(np.unique, texts), labels.astype(int), strict=True):
        seen[y, own] += 1
        held[y, np.unique(grams_of(own))] += 1
    n0, n1 = len(labels) - labels.sum(), labels.sum()
    odds = lambda k: np.log((k[1] + 0.5) / (n1 + 1)) - np.log((k[0] + 0.5) / (n0 + 1))
    common = seen.sum(0) >= 4
    model.known, model.odds = hashes[common], np.clip(odds(seen[:, common]), -4, 6).astype(np.float32)
    model.char_odds = np.clip(odds(held), -4, 4).astype(np.float32)
    model.weights = _initial(rng)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.weights.items()}
    windows = [windows_of(own + 1) for own in texts]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            own = order[low : low + BATCH]
            used, at = np.unique(np.concatenate([np.zeros(1, np.int64), *(windows[i].ravel() for i in own)]), return_inverse=True)
            at, used = at.reshape(-1)[1:].reshape(-1, WINDOW), used[1:] - 1  # row 0 stays for no word
            x = _inputs(model, hashes[used], grams_of(used), sizes[used])
            net = Network(model.weights)
            both = net.projected(x)
            every = np.concatenate([net.run(both, at[k : k + RUN]) for k in range(0, len(at), RUN)])
            ends = np.cumsum([0, *(len(windows[i]) for i in own)])
            top = np.stack([at[a + int(np.argmax(every[a:b]))] for a, b in zip(ends[:-1], ends[1:], strict=True)])
            logit, saved = net.run(both, top, keep=True)
            d_logit = ((_sigmoid(logit) - labels[own]) / len(own)).astype(np.float32)
            g, d_x = net.gradients(x, both, top, saved, d_logit)
            g["word"], g["char"] = np.zeros_like(model.weights["word"]), np.zeros_like(model.weights["char"])
            moved = np.flatnonzero(np.abs(d_x[1:]).sum(1))
            np.add.at(g["word"], (hashes[used[moved]] % np.uint64(WORD_ROWS)).astype(np.int64), d_x[1:][moved, :WORD_DIM])
            n = sizes[used[moved]]
            np.add.at(g["char"], grams_of(used[moved]), np.repeat(d_x[1:][moved, WORD_DIM:-2] / n[:, None], n, axis=0))
            step += 1
            for k, v in g.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.01 * (v * v - m2)
                model.weights[k] -= (0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    model.trained = True
    return model


class Scorer:
    """Scores texts. The gates' inputs are kept for words met before, up to MEMORY of them."""

    def __init__(self, model: Model):
        self.model, self.net = model, Network(model.weights) if model.trained else None
        self.forget()

    def forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if self.net is not None:
            self.tables = self.net.projected(np.zeros((1, DIM), np.float32))

    def _rows(self, words: Words) -> np.ndarray:
        """Where the tables have each distinct word."""
        if len(self.hashes) > MEMORY:
            self.forget()
        place = np.searchsorted(self.hashes, words.hashes)
        known = np.zeros(len(place), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == words.hashes
        fresh = np.flatnonzero(~known)
        out = np.zeros(len(place), np.int64)
        out[known] = self.rows[place[known]]
        out[fresh] = len(self.tables[0]) + np.arange(len(fresh))
        made = self.net.projected(_inputs(self.model, words.hashes[fresh], *words.trigrams(fresh)))
        self.tables = tuple(np.concatenate([t, m[1:]]) for t, m in zip(self.tables, made, strict=True))
        self.hashes, self.rows = np.insert(self.hashes, place[fresh], words.hashes[fresh]), np.insert(self.rows, place[fresh], out[fresh])
        return out

    def score(self, texts: list[str | None]) -> list[float]:
        if self.net is None:
            return [0.0] * len(texts)
        best = np.full(len(texts), -np.inf, np.float32)
        low = 0
        while low < len(texts):
            own, held = [], 0
            while low + len(own) < len(texts) and held < textscan.GROUP // 2:
                own.append(_bytes(texts[low + len(own)]))
                held += len(own[-1])
            self._block(own, best[low : low + len(own)])
            low += len(own)
        return _sigmoid(best.astype(np.float64)).tolist()

    def _block(self, texts: list[bytes], best: np.ndarray) -> None:
        if len(texts) == 1 and len(texts[0]) > 2 * textscan.GROUP:
            best[0] = self._long(texts[0])
            return
        words = Words(texts)
        rows = self._rows(words)[words.of]
        parts = [windows_of(rows[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        for k, logits in self._logits(np.concatenate(parts)):
            np.maximum.at(best, of[k : k + RUN], logits)

    def _logits(self, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(0, len(windows), RUN):
            yield k, self.net.run(self.tables, windows[k : k + RUN])

    def _long(self, text: bytes) -> float:
        """A long text's highest logit, from its pieces. What stands behind a piece's last whole window goes along to the next."""
        carried, best = [t[:0] for t in self.tables], -np.inf
        for a, b in textscan.pieces(np.frombuffer(text, np.uint8), 0, len(text)):
            words = Words([text[a:b]])
            rows = self._rows(words)[words.of]
            rows = np.concatenate([len(self.tables[0]) + np.arange(len(carried[0])), rows])
            self.tables = tuple(np.concatenate(pair) for pair in zip(self.tables, carried, strict=True))
            whole = max(0, (len(rows) - WINDOW) // STRIDE + 1) if b < len(text) else None
            if whole is None and best > -np.inf and len(rows) <= WINDOW - STRIDE:
                break  # windows before have them
            windows = windows_of(rows)[:whole]
            best = max([best, *(float(x.max()) for _, x in self._logits(windows))])
            carried = [t[rows[(whole or 0) * STRIDE :]] for t in self.tables]
        return best


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """A model of the labelled documents that are not held out: of each label at most max_docs / 2, by a hash of the id."""
    labels = labels.where(~held_out(id_col)).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    order = F.struct(F.xxhash64(F.lit(SEED), "_id"), "_id")
    # The two samples are bounded by the parameter, so they may be gathered and broadcast.
    some = [labels.where(F.col("_y") == y).dropDuplicates(["_id"]).orderBy(order).limit(max_docs // 2) for y in (0, 1)]
    chosen = some[0].unionAll(some[1])
    rows = documents.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("_id", F.col(text_col).alias("_text"), "_y").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    # In a task of its own: the texts and the training's arrays stay out of the driver, whose memory they would hold from then on.
    ship(documents.sparkSession)
    made = rows.select("_id", "_y", "_text").repartition(1).mapInArrow(_trained, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Model()


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of rows (id, label, text)."""
    rows = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
    if rows:
        model = train([(text, y) for _, y, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or ""))])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents with score, from 0 to 1."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c != "score"]
    place = kept.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.score(batch.column(place).to_pylist()), pa.float64())], names=[*kept, "score"])

    schema = documents.select(*kept).schema.add("score", "double")
    return documents.select(*kept).mapInArrow(scored, schema)
