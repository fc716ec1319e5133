"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of its word embedding and the mean of its character n-gram embeddings (three and five letters, those at
the start of the word apart). Words and n-grams that too few documents of the sample hold have none. Windows of WINDOW words, each sharing OVERLAP words with the next, run through a GRU in either
direction; attention pools the states; a document's score is that of its most toxic window. It is learned the same way: the
gradient of a document's loss goes to its highest window (multiple-instance learning), so document labels suffice.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograil.llm.common import LOWER, WORD_FACTORS, Powers, chunks, mix, small_batches, span_hashes, text_buffers, word_bounds

WINDOW, OVERLAP, EMBED, HIDDEN = 32, 8, 16, 12
GRAMS, TABLE_BITS = (3, 5), 20
#: At most so many labelled documents of class 1, and twice as many of class 0, are learned from.
TRAIN_EACH = 1500
#: A word or n-gram needs so many documents of the sample for an embedding; evidence below CHANCE is none, and what is above starts the first value of the embedding.
LEAST_DOCS, CHANCE, WORD_START, GRAM_START = 3, 3.5, 0.5, 2.0
#: Bytes of text of a class that one task learns from at most.
TRAIN_BYTES = 64 << 20
#: Share of a step's words whose embeddings are left out, so that no document is learned by a single word; embeddings move slowly from where they start.
DROPPED, RATE = 0.3, 0.05


IS_SIGN = np.zeros(256, bool)
IS_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Numbers of known hashes, from 1 on; all others have 0. A table by 20 hash bits, checked against the whole hash; of those that share the bits, all but the first are looked for in a short sorted list."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.number = np.zeros(1 << TABLE_BITS, np.int32)
        slots = hashes & np.uint64((1 << TABLE_BITS) - 1)
        first = np.unique(slots, return_index=True)[1]
        self.number[slots[first]] = first + 1
        self.whole = np.concatenate([np.zeros(1, np.uint64), hashes])
        rest = np.setdiff1d(np.arange(len(hashes)), first)
        rest = rest[np.argsort(hashes[rest])]
        self.rest, self.rest_numbers = hashes[rest], (rest + 1).astype(np.int32)

    def __reduce__(self):
        return Vocabulary, (self.hashes,)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        n = self.number[hashes & np.uint64((1 << TABLE_BITS) - 1)]
        taken = n > 0
        n = np.where(self.whole[n] == hashes, n, 0)
        if len(self.rest):
            open_ = np.flatnonzero(taken & (n == 0))
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            n[open_] = np.where(self.rest[at] == hashes[open_], self.rest_numbers[at], 0)
        return n


def bare(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the ASCII signs at their ends; a word of signs only stays as it is."""
    plain = ~IS_SIGN[raw]
    place = np.arange(len(raw))
    ahead = np.minimum.accumulate(np.where(plain, place, len(raw))[::-1])[::-1]
    behind = np.maximum.accumulate(np.where(plain, place, -1))
    lo, hi = ahead[starts], behind[stops - 1] + 1
    some = lo < hi
    return np.where(some, lo, starts), np.where(some, hi, stops)


class Words:
    """Distinct words of some texts: hashes of the words and of their n-grams, and where each occurs."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, p: Powers):
        raw = LOWER[raw]
        starts, stops, self.first = word_bounds(raw, bounds)
        starts, stops = bare(raw, starts, stops)
        hashes = span_hashes(raw, starts, stops, p)
        _, at, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = hashes[at]
        s, n = starts[at], (stops - starts)[at]
        grams, owner = [], []
        for g in GRAMS:
            count = np.maximum(n - g + 1, 1)
            who = np.repeat(np.arange(len(at)), count)
            place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            lo = s[who] + place
            h = span_hashes(raw, lo, np.minimum(lo + g, s[who] + n[who]), p)
            grams.append(mix(h + (place == 0) * WORD_FACTORS[3]))
            owner.append(who)
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.grams, self.owner = grams[order], owner[order]
        self.n_grams = np.bincount(owner, minlength=len(at))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of each window (-1: past the end), and the text of each."""
        n = np.diff(self.first)
        count = np.where(n > WINDOW, 1 + -(-(n - WINDOW) // (WINDOW - OVERLAP)), (n > 0).astype(np.int64))
        of = np.repeat(np.arange(len(n)), count)
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = (self.first[of] + place * (WINDOW - OVERLAP))[:, None] + np.arange(WINDOW)
        inside = at < self.first[of + 1][:, None]
        return np.where(inside, self.of[np.minimum(at, max(len(self.of) - 1, 0))] if len(self.of) else -1, -1), of


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How surely a feature tells toxic documents from clean ones: the signed root of its likelihood ratio, from the numbers of documents that hold it, less what chance gives."""
    k, n = toxic + clean, n_toxic + n_clean
    part = lambda seen, want: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(want, 1e-9)), 0.0)
    ratio = part(toxic, k * n_toxic / n) + part(clean, k * n_clean / n) + part(n_toxic - toxic, (n - k) * n_toxic / n) + part(n_clean - clean, (n - k) * n_clean / n)
    root = np.sqrt(2 * np.maximum(ratio, 0))
    return (np.where(toxic * n_clean > clean * n_toxic, 1, -1) * np.maximum(root - CHANCE, 0)).astype(np.float32)


class Sample:
    """Words and windows of the texts to learn from, made once."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        raw, bounds = text_buffers(pa.array(texts, pa.string()))
        p, parts, base = Powers(), [], 0
        words, grams = [], []
        for lo, hi in chunks(bounds):
            w = Words(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], p)
            win, of = w.windows()
            parts.append([w.word, w.grams, w.n_grams, np.where(win >= 0, win + base, -1), of + lo])
            base += len(w.word)
            # (document, word) pairs, and the (document, n-gram) pairs of these.
            pairs = np.unique(np.repeat(np.arange(hi - lo), np.diff(w.first)) << 32 | w.of)
            doc, word = pairs >> 32, pairs & 0xFFFFFFFF
            y = labels[lo:hi] == 1
            words.append((w.word, np.bincount(word[y[doc]], minlength=len(w.word)), np.bincount(word[~y[doc]], minlength=len(w.word))))
            kinds, back = np.unique(w.grams, return_inverse=True)
            at = np.concatenate([[0], np.cumsum(w.n_grams)])
            n = w.n_grams[word]
            held = np.unique(np.repeat(doc, n) << 32 | back[np.repeat(at[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            doc, gram = held >> 32, held & 0xFFFFFFFF
            grams.append((kinds, np.bincount(gram[y[doc]], minlength=len(kinds)), np.bincount(gram[~y[doc]], minlength=len(kinds))))
        n = ((labels == 1).sum(), (labels != 1).sum())
        (self.words, self.word_evidence), (self.gram_kinds, self.gram_evidence) = self.known(words, LEAST_DOCS, n), self.known(grams, LEAST_DOCS, n)
        for x in parts:
            x[0], x[1] = self.words.find(x[0]), self.gram_kinds.find(x[1])
        self.word, self.grams, self.n_grams, self.win, self.of = (np.concatenate(x) for x in zip(*parts))
        self.gram_at = np.concatenate([[0], np.cumsum(self.n_grams)])

    @staticmethod
    def known(counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int, n: tuple[int, int]) -> tuple[Vocabulary, np.ndarray]:
        """Features that enough documents hold, and their evidence (0 for all others)."""
        kinds, back = np.unique(np.concatenate([k for k, _, _ in counted]), return_inverse=True)
        toxic, clean = (np.bincount(back, np.concatenate([c[i] for c in counted]), len(kinds)) for i in (1, 2))
        some = toxic + clean >= least
        vocabulary = Vocabulary(kinds[some])
        return vocabulary, np.concatenate([np.zeros(1, np.float32), evidence(toxic[some], clean[some], *n)])

    def part(self, rows: np.ndarray):
        """The words of these windows (numbers in the vocabularies), and the windows by word."""
        win = self.win[rows]
        own, back = np.unique(win, return_inverse=True)
        back = back.reshape(win.shape)
        if len(own) and own[0] < 0:
            own, back = own[1:], back - 1
        n = self.n_grams[own]
        at = np.arange(n.sum()) + np.repeat(self.gram_at[own] - (np.cumsum(n) - n), n)
        return (self.word[own], self.grams[at], n), back

    def rows_of(self, texts: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(self.of, texts))


class GatedNet:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *shape, s=None: r.normal(0, s or shape[0] ** -0.5, shape).astype(np.float32)
        self.know(Vocabulary(np.zeros(0, np.uint64)), Vocabulary(np.zeros(0, np.uint64)))
        self.p = {"A": f(2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "v": f(HIDDEN), "w": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(EMBED, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"k{d}": np.zeros(3 * HIDDEN, np.float32)}

    def know(self, words: Vocabulary, grams: Vocabulary) -> None:
        self.word_kinds, self.gram_kinds = words, grams
        self.words, self.grams = np.zeros((len(words.hashes) + 1, EMBED), np.float32), np.zeros((len(grams.hashes) + 1, EMBED), np.float32)

    def state(self) -> tuple:
        """All that was learned, as plain arrays."""
        return self.p, self.word_kinds.hashes, self.gram_kinds.hashes, self.words, self.grams

    @staticmethod
    def of(state: tuple) -> GatedNet:
        net = GatedNet()
        net.p, words, grams, net.words, net.grams = state
        net.word_kinds, net.gram_kinds = Vocabulary(words), Vocabulary(grams)
        return net

    def vectors(self, word: np.ndarray, grams: np.ndarray, n_grams: np.ndarray) -> np.ndarray:
        """Input vectors of words from their numbers, the numbers of their n-grams, and how many each has."""
        sums = np.add.reduceat(self.grams[grams], np.concatenate([[0], np.cumsum(n_grams)[:-1]]).astype(int), axis=0) if len(grams) else np.zeros((0, EMBED), np.float32)
        return self.words[word] + sums / np.maximum(n_grams, 1)[:, None].astype(np.float32)

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input parts of the gates for each distinct word, and zeros at the end for padding."""
        return {d: np.concatenate([x @ self.p[f"W{d}"] + self.p[f"k{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]).astype(np.float32) for d in "fb"}

    def states(self, t: dict[str, np.ndarray], win: np.ndarray, keep: bool = False):
        h, trace = np.zeros((WINDOW, len(win), 2 * HIDDEN), np.float32), {}
        for d in "fb":
            s, u = np.zeros((len(win), HIDDEN), np.float32), self.p[f"U{d}"]
            steps = range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
            half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            for i in steps:
                g, q = t[d][win[:, i]], s @ u
                zr = 0.5 + 0.5 * np.tanh(0.5 * (g[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN]))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(g[:, 2 * HIDDEN :] + r * q[:, 2 * HIDDEN :])
                z = z * (win[:, i] >= 0)[:, None]
                if keep:
                    trace[d, i] = (s, z, r, n, q[:, 2 * HIDDEN :])
                s = s + z * (n - s)
                h[i, :, half] = s
        return h, trace

    def pool(self, h: np.ndarray, win: np.ndarray):
        k = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(win.T >= 0, k @ self.p["v"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, h)
        return pooled @ self.p["w"] + self.p["c"][0], (k, a, pooled)

    def logits(self, w: Words, batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        win, of = w.windows()
        t, out = self.tables(self.vectors(self.word_kinds.find(w.word), self.gram_kinds.find(w.grams), w.n_grams)), np.empty(len(win), np.float32)
        for i in range(0, len(win), batch):
            h, _ = self.states(t, win[i : i + batch])
            out[i : i + batch] = self.pool(h, win[i : i + batch])[0]
        return out, of

    def gradients(self, x: np.ndarray, win: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean cross-entropy of windows with labels y, its gradients by the parameters, and by the words' input vectors x."""
        t = self.tables(x)
        h, trace = self.states(t, win, keep=True)
        logit, (k, a, pooled) = self.pool(h, win)
        d = (sigmoid(logit) - y) / len(y)
        g = {"w": pooled.T @ d, "c": np.array([d.sum()])}
        dp = d[:, None] * self.p["w"]
        dh = a[:, :, None] * dp
        da = np.einsum("bh,tbh->tb", dp, h)
        de = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tbh,tb->h", k, de)
        dk = de[:, :, None] * self.p["v"] * (1 - k * k)
        g["A"], g["a"] = np.einsum("tbi,tbj->ij", h, dk), dk.sum(axis=(0, 1))
        dh = dh + dk @ self.p["A"].T
        dx = np.zeros_like(x)
        for dr in "fb":
            u, gu, gin = self.p[f"U{dr}"], np.zeros_like(self.p[f"U{dr}"]), np.zeros_like(t[dr])
            ds = np.zeros((len(win), HIDDEN), np.float32)
            steps_back = range(WINDOW - 1, -1, -1) if dr == "f" else range(WINDOW)
            half = slice(0, HIDDEN) if dr == "f" else slice(HIDDEN, None)
            for i in steps_back:
                s, z, rr, n, qn = trace[dr, i]
                ds = ds + dh[i, :, half]
                dn = ds * z * (1 - n * n)
                dz = ds * (n - s) * z * (1 - z) * (win[:, i] >= 0)[:, None]
                drr = dn * qn * rr * (1 - rr)
                dq = np.concatenate([dz, drr, dn * rr], axis=1)
                gu += s.T @ dq
                np.add.at(gin, win[:, i], np.concatenate([dz, drr, dn], axis=1))
                ds = ds * (1 - z) + dq @ u.T
            gin = gin[:-1]
            g[f"U{dr}"], g[f"W{dr}"], g[f"k{dr}"] = gu, x.T @ gin, gin.sum(axis=0)
            dx += gin @ self.p[f"W{dr}"].T
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        return loss, g, dx

    def learn(self, texts: list[str], labels: np.ndarray, steps: int = 300, batch: int = 64, rate: float = 0.01, seed: int = 4) -> GatedNet:
        r = np.random.default_rng(seed)
        kinds = [np.flatnonzero(labels == k) for k in (0, 1)]
        if not len(kinds[0]) or not len(kinds[1]):
            self.p["c"][0] = 4.0 if len(kinds[1]) else -4.0
            self.p["w"][:] = 0
            return self
        sample = Sample(texts, labels)
        self.know(sample.words, sample.gram_kinds)
        self.words[:, 0], self.grams[:, 0] = WORD_START * sample.word_evidence, GRAM_START * sample.gram_evidence
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        energy = {"words": np.full(len(self.words), 1e-6, np.float32), "grams": np.full(len(self.grams), 1e-6, np.float32)}
        for step in range(1, steps + 1):
            rows = sample.rows_of(np.concatenate([r.choice(kinds[0], batch * 5 // 8), r.choice(kinds[1], batch * 3 // 8)]))
            w, win = sample.part(rows)
            score = self.pool(self.states(self.tables(self.vectors(*w)), win)[0], win)[0]
            # the highest window of each document
            of = sample.of[rows]
            order = np.lexsort((score, of))
            rows = rows[order[np.append(np.flatnonzero(np.diff(of[order])), len(order) - 1)]]
            (word, grams, n_grams), win = sample.part(rows)
            word = np.where(r.random(len(word)) < DROPPED, 0, word)
            y = labels[sample.of[rows]].astype(np.float32)
            _, g, dx = self.gradients(self.vectors(word, grams, n_grams), win, y)
            for name, v in self.p.items():
                m1, m2 = moments[name]
                m1 += 0.1 * (g[name] - m1)
                m2 += 0.001 * (g[name] ** 2 - m2)
                v -= (rate * (1 - 0.9 * step / steps) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            for name, numbers, grad in (("words", word, dx), ("grams", grams, np.repeat(dx / np.maximum(n_grams, 1)[:, None], n_grams, axis=0))):
                use = numbers > 0
                own, back = np.unique(numbers[use], return_inverse=True)
                sums = np.zeros((len(own), EMBED), np.float32)
                np.add.at(sums, back, grad[use])
                energy[name][own] += (sums**2).mean(axis=1)
                getattr(self, name)[own] -= RATE * sums / np.sqrt(energy[name][own])[:, None]
        self.center(sample, labels)
        return self

    def center(self, sample: Sample, labels: np.ndarray) -> None:
        """Moves the bias so that the fewest documents of the sample lie on the wrong side of 0."""
        best = np.full(len(labels), -np.inf)
        for i in range(0, len(labels), 256):
            rows = sample.rows_of(np.arange(i, min(i + 256, len(labels))))
            w, win = sample.part(rows)
            np.maximum.at(best, sample.of[rows], self.pool(self.states(self.tables(self.vectors(*w)), win)[0], win)[0])
        order = np.argsort(best)
        wrong = (labels == 0).sum() + np.concatenate([[0], np.cumsum(np.where(labels[order] == 1, 1, -1))])
        good = np.flatnonzero(wrong == wrong.min())
        at = good[len(good) // 2]
        lo, hi = best[order[max(at - 1, 0)]], best[order[min(at, len(order) - 1)]]
        if np.isfinite(lo) and np.isfinite(hi):
            self.p["c"][0] -= np.float32(np.clip((lo + hi) / 2, -4, 4))


def parts_of(raw: np.ndarray, most: int = 4 << 20):
    """Parts of a long text that windows can be cut from as from the whole: of about most bytes, each starting at the word where a window of the part before would."""
    if len(raw) <= 2 * most:
        yield 0, len(raw)
        return
    step = WINDOW - OVERLAP
    at, end = 0, most
    while True:
        starts, stops, _ = word_bounds(raw[at : min(end, len(raw))], np.array([0, min(end, len(raw)) - at]))
        last = end >= len(raw)
        whole = len(starts) - (0 if last else 1)  # the last word may go on
        n = 1 + (whole - WINDOW) // step if whole >= WINDOW else 0
        if last or not n:
            if last:
                yield at, len(raw)
                return
            end += most
            continue
        yield at, at + int(stops[(n - 1) * step + WINDOW - 1])
        at, end = at + int(starts[n * step]), at + int(starts[n * step]) + most


def bucket(id_col: str, parts: int):
    """The id's fold: CRC-32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def training_rows(docs: DataFrame, labels: DataFrame, train_each: int = TRAIN_EACH, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(label, text) that a network is learned from; see train."""
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).distinct()
    order = F.xxhash64(F.lit(9), F.col("_id").cast("string"))
    most = {1: train_each, 0: 2 * train_each}
    picked = known.filter("label = 1").orderBy(order, "_id").limit(most[1]).union(known.filter("label = 0").orderBy(order, "_id").limit(most[0]))
    found = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))  # 3 * train_each ids
    # An id may have any number of rows: the bounds are those of rows and bytes.
    found = found.withColumn("_order", F.struct(order, F.xxhash64("text")))
    rows = [found.filter(F.col("label") == k).orderBy("_order").limit(n).withColumn("_upto", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy("_order"))) for k, n in most.items()]
    return rows[0].union(rows[1]).filter(F.col("_upto") <= train_bytes).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, train_each: int = TRAIN_EACH, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_bytes: int = TRAIN_BYTES) -> GatedNet:
    """A network learned from the whole texts of at most train_each rows of class 1 and twice as many of class 0, and of train_bytes bytes of each class, chosen by a hash of the id, then of the text.

    Null labels and ids are left out; rows that repeat an id are rows of their own within those bounds. A text that would go beyond the bytes is left out, as are those behind it in the order of hashes. Empty texts teach nothing. With labels of one class only, that class is
    the verdict on all texts with words.
    """
    rows = training_rows(docs, labels, train_each, id_col, text_col, label_col, train_bytes)

    def fit(batches):
        got = sorted((k, x) for b in batches for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (x or "").strip())
        net = GatedNet().learn([x for _, x in got], np.array([k for k, _ in got], int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.state())], pa.binary())], ["net"])

    small_batches(docs.sparkSession)
    # The sample is bounded, so one task learns from it; the driver gets the network only.
    got = rows.repartition(1).mapInArrow(fit, "net binary").first()
    return GatedNet.of(pickle.loads(got["net"])) if got else GatedNet().learn([], np.zeros(0, int))


def score(docs: DataFrame, net: GatedNet, id_col: str = "doc_id", text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col, the probability that a text is toxic: that of its highest window. Texts without words, empty and null ones have 0.

    All columns of docs are returned, but for one named like out_col, which is replaced. Rows are scored one by one, so null and repeated ids change nothing; equal texts have equal scores.
    A long text is scored in parts that share a window's words, so a task holds one text and the arrays of one part.
    """
    columns = [c for c in docs.columns if c != out_col]
    docs = docs.select(*columns)
    at = columns.index(text_col)

    def run(batches):
        p = Powers()
        for b in batches:
            out = np.zeros(b.num_rows)
            raw, bounds = text_buffers(b.column(at).cast(pa.string()))
            for lo, hi in chunks(bounds):
                best = np.full(hi - lo, -np.inf)
                for x, y in parts_of(raw[bounds[lo] : bounds[hi]]) if hi - lo == 1 else [(0, bounds[hi] - bounds[lo])]:
                    logit, of = net.logits(Words(raw[bounds[lo] + x : bounds[lo] + y], bounds[lo : hi + 1] - bounds[lo] if hi - lo > 1 else np.array([0, y - x]), p))
                    np.maximum.at(best, of, logit)
                out[lo:hi] = np.where(np.isfinite(best), sigmoid(best), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*columns, out_col])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))
