"""Language identification by a byte convolutional network in numpy.

A window of WINDOW bytes goes through filters of several widths over byte embeddings, then ReLU, max pooling over time and softmax. For
scoring, embedding and filters are folded into one table for each width and place (256 bytes x filters), so a convolution is a
sum of table rows. Every byte of every text is in one window; a document's probabilities are the means of its windows', weighted by bytes.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.llm.common import LOWER, chunks, small_batches, text_buffers

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4, 5), 16, 8
#: About so many documents are learned from.
TRAIN_DOCS = 4000
#: Classes, and bytes of text that one task learns from, at most.
MOST_LANGS, TRAIN_BYTES = 1000, 256 << 20
#: Bytes of a long text that are scored at a time: whole windows.
PART = 4096 * WINDOW
#: Documents of a rare language that are learned from at least, if it has so many.
RARE_DOCS = 64
UNDETERMINED = "und"


def cut_windows(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (zero-padded), the text of each, and its bytes."""
    n = np.diff(bounds)
    count = -(-n // WINDOW)
    of = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[of] + place * WINDOW
    size = np.minimum(WINDOW, bounds[of + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, LOWER[raw[np.minimum(at, max(len(raw) - 1, 0))]], 0).astype(np.uint8), of, size


class ByteNet:
    def __init__(self, classes: list[str], seed: int = 5):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"E": r.normal(0, 0.5, (256, EMBED)).astype(np.float32), "O": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32), "o": np.zeros(len(classes), np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def fold(self) -> None:
        """Tables of the filters over byte values; byte 0 is padding and adds nothing."""
        e = self.p["E"].copy()
        e[0] = 0
        self.tables = {w: [np.ascontiguousarray(e @ self.p[f"W{w}"][j]) for j in range(w)] for w in WIDTHS}

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        out, where = [], {}
        for w in WIDTHS:
            n = WINDOW - w + 1
            a = self.tables[w][0][x[:, :n]]
            for j in range(1, w):
                a += self.tables[w][j][x[:, j : j + n]]
            where[w] = a.argmax(axis=1) if self.learning else None
            out.append(np.maximum(a.max(axis=1) + self.p[f"b{w}"], 0))
        return np.concatenate(out, axis=1), where

    learning = False

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of windows of classes y, and its gradients by all parameters."""
        n = np.arange(len(y))
        self.fold()
        h, where = self.pooled(x)
        z = h @ self.p["O"] + self.p["o"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        loss = float(-np.log(d[n, y]).mean())
        d[n, y] -= 1
        d /= len(y)
        g = {"O": h.T @ d, "o": d.sum(axis=0), "E": np.zeros_like(self.p["E"])}
        dh = (d @ self.p["O"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            dw = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = dw.sum(axis=0)
            g[f"W{w}"] = np.zeros_like(self.p[f"W{w}"])
            for j in range(w):
                seen = x[n[:, None], where[w] + j]  # the byte under each filter's maximum
                e = self.p["E"][seen] * (seen > 0)[:, :, None]
                g[f"W{w}"][j] = np.einsum("bfe,bf->ef", e, dw)
                np.add.at(g["E"], seen.ravel(), (dw[:, :, None] * self.p[f"W{w}"][j].T[None] * (seen > 0)[:, :, None]).reshape(-1, EMBED))
        return loss, g

    def probabilities(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for k in range(0, len(x), batch):
            z = self.pooled(x[k : k + batch])[0] @ self.p["O"] + self.p["o"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[k : k + batch] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, raw: np.ndarray, bounds: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 96, rate: float = 0.01, seed: int = 6) -> ByteNet:
        """Learns from texts (their bytes, and bounds of each) of classes y. Each step draws texts, all classes alike, and a window of each, from anywhere in it."""
        r = np.random.default_rng(seed)
        weight = 1 / np.maximum(np.bincount(y, minlength=len(self.classes)), 1)[y]
        weight /= weight.sum()
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.learning = True
        for step in range(1, steps + 1):
            take = r.choice(len(y), batch, p=weight)
            size = np.diff(bounds)[take]
            window = np.floor(r.random(batch) * np.ceil(size / WINDOW)).astype(np.int64)
            at = window[:, None] * WINDOW + np.arange(WINDOW)
            xb = np.where(at < size[:, None], LOWER[raw[np.minimum(bounds[take][:, None] + at, len(raw) - 1)]], 0).astype(np.uint8)
            _, g = self.gradients(xb, y[take])
            for k, v in self.p.items():
                a, b = m[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                v -= (rate * (1 - 0.9 * step / steps) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.learning = False
        self.fold()
        return self


def training_rows(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_langs: int = MOST_LANGS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(lang, text) that a network is learned from; see train."""
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text <> ''")
    counts = known.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(most_langs)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    share = F.least(F.lit(1.0), F.greatest(F.lit(train_docs / max(total, 1)), RARE_DOCS / F.col("_n")))
    counts = counts.select("_lang", (F.floor(share * (1 << 20)) + 1).alias("_below"), (2 * F.ceil(share * F.col("_n")) + 1).alias("_most"))
    chosen = known.join(F.broadcast(counts), F.col("lang") == F.col("_lang"))  # most_langs rows
    chosen = chosen.withColumn("_h", F.xxhash64(F.lit(3), "id", "text")).filter(F.pmod("_h", F.lit(1 << 20)) < F.col("_below"))
    chosen = chosen.groupBy("lang", "text").agg(F.min("_h").alias("_h"), F.first("_most").alias("_most"))
    chosen = chosen.withColumn("_nth", F.row_number().over(W.partitionBy("lang").orderBy("_h"))).filter(F.col("_nth") <= F.least(F.col("_most"), F.lit(2 * (train_docs + RARE_DOCS))))
    chosen = chosen.withColumn("_upto", F.sum(F.octet_length("text")).over(W.orderBy("_nth", "lang"))).filter(F.col("_upto") <= train_bytes)
    return chosen.select("lang", "text")


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_langs: int = MOST_LANGS, train_bytes: int = TRAIN_BYTES) -> ByteNet | None:
    """A network learned from the whole texts of about train_docs of docs, chosen by a hash of id and text; None if no row has a text and a language.

    Null and empty texts and null languages teach nothing; equal texts of a language count once. A language of which that share would be under RARE_DOCS gives about RARE_DOCS documents, or all it has, so each of the most_langs most
    frequent languages is a class. At most 2 * train_docs + 2 * RARE_DOCS * most_langs rows are learned from, and train_bytes bytes; texts beyond them, in an order that takes the first of each language first, are left out.
    """

    rows = training_rows(docs, train_docs, id_col, text_col, lang_col, most_langs, train_bytes)

    def fit(batches):
        got = sorted((k, x) for b in batches for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x)
        if got:
            classes = sorted({k for k, _ in got})
            raw, bounds = text_buffers(pa.array([x for _, x in got], pa.string()))
            net = ByteNet(classes).fit(raw, bounds, np.array([classes.index(k) for k, _ in got]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((classes, net.p))], pa.binary())], ["net"])

    # The sample is bounded, so one task learns from it; the driver gets the network only.
    found = rows.repartition(1).mapInArrow(fit, "net binary").first()
    if found is None:
        return None
    classes, p = pickle.loads(found["net"])
    net = ByteNet(classes)
    net.p = p
    net.fold()
    return net


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row. A null text, and one without a letter, is `und` with score 0; so are all without a network.

    Rows are judged one by one, so null and repeated ids change nothing, and equal texts have equal results. Other columns are ignored. A long text is scored PART bytes at a time.
    """

    def run(batches):
        for b in batches:
            raw, bounds = text_buffers(b.column(1))
            best, score = np.zeros(b.num_rows, int), np.zeros(b.num_rows)
            for lo, hi in chunks(bounds) if net else ():
                sums = np.zeros((hi - lo, len(net.classes)))
                # Texts share a chunk whole, or one long text is read in parts of whole windows.
                for at in range(bounds[lo], bounds[hi], PART if hi - lo == 1 else 1 << 62):
                    stop = min(at + PART, bounds[hi]) if hi - lo == 1 else bounds[hi]
                    x, of, size = cut_windows(raw[at:stop], np.array([0, stop - at]) if hi - lo == 1 else bounds[lo : hi + 1] - bounds[lo])
                    p = net.probabilities(x) * size[:, None]
                    for c in range(len(net.classes)):
                        sums[:, c] += np.bincount(of, p[:, c], hi - lo)
                sums /= np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)
                best[lo:hi], score[lo:hi] = sums.argmax(axis=1), sums.max(axis=1)
            some = b.column(2).to_numpy(zero_copy_only=False).astype(bool) & (net is not None)
            names = [net.classes[k] if ok else UNDETERMINED for k, ok in zip(best, some)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(some, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("some"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))
