"""Language of whole texts: a byte convolutional network, trained in numpy.

A window of WINDOW bytes goes through an embedding of bytes, filters of several widths, ReLU, the maximum over the window
and a softmax. A text is cut into windows end to end; its languages' probabilities are the windows' means, weighted by
their bytes. Training takes windows of at most SAMPLE labelled rows. For prediction, embedding and filters are
folded into tables over byte pairs, which gives the same numbers with a few look-ups for each byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, stored, text_buffer

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
SAMPLE, PER_TEXT, EPOCHS, BATCH, RATE = 6000, 2, 4, 64, 0.01
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (padded with zero bytes), each one's text, and its bytes."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[doc] + nth * WINDOW
    used = np.minimum(WINDOW, offsets[doc + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = padded[at]
    out[np.arange(WINDOW) >= used[:, None]] = 0
    return out, doc, used


class Network:
    """Parameters: embedding (256 x EMBED), a filter bank per width, biases, and the dense layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": r.normal(0, 0.5, (256, EMBED)), "dense": r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))), "out": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)), np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy. The maximum passes a gradient to one place per filter only."""
        p, n = self.p, len(x)
        e = p["embed"][x]
        pooled, best = [], []
        for w in WIDTHS:
            z = sum(e[:, i : WINDOW - w + 1 + i] @ p[f"w{w}"][i] for i in range(w)) + p[f"b{w}"]
            best.append(z.argmax(1))
            pooled.append(np.maximum(0, z.max(1)))
        h = np.concatenate(pooled, 1)
        logits = h @ p["dense"] + p["out"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        d = q.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["dense"], g["out"] = h.T @ d, d.sum(0)
        dh = (d @ p["dense"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            own = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = own.sum(0)
            for i in range(w):
                at = x[np.arange(n)[:, None], best[k] + i]  # n x FILTERS
                g[f"w{w}"][i] = np.einsum("nfe,nf->ef", p["embed"][at], own)
                np.add.at(g["embed"], at, own[:, :, None] * p[f"w{w}"][i].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 11) -> None:
        """Adam over shuffled batches."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), BATCH):
                at, t = order[a : a + BATCH], t + 1
                for k, g in self.step(x[at], y[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def folded(self) -> dict[str, np.ndarray]:
        """Tables for prediction: pair (65536 x all filters: the first two taps of each width), third (256 x FILTERS)
        and last (65536 x FILTERS: the last two taps of width 4)."""
        p = self.p
        tap = {(w, i): (p["embed"] @ p[f"w{w}"][i]).astype(np.float32) for w in WIDTHS for i in range(w)}
        pair = [tap[w, 0][:, None] + tap[w, 1][None] + p[f"b{w}"].astype(np.float32) for w in WIDTHS]
        last = tap[4, 2][:, None] + tap[4, 3][None]
        return {"pair": np.ascontiguousarray(np.concatenate(pair, 2).reshape(65536, -1)), "third": tap[3, 2], "last": np.ascontiguousarray(last.reshape(65536, -1)), "dense": p["dense"].astype(np.float32), "out": p["out"].astype(np.float32)}


def probabilities(tables: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Softmax of each window (n x WINDOW bytes)."""
    out = []
    for a in range(0, len(x), 256):
        own = x[a : a + 256]
        two = own[:, :-1].astype(np.int32) * 256 + own[:, 1:]
        z = tables["pair"][two]
        z[:, :-1, FILTERS : 2 * FILTERS] += tables["third"][own[:, 2:]]
        z[:, :-2, 2 * FILTERS :] += tables["last"][two[:, 2:]]
        h = np.concatenate([z[:, :, :FILTERS].max(1), z[:, :-1, FILTERS : 2 * FILTERS].max(1), z[:, :-2, 2 * FILTERS :].max(1)], 1)
        logits = np.maximum(h, 0) @ tables["dense"] + tables["out"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        out.append(q / q.sum(1, keepdims=True))
    return np.concatenate(out)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Network | None:
    """A network fitted on windows of at most `sample` rows of docs (doc_id, text, lang), as many of each language, or one
    of each if there are more languages; None without any such row. Rows with a null or empty text or a null language are
    left out. Rows are chosen by a hash of doc_id, so copies of a text come no more often than other rows."""
    able = docs.where("lang is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    each = stored(able.groupBy("lang").agg(F.count("*").alias("n")))
    quota = max(1, sample // max(1, each.count()))
    order = F.xxhash64("doc_id", F.lit(6))
    #: About twice the quota by hash, then the first of these: no task sees more of a language.
    near = able.join(each, "lang").where(F.pmod(order, F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000 * (2 * quota + 20)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", F.crc32("text")))
    able = near.withColumn("place", place).where(F.col("place") <= quota).select("text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            langs = batch.column(1).to_pylist()
            got = []
            for t, lang in zip(texts, langs):
                n = -(-len(t) // WINDOW)
                for k in range(min(n, PER_TEXT)):  # any window may come, wherever it stands
                    at = zlib.crc32(t + bytes([k])) % n * WINDOW
                    got.append((t[at : at + WINDOW].ljust(WINDOW, b"\0"), lang))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], ["window", "lang"])

    rows = able.mapInArrow(cut, "window binary, lang string").orderBy(F.xxhash64("window"), "window", "lang").collect()  # bounded by `sample`
    discard(each)
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    net = Network(languages)
    x = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    net.fit(x, np.array([languages.index(r["lang"]) for r in rows]), epochs)
    return net


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    tables = docs.sparkSession.sparkContext.broadcast((net.folded(), net.languages) if net else None)  # about 20 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(text)
            best, score = np.zeros(len(text), np.int64), np.zeros(len(text))
            if tables.value:
                for a, b in slices(offsets, 1_000_000):
                    x, doc, used = windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if len(x):
                        q = probabilities(tables.value[0], x) * used[:, None]
                        mean = np.zeros((b - a, q.shape[1]))
                        np.add.at(mean, doc, q)
                        mean /= np.maximum(1, np.diff(offsets[a : b + 1]))[:, None]
                        best[a:b], score[a:b] = mean.argmax(1), mean.max(1)
            known = lettered & bool(tables.value)
            names = np.array([*(tables.value[1] if tables.value else []), UNKNOWN], dtype=object)
            lang = names[np.where(known, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of doc_id as text mod 4 is 2), lang_pred and score.

    Only rows that are not held out and have a text and a language are learnt from; lang is read for nothing else. A
    text that is null or has no letter is `und` with score 0, as is every text where nothing can be learnt. Repeated
    rows are predicted one by one; a null doc_id is not held out. Whole texts count, however long. An empty table gives
    no rows."""
    net = trained(docs.where(~held_out()), sample)
    out = predicted(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
