"""Toxicity of texts that may be disguised: a noisy-channel decoder, then a scorer of the restored words.

Language model: counts of three characters in a row over the plain words of all documents; one table of 64 ** 3 cells,
whatever the corpus. Channel: what may stand for what. A suspicious token (a digit or sign before or after a letter,
letters and signs between separators, a letter three times running, a doubled letter that reads likelier as one, or four
single letters and signs in a row in one text), and what stands between other characters in it, becomes a lattice over its whole length, in which a sign may be a letter or nothing, a run of one letter may be one or two, and a blank between single letters may be a word's
end or nothing. Viterbi finds the likeliest reading; its words are scored like the plain ones.

Scorer: units are whole words and prefixes of PREFIXES bytes. It is fitted on at most SAMPLE labelled rows. Units go
into the model one at a time: the pure one (at least PURITY of its texts toxic) that explains most toxic texts not
explained yet, until none explains NEW of them. So words that merely stand in copies of one toxic text stay out.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, U64, discard, lean, mix, slices, stored, text_buffer

PREFIXES, SUPPORT, NEW, PURITY = (4, 5, 6, 7), 3, 2, 0.7
SAMPLE, UNITS, LONGEST, MEMO = 40_000, 20_000, 40, 200_000

#: Signs and the letters they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SEPARATORS = ".-_*~"
#: Costs of the channel, as negative log probabilities.
SIGN, SIGN_DROP, DROP, COLLAPSE, BREAK = 0.7, 6.0, 1.0, 0.3, 0.5

_ALPHABET = np.zeros(256, np.int64)  # 0: not part of a word
_ALPHABET[97:123] = np.arange(1, 27)
_ALPHABET[128:] = 27 + np.arange(128) % 37
_LETTER = _ALPHABET > 0
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_WHOLE = U64(0xC2B2AE3D27D4EB4F)


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def lowered(column: pa.Array, most: int = 250_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a column of texts, of at most `most` bytes or one row, and their lower-case bytes with offsets."""
    for a, b in slices(text_buffer(column)[1], most):
        yield a, b, *text_buffer(lower(column.slice(a, b - a)))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends with its text."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | cut[:n])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of all words (words x (1 + prefixes); 0 where a word is too short) and each word's text."""
    starts, ends = runs(_LETTER[data], offsets) if len(data) else (np.zeros(0, np.int64),) * 2
    keep = ends - starts >= 3
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), U64), np.zeros(0, np.int64)
    at = np.arange(len(data))
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    place = np.minimum(at - begin, 255).astype(U64)
    total = np.concatenate([[U64(0)], np.cumsum(mix(_BYTE[data] + place * U64(0x9E3779B97F4A7C15)), dtype=U64)])
    out = np.zeros((len(starts), 1 + len(PREFIXES)), U64)
    out[:, 0] = mix((total[ends] - total[starts]) ^ _WHOLE)
    for k, n in enumerate(PREFIXES, 1):
        long = ends - starts >= n
        out[long, k] = mix(total[starts[long] + n] - total[starts[long]] + U64(n))
    return out, np.searchsorted(offsets, starts, "right") - 1


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(cell, n): how often three characters follow each other in the plain words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64**3, np.int64)
        for batch in batches:
            for _, _, data, _ in lowered(batch.column(0)):
                s = np.zeros(len(data) + 3, np.int64)
                s[2:-1] = _ALPHABET[data]
                cell = (s[:-2] * 64 + s[1:-1]) * 64 + s[2:]
                total += np.bincount(cell, minlength=64**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log probability of a character after two others, 64 x 64 x 64."""
    counts = np.full(64**3, 0.05)
    for row in trigram_counts(docs).toPandas().itertuples():  # at most 64 ** 3 rows
        counts[row.cell] += row.n
    counts = counts.reshape(64, 64, 64)
    return -np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32)


class Decoder:
    """The likeliest reading of a suspicious token, with a bounded memo of those of up to LONGEST characters."""

    def __init__(self, model: np.ndarray):
        self.model, self.memo = model, {}

    def words(self, token: str) -> list[str]:
        if len(token) > LONGEST:
            return self._decode(token).split()
        if token not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = self._decode(token).split()
        return self.memo[token]

    def _arcs(self, token: str) -> list[list[tuple[str, float]]]:
        """Per step of the lattice, the readings of a character or run and their costs."""
        arcs, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            run = j - i
            if c == " ":
                arcs.append([("", DROP / 2), (" ", BREAK)])
            elif c in LEET:
                arcs.append([(x * k, SIGN * k) for x in LEET[c] for k in ((1, 2) if run > 1 else (1,))] + [("", SIGN_DROP * run)])
            elif c.isalpha():
                arcs.append([(c, COLLAPSE * (run > 1)), *([(c + c, 0.0)] if run > 1 else [])])
            else:
                arcs.append([("", DROP if c in SEPARATORS else 0.0), *([(" ", BREAK)] if c not in SEPARATORS else [])])
            i = j
        return arcs

    def _decode(self, token: str) -> str:
        model = self.model
        best = {(0, 0): (0.0, 0, None)}  # cost, a number that settles ties, and the readings, last one first
        for arcs in [*self._arcs(token), [(" ", 0.0)]]:
            new: dict = {}
            for (a, b), (cost, _, path) in best.items():
                for reading, price in arcs:
                    x, y, total = a, b, cost + price
                    for byte in reading.encode():
                        z = int(_ALPHABET[byte])
                        total += model[x, y, z]
                        x, y = (0, 0) if z == 0 else (y, z)
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, len(new), (path, reading) if reading else path)
            best = new
        path, out = min(best.values(), key=lambda v: v[:2])[2], []
        while path:
            path, reading = path
            out.append(reading)
        return "".join(reversed(out))


def suspicious(data: np.ndarray, offsets: np.ndarray, model: np.ndarray | None = None) -> list[tuple[int, str]]:
    """(text, token) of the tokens to be decoded. Doubled letters are weighed by the language model, where there is one."""
    n = len(data)
    if n < 3:
        return []
    starts, ends = runs(~_BLANK[data], offsets)
    if not len(starts):
        return []
    letter, sign, separator = _LETTER[data], _SIGN[data], _SEPARATOR[data]
    either = letter | sign
    reach = np.repeat(ends, np.diff(np.append(starts, n)))  # where the token of a byte ends; a mark ends with its token
    reach = np.concatenate([np.zeros(starts[0], np.int64), reach])
    marks = [np.flatnonzero(((sign[:-1] & letter[1:]) | (letter[:-1] & sign[1:])) & (reach[:-1] > np.arange(1, n)))]
    marks.append(np.flatnonzero(letter[:-2] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]) & (data[:-2] < 128) & (reach[:-2] > np.arange(2, n))))
    if model is not None:  # a b b c against a b c: the letters before and after are the same, so this settles a lone pair
        two = np.flatnonzero(letter[:-1] & (data[:-1] == data[1:]) & (data[:-1] < 128) & (reach[:-1] > np.arange(1, n)))
        code = _ALPHABET[data]
        before = np.where((two > 0) & (reach[np.maximum(two - 1, 0)] == reach[two]), code[np.maximum(two - 1, 0)], 0)
        after = np.where(two + 2 < reach[two], code[np.minimum(two + 2, n - 1)], 0)
        own = code[two]
        marks.append(two[model[before, own, own] + model[own, own, after] > COLLAPSE + model[before, own, after]])
    words = len(marks)
    if n > 4:
        marks.append(np.flatnonzero(either[:-4] & separator[1:-3] & either[2:-2] & separator[3:-1] & either[4:] & (letter[:-4] | letter[2:-2] | letter[4:]) & (reach[:-4] > np.arange(4, n))))
    token = np.unique(np.searchsorted(starts, np.concatenate(marks), "right") - 1)
    doc = np.searchsorted(offsets, starts, "right") - 1
    length = ends - starts
    out = [(int(doc[t]), data[starts[t] : ends[t]].tobytes().decode("utf8", "ignore")) for t in token]
    left, right = runs(either, offsets)  # a word that other signs join to others is read by itself, too
    own = np.unique(np.searchsorted(left, np.concatenate(marks[:words]), "right") - 1)
    own = own[(right[own] - left[own] >= 3) & (right[own] - left[own] < length[np.searchsorted(starts, left[own], "right") - 1])]
    out += [(int(d), data[left[t] : right[t]].tobytes().decode("utf8", "ignore")) for d, t in zip(np.searchsorted(offsets, left[own], "right") - 1, own)]
    first = data[starts]
    single = either[starts] & (length == 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0))  # one character, of up to four bytes
    for a, b in zip(*runs(single, np.searchsorted(starts, offsets))):  # a run ends with its text
        if b - a >= 4 and letter[starts[a:b]].any():
            own = [data[x:y].tobytes().decode("utf8", "ignore") for x, y in zip(starts[a:b], ends[a:b])]
            if len(set(own)) > 1:
                out.append((int(doc[a]), " ".join(own)))
    return out


def in_training(doc_id, of: int = 5, held: int = 0):
    return F.crc32(F.col(doc_id).cast("string")) % of != held


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The scorer: hashes and probabilities of its units, and the rate of toxic texts without any. labels: doc_id,
    toxic. Rows with a null label or text are left out."""
    able = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    most = (F.avg("toxic") >= 0.5).cast("int").alias("toxic")  # labels that differ: what most say, toxic in a tie
    able = able.groupBy("doc_id").agg(most)
    share = sample / max(1, able.count())
    if share < 1:  # bounded: expected size `sample`
        able = able.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = F.broadcast(able)  # bounded by `sample`
    texts = docs.where("text is not null").join(chosen, "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), most).select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in lowered(batch.column(2)):
                u, doc = units(data, offsets)
                own = [np.unique(u[doc == i]) for i in range(b - a)] if b - a < 4 else _per_text(u, doc, b - a)
                own = [x[x != 0] for x in own]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "toxic", "units"])

    rows = stored(texts.mapInArrow(lean(run), "doc_id long, toxic int, units array<long>"))
    each = rows.select("doc_id", "toxic", F.explode("units").alias("unit"))
    counts = each.groupBy("unit").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    pure = stored(counts.where((F.col("t") >= SUPPORT) & (F.col("t") >= PURITY * F.col("n"))))
    #: Bounded by `sample`: pure units are few, and of toxic texts only.
    held = each.where("toxic = 1").join(pure.select("unit"), "unit").select("doc_id", "unit").toPandas()
    known = pure.toPandas().set_index("unit")
    rate = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    discard(pure)
    discard(rows)
    of_unit: dict = defaultdict(set)
    for d, u in zip(held["doc_id"].tolist(), held["unit"].tolist()):
        of_unit[u].add(d)
    of_doc: dict = defaultdict(list)
    for u, own in of_unit.items():
        for d in own:
            of_doc[d].append(u)
    left = {u: len(own) for u, own in of_unit.items()}
    done, model = set(), []
    share = (known["t"] / known["n"]).to_dict()
    queue = [(-k, -share[u], -u) for u, k in left.items()]
    heapq.heapify(queue)
    while queue and len(model) < UNITS:
        k, _, u = queue[0]
        k, u = -k, -u
        if k < NEW:
            break
        if left[u] < k:  # texts have been explained meanwhile
            heapq.heapreplace(queue, (-left[u], -share[u], -u))
            continue
        heapq.heappop(queue)
        model.append(u)
        for d in of_unit[u] - done:
            done.add(d)
            for v in of_doc[d]:
                left[v] -= 1
    chosen_units = np.array(model, np.int64).view(U64)
    p = np.array([(known.at[u, "t"] + 0.5) / (known.at[u, "n"] + 1) for u in model])
    order = np.argsort(chosen_units)
    rest = ((rate["t"] or 0) - len(done) + 0.5) / (rate["n"] - len(done) + 1)
    return {"units": chosen_units[order], "p": p[order], "rest": float(min(0.49, max(0.001, rest)))}


def _per_text(u: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    cut = np.searchsorted(doc, np.arange(n + 1))
    return [np.unique(u[cut[i] : cut[i + 1]]) for i in range(n)]


def scorer(model: dict, language: np.ndarray):
    """A function from a batch's texts to their scores and numbers of toxic words."""
    decoder, last = Decoder(language), max(0, len(model["units"]) - 1)
    screen = np.zeros(1 << 20, bool)
    screen[(model["units"] & U64((1 << 20) - 1)).astype(np.int64)] = True

    def found(u: np.ndarray) -> np.ndarray:
        """The place in the model of each word's likeliest unit, or -1."""
        at = np.minimum(np.searchsorted(model["units"], u), last)
        p = np.where((model["units"][at] == u) & (u != 0), model["p"][at], -1.0)
        rows, k = np.arange(len(u)), p.argmax(1)
        return np.where(p[rows, k] > 0, at[rows, k], -1)

    def part(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        clean, toxic = np.ones(n), np.zeros(n, np.int64)
        if len(model["units"]) and len(data):
            u, doc = units(data, offsets)
            near = screen[(u & U64((1 << 20) - 1)).astype(np.int64)].any(1)
            pairs = [(doc[near], found(u[near]))]
            read = [(d, w.encode()) for d, t in suspicious(data, offsets, decoder.model) for w in decoder.words(t)]
            if read:
                v, owner = units(np.frombuffer(b"".join(w for _, w in read), np.uint8), np.concatenate([[0], np.cumsum([len(w) for _, w in read])]))
                pairs.append((np.array([d for d, _ in read])[owner], found(v)))
            who, what = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
            key = np.unique(who[what >= 0] * len(model["units"]) + what[what >= 0])
            d, k = key // len(model["units"]), key % len(model["units"])
            np.multiply.at(clean, d, 1 - model["p"][k])
            np.add.at(toxic, d, 1)
        return np.where(toxic > 0, 1 - clean, model["rest"]), toxic

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = [part(data, offsets) for _, _, data, offsets in lowered(texts)]
        return (np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own])) if own else (np.zeros(0), np.zeros(0, np.int64))

    return score


def scores(docs: DataFrame, model: dict, language: np.ndarray) -> DataFrame:
    """doc_id, score and the number of toxic words found, for each row of docs, in a given model."""
    shared = docs.sparkSession.sparkContext.broadcast((model, language))  # bounded: UNITS units, 64 ** 3 cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*shared.value)
        for batch in batches:
            values, toxic = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array(toxic)], ["doc_id", "score", "n_toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double, n_toxic long")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score under `limit`, with all their columns: one pass, no join. Otherwise as toxicity()."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((fitted(named, labels.where(in_training("doc_id")), sample), language_model(named)))
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(column))[0] < limit))

    return docs.mapInArrow(lean(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5) and n_toxic.

    Labels of rows whose crc32(doc_id as text) mod 5 is 0, and of null doc_ids, are never learnt from. Null and empty
    texts, and texts without a known unit, score the rate of toxic texts among those. Repeated rows are scored one by
    one, and a doc_id or text with labels that differ has the label that most give. Without labels nothing is toxic. Only doc_id and text of docs, and doc_id and toxic of labels, are read. An
    empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fitted(docs, labels.where(in_training("doc_id")), sample)
    scored = scores(docs, model, language_model(docs))
    held = F.coalesce(~in_training("doc_id"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic")
