"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

A text's distinct word shingles are hashed once; the hash range is cut into bins, and the least hash of a bin is one
component of the signature. An empty bin takes the component of another bin, found by hashing (bin, attempt) until a
filled one comes up (optimal densification). `BANDS` runs of `ROWS` components are bucket keys. A bucket of n texts
gives n - 1 candidate edges, all to one centre, and each edge is confirmed on the full shingle sets.

Texts with the same shingle set are one class before that, and only classes get keys. A centre may fail with a text that
another text of the bucket would link with. So the buckets that still hold more than one component after the stars are
settled exactly: their members meet in families (texts joined by such buckets) or, where that is less work, bucket by
bucket. A family is cut into blocks of bounded size; each pair of blocks is one group, whose intersections are matrix
products, and only a spanning forest of its links leaves the group. In the end every two texts that share a bucket are
of one component or were compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, components, discard, lean, mix, ragged, rooted, shingles, slices, stored, text_buffer

ROWS, BANDS = 6, 50  # a pair of similarity 0.8 shares no bucket with probability (1 - 0.8 ** 6) ** 50 = 2.5e-7
SIMILARITY_PERCENT, SHINGLE_WORDS = 80, 5
#: A block of a family or bucket holds about so many texts, and about so many shingles, at most.
BLOCK, BLOCK_SHINGLES = 512, 250_000


def signatures(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One row of `bins` components per text. Hashes are sorted within a text; a text without any gets zeros."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    at = ((hashes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    key = doc * bins + at
    least = np.ones(len(key), bool)
    least[1:] = key[1:] != key[:-1]
    out, filled = np.zeros(n * bins, U64), np.zeros(n * bins, bool)
    out[key[least]], filled[key[least]] = hashes[least], True
    some = np.repeat(np.diff(offsets) > 0, bins)
    empty, attempt = np.flatnonzero(~filled & some), 0
    while len(empty):
        attempt += 1
        bin_of = empty % bins
        probe = ((mix(np.arange(bins, dtype=U64) + U64(attempt) * U64(1 << 20)) >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
        source = empty - bin_of + probe[bin_of]
        got = filled[source]
        out[empty[got]] = out[source[got]]
        empty = empty[~got]
    return out.reshape(n, bins)


def sketches(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """Columns doc_id, h, n_shingles, fp1, fp2 (fingerprint of the set) and keys (bucket keys; empty without shingles).
    docs: doc_id, h, text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in slices(offsets):
                h, at = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                size = np.diff(at)
                sums = [np.concatenate([[U64(0)], np.cumsum(x, dtype=U64)]) for x in (mix(h), mix(h ^ U64(0x5851F42D4C957F2D)))]
                fp = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                sig = signatures(h, at, rows * bands).reshape(b - a, bands, rows)
                key = np.zeros((b - a, bands), U64) + np.arange(bands, dtype=U64)
                for r in range(rows):
                    key = mix(key ^ sig[:, :, r])
                key = key[size > 0].view(np.int64)
                ends = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)
                own = [batch.column(i).slice(a, b - a) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(fp[0]), pa.array(fp[1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(key.ravel()))], ["doc_id", "h", "n_shingles", "fp1", "fp2", "keys"])

    return docs.select("doc_id", "h", "text").mapInArrow(lean(sketch), "doc_id long, h long, n_shingles long, fp1 long, fp2 long, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. texts: rep, text."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [text_buffer(batch.column(i)) for i in (2, 3)]
            keep = np.zeros(batch.num_rows, bool)
            for low, high in slices(both[0][1] + both[1][1]):  # bounded by the bytes of both texts
                (ha, oa), (hb, ob) = (shingles(data[at[low] : at[high]], at[low : high + 1] - at[low], width) for data, at in both)
                for i in range(high - low):
                    x, y = ha[oa[i] : oa[i + 1]], hb[ob[i] : ob[i + 1]]
                    if len(x) and len(y):
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        common = int(np.count_nonzero(y[at] == x))
                        keep[low + i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    left, right = (texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b"))
    named = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    return named.select("a", "b", "text_a", "text_b").mapInArrow(lean(compare), "a long, b long")


def stars(bucket: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b): each bucket's centre with the other members whose set sizes allow the similarity."""
    near = f"100 * least(n_shingles, centre.n_shingles) >= {percent} * greatest(n_shingles, centre.n_shingles)"
    pairs = bucket.join(centres, "key").where(f"rep <> centre.rep and {near}")
    return pairs.select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b")).distinct()


def groups(left: DataFrame) -> DataFrame:
    """(kind, id, rep, comp, slot, blocks): the members of unsettled buckets, gathered in families, or in their buckets
    where these make fewer rows. left: key, rep, comp, n_shingles."""
    least = left.groupBy("key").agg(F.min("rep").alias("m"))
    links = stored(left.join(least, "key").where("rep <> m").select(F.col("rep").alias("a"), F.col("m").alias("b")).distinct())
    family = stored(components(links))
    discard(links)

    def blocks(n: str, shingles: str) -> str:
        return f"greatest(ceil({n} / {BLOCK}), ceil({shingles} / {BLOCK_SHINGLES}))"

    member = stored(left.join(family.withColumnRenamed("node", "rep"), "rep"))
    one = member.select("component", "rep", "comp", "n_shingles").distinct()
    size = one.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    size = size.select("component", F.expr(blocks("n", "s")).alias("blocks"), F.expr(f"n * {blocks('n', 's')}").alias("rows"))
    each = member.groupBy("component", "key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).withColumn("own", F.expr(blocks("n", "s")))
    whole = stored(each.groupBy("component").agg(F.sum(F.expr("n * own")).alias("apart")).join(size, "component").withColumn("together", F.expr("rows <= apart")))
    as_family = one.join(whole.where("together"), "component").select(F.lit(0).alias("kind"), F.col("component").alias("id"), "rep", "comp", "blocks")
    apart = whole.where("not together").select("component")
    as_bucket = member.join(apart, "component").join(each.select("component", "key", "own"), ["component", "key"])
    both = as_family.unionByName(as_bucket.select(F.lit(1).alias("kind"), F.col("key").alias("id"), "rep", "comp", F.col("own").alias("blocks")))
    out = stored(both.withColumn("slot", F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    for table in (family, member, whole):
        discard(table)
    return out


def settled(left: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of the unsettled buckets' members as all links between them would."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets):
                h, at = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["rep", "hashes"])

    def compare(group: pa.Table) -> pa.Table:
        comp, slot = (group[c].to_numpy() for c in ("comp", "slot"))
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        one, two = np.flatnonzero(slot == low), np.flatnonzero(slot == high)
        flat, ends = ragged(group["hashes"])
        common = intersections(flat, ends, one, two)
        size = np.diff(ends)
        union = size[one][:, None] + size[two][None] - common
        i, j = np.nonzero((100 * common >= percent * union) & (comp[one][:, None] != comp[two][None]))
        a, b = rooted(comp[one[i]], comp[two[j]])  # a component is named by one of its nodes
        return pa.table({"a": a[a != b], "b": b[a != b]})

    member = groups(left)
    known = texts.join(member.select("rep").distinct().hint("merge"), "rep", "left_semi").mapInArrow(lean(sets), "rep long, hashes array<long>")
    cells = member.select("kind", "id", "rep", "comp", "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("kind", "id", "rep", "comp", "slot", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"))
    found = cells.hint("merge").join(known, "rep").groupBy("kind", "id", "low", "high").applyInArrow(compare, "a long, b long")
    out = stored(found.distinct())
    discard(member)
    return out


def intersections(flat: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets `one` with the sets `two`, by products of 0/1 matrices over the elements
    that several sets hold, some columns at a time."""
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    shared = count[at] > 1
    number = np.cumsum(count > 1) - 1
    order = np.argsort(at[shared], kind="stable")
    column, owner = number[at[shared]][order], owner[shared][order]
    out = np.zeros((len(one), len(two)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [a, a + columns])
        x = np.zeros((len(ends) - 1, columns), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        out += x[one] @ x[two].T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept
    (doc_id = component_id) and h (hash of the text; null for null).

    Null or empty text, or one without words, has an empty set and links with nothing. Rows that repeat a doc_id with
    another text are documents of their own, which may fall into different components. A null doc_id links with nothing
    and is kept. Only doc_id and text are read, whatever else there is. An empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("h"), F.col("text").cast("string").alias("text"))
    sketched = stored(sketches(docs, width, rows, bands))
    sets = ["n_shingles", "fp1", "fp2"]
    filled = sketched.where("n_shingles > 0 and doc_id is not null")
    #: Equal sets have equal keys; `shown` names a row that has the set. The number of a class says nothing else.
    classes = filled.groupBy(*sets).agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("shown"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()))
    bands_of = stored(classes.select(F.explode("keys").alias("key"), "rep", "n_shingles"))
    shared = bands_of.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bucket = stored(bands_of.join(shared, "key"))  # only what meets another text
    discard(bands_of)
    meeting = bucket.select("rep").distinct()
    shown = classes.select("rep", F.col("shown.doc_id").alias("doc_id"), F.col("shown.h").alias("h")).join(meeting, "rep")
    texts = stored(docs.join(shown.hint("merge"), ["doc_id", "h"]).select("rep", "text").dropDuplicates(["rep"]))

    centre = bucket.groupBy("key").agg(F.min(F.struct("rep", "n_shingles")).alias("centre"))
    links = stored(confirmed(stars(bucket, centre, percent), texts, width, percent))
    comp = stored(components(links))
    rest = bucket.join(centre, "key").where("rep <> centre.rep").join(comp, F.col("rep") == F.col("node"), "left")
    rest = rest.select("key", "rep", F.coalesce("component", "rep").alias("comp"), "n_shingles")
    split = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = stored(rest.join(split, "key"))
    if not left.isEmpty():
        more = settled(left, texts, width, percent)
        both = stored(components(links.unionByName(more)))
        discard(more)
        discard(comp)
        comp = both
    least = comp.join(classes.select("rep", "least"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("least").alias("component_id"))
    least = stored(comp.join(least, "component").select("node", "component_id"))
    reached = stored(classes.join(least, F.col("rep") == F.col("node"), "left").select(*sets, F.coalesce("component_id", "least").alias("component_id")))
    for table in (classes, bucket, texts, links, comp, left, least):
        discard(table)
    out = sketched.drop("keys").join(reached, sets, "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "h")


def text_hash(text: Column) -> Column:
    """What tells texts of one doc_id apart; null for null."""
    return F.when(text.isNotNull(), F.xxhash64(text.cast("string")))


def without_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row of docs, with all its columns, of each group of near-duplicates: that of the smallest doc_id, and of its
    texts, if it has several in the group, that of the smallest hash. Rows without words all stay but for those that
    repeat a doc_id and text; of such rows the one stays whose other columns come first in order."""
    found = near_duplicates(docs, width, percent).where("kept")
    alone = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.coalesce("h", F.lit(0)))
    kept = found.groupBy("doc_id", alone.alias("alone"), (F.col("n_shingles") == 0).alias("bare")).agg(F.min("h").alias("h"))
    names = {"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__h": F.coalesce("h", F.lit(0)), "__bare": F.col("h").isNull()}
    kept = kept.select(*[c.alias(n) for n, c in names.items()]).hint("merge")  # one plan at every size
    id_of = F.col("doc_id").cast("long")
    mine = {"__id": F.coalesce(id_of, F.lit(0)), "__none": id_of.isNull(), "__h": F.coalesce(text_hash(F.col("text")), F.lit(0)), "__bare": F.col("text").isNull()}
    left = docs.select(*docs.columns, *[c.alias(n) for n, c in mine.items()]).join(kept, list(names), "left_semi")
    others = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy(*names).orderBy(*others or [F.lit(0)])
    return left.withColumn("__place", F.row_number().over(first)).where("__place = 1").select(*docs.columns)
