"""Continuous forms: the same transforms over streams, with watermarks where they keep state.

Every function takes a streaming DataFrame and returns one; drained() runs such a query over what there is, and stops.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.functions import text as X
from lodestone.functions.rows import once
from lodestone.operators import detect as D
from lodestone.operators import validate as V
from lodestone.sources.scratch import scratch

LATE = "1 hour"


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a streaming query over all that its source holds (AvailableNow) and reads what it wrote. In complete mode
    the rows are those of the last batch; in update mode, each key's (columns `keys`) are those of the last batch that
    held it."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("__batch", IntegerType())])
    out = spark.read.schema(schema).parquet(f"{base}/out")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("__batch").alias("__batch"))), "__batch", "left_semi")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct("__batch", *rest), "__batch").alias("x")).select(*keys, "x.*")
    return out.drop("__batch")


def scored(stream: DataFrame) -> DataFrame:
    """Adds the score and the number of references to each content as it comes."""
    told = once(stream, __found=D.violations(F.col("text")), __held=X.placeholder_count(F.col("text")))
    told = once(told, refs=F.size("__found"))
    return told.withColumn("score", V.score_of(F.length("text"), F.col("__held"), F.col("refs"))).select(*stream.columns, "score", "refs")


def write_scores(batch: DataFrame, folder: str, number: int) -> None:
    """A foreachBatch sink: scores, history and what must be quarantined, each a table; a batch overwrites its own."""
    told = scored(batch).persist()
    told.select("doc_id", "score").write.mode("overwrite").parquet(f"{folder}/scores/batch={number}")
    told.select("doc_id", "score", F.lit(number).alias("version")).write.mode("overwrite").parquet(f"{folder}/history/batch={number}")
    told.where("score < 0.8").select("doc_id", "score", "refs").write.mode("overwrite").parquet(f"{folder}/quarantine/batch={number}")
    told.unpersist()


def quarantined(stream: DataFrame, ts: str = "ts", key: str = "doc_id", least: float = 0.8) -> DataFrame:
    """Contents that score too low, one row a key within the watermark."""
    return scored(stream).where(F.col("score") < least).withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key])


def rollup(stream: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Events, errors and values by tumbling or sliding window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", LATE).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("max_value")).select(F.col("w.start").alias("start"), "n", "errors", "max_value")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity by user and session, a session ending after a gap."""
    return stream.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def activity(stream: DataFrame) -> DataFrame:
    """Counts by user and kind, to be updated."""
    return stream.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_activity"))


def pattern_counts(stream: DataFrame) -> DataFrame:
    """Counts of placeholders learnt from contents, to be upserted."""
    return stream.select(F.explode(X.placeholders(F.col("text"))).alias("placeholder")).groupBy("placeholder").agg(F.count("*").alias("n"))


def alerts(stream: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition holds, as they come."""
    return stream.where(condition)


def append_changes(stream: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """An audit log that only grows: each batch of (key, seq, columns) is held against the latest state in the log, and
    what differs is appended as one row a change. A batch that is run again overwrites its own part."""
    from lodestone.operators.views import snapshot_diff

    spark, schema = stream.sparkSession, stream.select(key, *columns).schema

    def put(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.max_by(F.struct(*columns), "seq").alias("x")).select(key, "x.*")
        log = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).option("recursiveFileLookup", False).parquet(f"{path}/batch=*") if number else spark.createDataFrame([], StructType([*schema.fields, StructField("batch", IntegerType())]))
        old = log.where(F.col("batch") < number).groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("x")).select(key, "x.*")
        old = old.join(new.select(key), key, "left_semi")
        told = snapshot_diff(old, new, key, columns).join(new, key)
        told.select(key, *columns, "operation", F.array_join("changed", ",").alias("changed"), F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()


def scheduled_decay(spark: SparkSession, read_rows, config: DataFrame, as_of: Column, path: str, runs: int = 1) -> None:
    """The runs that a schedule starts, one after another: each reads the rows, decays them and writes the table anew
    under its own number, so that a run that is started again overwrites itself."""
    from lodestone.operators.views import decay_batch

    rows = read_rows()
    for number in range(runs):
        done = decay_batch(rows, config, as_of)
        kept = [c for c in rows.columns if c != "weight"]
        done.select(*kept, F.col("applied").alias("weight"), "action").write.mode("overwrite").parquet(f"{path}/run={number}")
        rows = spark.read.parquet(f"{path}/run={number}").select(*rows.columns)


class Bucket:
    """Tokens that fill up with time: `rate` a second up to `size`."""

    def __init__(self, rate: float, size: float, tokens: float | None = None, last: float | None = None):
        self.rate, self.size, self.tokens, self.last = rate, size, size if tokens is None else tokens, last

    def admit(self, seconds: float) -> bool:
        if self.last is not None:
            self.tokens = min(self.size, self.tokens + max(0.0, seconds - self.last) * self.rate)
        self.last = seconds
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


#: State of a key is dropped so many milliseconds of event time after its last row; a bucket is long full again by then.
IDLE = 7 * 86_400_000


def until_idle(state: GroupState, rows: pd.DataFrame) -> None:
    state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + IDLE)


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """What a batch holds of one key, by time: frames cut a key's rows anywhere. Bounded by what a batch admits of a key."""
    whole = pd.concat([f[columns] for f in frames], ignore_index=True)
    return whole.sort_values(["ts", "event_id"], ignore_index=True)


def seconds(ts: pd.Series) -> np.ndarray:
    """Each time as Timestamp.timestamp() tells it, to the microsecond."""
    return np.where(ts.isna(), np.nan, ts.to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6)


ADMITTED = "event_id long, user_id long, admitted boolean"


def admitted(stream: DataFrame, rate: float, size: float) -> DataFrame:
    """event_id, user_id and whether a bucket a user admits the event, in the order of time within a batch; the state is
    two numbers a user, until it is idle. Rows later than the watermark are dropped."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(rate, size, *state.get) if state.exists else Bucket(rate, size)
        pdf = in_order(frames, ["event_id", "user_id", "ts"])
        ok = [bucket.admit(t.timestamp()) for t in pdf["ts"]]
        state.update((bucket.tokens, bucket.last))
        until_idle(state, pdf)
        yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "admitted": ok})

    return stream.withWatermark("ts", LATE).groupBy("user_id").applyInPandasWithState(step, ADMITTED, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def admitted_batch(events: DataFrame, rate: float, size: float) -> DataFrame:
    """The same over a table: sorted partitions stream through, with one bucket at a time in memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, bucket = None, None
        for pdf in frames:
            ok = []
            for u, t in zip(pdf["user_id"], pdf["ts"]):
                if bucket is None or u != user:
                    user, bucket = u, Bucket(rate, size)
                ok.append(bucket.admit(t.timestamp()))
            yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "admitted": ok})

    ordered = events.select("event_id", "user_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(run, ADMITTED)


def smoothed_threshold(stream: DataFrame, k: int = 5, least: float = 1.0) -> DataFrame:
    """user_id, event_id, threshold: the mean of a user's last k values, told when it moves by more than `least`."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, told = state.get if state.exists else ([], None)
        last, rows = list(last), []
        pdf = in_order(frames, ["event_id", "ts", "value"])
        for e, v in pdf[["event_id", "value"]].itertuples(index=False):
            last = [*last, float(v)][-k:]
            mean = reduce(add, last) / len(last)  # as a window's mean adds; sum() would compensate, and so tell ties apart otherwise
            if told is None or abs(mean - told) > least:
                told = mean
                rows.append((key[0], e, mean))
        state.update((last, told))
        until_idle(state, pdf)
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "threshold"])

    return stream.withWatermark("ts", LATE).groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, threshold double", "last array<double>, told double", "append", GroupStateTimeout.EventTimeTimeout)


def scan_queue(stream: DataFrame, most: int = 3) -> DataFrame:
    """item, status, retries of a queue of scan results (item, ok, ts, event_id), in the order of time: done at the first
    success, failed after `most` failures, else pending."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, retries = state.get if state.exists else ("pending", 0)
        pdf = in_order(frames, ["ok", "ts", "event_id"])
        for ok in pdf["ok"]:
            if status == "pending":
                status, retries = ("done", retries) if ok else ("failed" if retries + 1 >= most else "pending", retries + 1)
        state.update((status, retries))
        until_idle(state, pdf)
        yield pd.DataFrame({"item": [key[0]], "status": [status], "retries": [retries]})

    return stream.withWatermark("ts", LATE).groupBy("item").applyInPandasWithState(step, "item long, status string, retries int", "status string, retries int", "update", GroupStateTimeout.EventTimeTimeout)


class Shard:
    """One shard of a cache: entries (key, put at) from the one used longest ago to the last one used. A request takes the
    same few steps however many entries there are."""

    def __init__(self, size: int, ttl: float, entries: list[tuple[str, float]] = ()):
        self.size, self.ttl, self.entries = size, ttl, OrderedDict(entries)

    def ask(self, key: str, seconds: float) -> tuple[str, int]:
        """What a request finds (hit, miss or expired; the last two put the key in anew) and how many keys it evicts."""
        put = self.entries.pop(key, None)
        found = "miss" if put is None else "expired" if seconds > put + self.ttl else "hit"
        self.entries[key] = put if found == "hit" else seconds
        evicted = max(0, len(self.entries) - self.size)
        for _ in range(evicted):
            self.entries.popitem(last=False)
        return found, evicted


def cache_requests(stream: DataFrame, ttl_seconds: float, capacity: int, shards: int = 64) -> DataFrame:
    """event_id, key, found (hit, miss, expired) and evicted of each request (event_id, key, ts) to a cache of `capacity`
    keys that live `ttl_seconds` of event time from when they are put in; a full one gives up the key used longest ago.

    The cache is dealt into shards by the key's hash, each of capacity / shards keys: a shard's state is bounded by that,
    whatever the number of keys or requests, and shards are the parallelism. Requests are taken in the order of time
    within a batch; those later than the watermark, and those without a key, are dropped."""
    size = -(-capacity // shards)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        shard = Shard(size, ttl_seconds, list(zip(*state.get)) if state.exists else [])
        pdf = in_order(frames, ["event_id", "key", "ts"])
        found = [shard.ask(k, t) for k, t in zip(pdf["key"].tolist(), seconds(pdf["ts"]).tolist())]
        state.update((list(shard.entries), list(shard.entries.values())))
        until_idle(state, pdf)
        yield pd.DataFrame({"event_id": pdf["event_id"], "key": pdf["key"], "found": [x for x, _ in found], "evicted": [n for _, n in found]})

    told = stream.where("key is not null").withWatermark("ts", LATE).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    told = told.select("shard", "event_id", "key", "ts")  # other columns would be shuffled and go to Python as well
    return told.groupBy("shard").applyInPandasWithState(step, "event_id long, key string, found string, evicted int", "keys array<string>, put array<double>", "append", GroupStateTimeout.EventTimeTimeout)


#: Priority by safety score (below, priority), else the last; scored so high and validated, nothing is scanned.
PRIORITIES, PRIORITY, SAFE = ((0.85, 8), (0.9, 6)), 5, 0.95
QUEUE = "item long, priority int, queued_at timestamp, due_at timestamp, status string, retries int"


def queued(contents: DataFrame) -> DataFrame:
    """Arrivals (item, priority, ts) of contents (item, score, validated, ts): the lower the score, the more urgent."""
    rank = F.lit(PRIORITY)
    for below, value in reversed(PRIORITIES):
        rank = F.when(F.col("score") < below, value).otherwise(rank)
    skip = F.coalesce(F.col("validated") & (F.col("score") >= SAFE), F.lit(False))
    return contents.where(~skip).select("item", rank.alias("priority"), "ts")


def queue_cycle(state: DataFrame, arrivals: DataFrame, ok: Column, now: Column, batch: int = 100, most: int = 3, wait: str = "5 minutes") -> DataFrame:
    """A scan queue after one cycle: (item, priority, queued_at, due_at, status, retries), one row an item.

    Arrivals (item, priority, ts) of items that aren't pending enter the queue, those that are pending keep their place
    with the greater priority. Of the pending items that are due, the `batch` of the highest priority that have waited
    longest are scanned: one more try each, `ok` (a condition on item and retries, which counts this try) tells how it
    ends. A failure is due again after `wait`; after `most` tries it has failed. Only the top rows go to one task."""
    new = arrivals.groupBy("item").agg(F.max("priority").cast("int").alias("p"), F.min("ts").alias("t"))
    both = state.join(new, "item", "full_outer")
    open_ = F.col("status").eqNullSafe("pending")
    enters = F.col("p").isNotNull() & ~open_
    merged = both.select(
        "item",
        F.when(enters, F.col("p")).when(open_, F.greatest("priority", "p")).otherwise(F.col("priority")).alias("priority"),
        F.when(enters, F.col("t")).otherwise(F.col("queued_at")).alias("queued_at"),
        F.when(enters, F.col("t")).otherwise(F.col("due_at")).alias("due_at"),
        F.when(enters, F.lit("pending")).otherwise(F.col("status")).alias("status"),
        F.when(enters, F.lit(0)).otherwise(F.col("retries")).alias("retries"),
    )
    due = merged.where((F.col("status") == "pending") & (F.col("due_at") <= now)).orderBy(F.desc("priority"), "queued_at", "item").limit(batch)
    tried = due.select("item", (F.col("retries") + 1).alias("retries"))
    done = tried.select("item", F.col("retries").alias("tries"), ok.alias("ok"))
    joined = merged.join(F.broadcast(done), "item", "left")  # `batch` rows at most
    scanned = F.col("tries").isNotNull()
    status = F.when(scanned, F.when(F.col("ok"), "completed").when(F.col("tries") >= most, "failed").otherwise("pending")).otherwise(F.col("status"))
    due_at = F.when(scanned & ~F.col("ok") & (F.col("tries") < most), now + F.expr(f"interval {wait}")).otherwise(F.col("due_at"))
    return joined.select("item", F.col("priority").cast("int").alias("priority"), "queued_at", due_at.alias("due_at"), status.alias("status"), F.coalesce("tries", "retries").cast("int").alias("retries"))


def run_queue(stream: DataFrame, path: str, ok: Column, batch: int = 100, most: int = 3, wait: str = "5 minutes", trigger: dict | None = None) -> None:
    """Runs the queue over a stream of arrivals (item, priority, ts): every micro-batch is a cycle at the latest time that
    the stream has come to, and writes the queue's state under its own number, so a batch that is run again overwrites
    itself. With trigger={"processingTime": "5 minutes"} it is the queue's schedule; else it runs what there is."""
    spark = stream.sparkSession

    def cycle(rows: DataFrame, number: int) -> None:
        old = spark.read.schema(f"{QUEUE}, now timestamp").parquet(f"{path}/cycle={number - 1}") if number else spark.createDataFrame([], f"{QUEUE}, now timestamp")
        latest = rows.agg(F.max("ts").alias("t")).first()["t"]
        before = old.agg(F.max("now").alias("t")).first()["t"]
        now = max((t for t in (latest, before) if t is not None), default=None)
        new = queue_cycle(old.drop("now"), rows, ok, F.lit(now).cast("timestamp"), batch, most, wait)
        new.withColumn("now", F.lit(now).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/cycle={number}")

    writer = stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(**(trigger or {"availableNow": True}))
    running = writer.foreachBatch(cycle).start()
    if not trigger:
        running.awaitTermination()


def queue_state(spark: SparkSession, path: str) -> DataFrame:
    """The queue after its last cycle."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cycle=*")
    found = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files)
    last = max((int(f.getPath().getName().split("=")[1]) for f in found or []), default=None)
    return spark.createDataFrame([], QUEUE) if last is None else spark.read.schema(QUEUE).parquet(f"{path}/cycle={last}")
