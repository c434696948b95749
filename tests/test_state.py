"""The cache and the scan queue against plain ones, over streams of several micro-batches."""

import datetime
import random
import time
from collections import OrderedDict

from pyspark.sql import functions as F

from lodestone.streaming import jobs as S

START = datetime.datetime(2024, 1, 1)


def as_stream(spark, folder, batches, schema):
    """A stream of one file a micro-batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1 if k + 1 < len(batches) else 0)  # files are read by the time of their writing
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


class Plain:
    """A cache of so many keys by last use, whose entries expire."""

    def __init__(self, size, ttl):
        self.size, self.ttl, self.kept = size, ttl, OrderedDict()

    def ask(self, key, now):
        found = "miss"
        if key in self.kept:
            found = "expired" if now > self.kept[key] + self.ttl else "hit"
        if found == "hit":
            self.kept.move_to_end(key)
            return found, 0
        self.kept.pop(key, None)
        self.kept[key] = now
        evicted = 0
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)
            evicted += 1
        return found, evicted


def test_cache_equals_a_plain_one(spark, tmp_path):
    """Times apart by less and more than the time to live; more keys than there is room for; several shards and batches."""
    rng, batches, at, n = random.Random(1), [], 0, 0
    for _ in range(3):
        rows = []
        for _ in range(250):
            at += rng.choice([1, 5, 20, 100])
            rows.append((n, f"k{min(rng.randrange(40), rng.randrange(40))}", START + datetime.timedelta(seconds=at)))
            n += 1
        batches.append(rows)
    batches[1].append((9999, None, START))
    stream = as_stream(spark, str(tmp_path), batches, "event_id long, key string, ts timestamp")
    got = {r["event_id"]: (r["found"], r["evicted"]) for r in S.drained(S.cache_requests(stream, 600, 16, shards=4)).collect()}
    keys = {f"k{k}" for k in range(40)}
    shard = {r["key"]: r["s"] for r in spark.createDataFrame([(k,) for k in keys], "key string").select("key", F.pmod(F.xxhash64("key"), F.lit(4)).alias("s")).collect()}
    caches, want = {s: Plain(4, 600) for s in range(4)}, {}
    for rows in batches:
        for e, k, t in rows:
            if k is not None:
                want[e] = caches[shard[k]].ask(k, (t - START).total_seconds())
    assert got == want
    assert {f for f, _ in want.values()} == {"hit", "miss", "expired"} and sum(e for _, e in want.values()) > 50


def test_queue_equals_a_plain_one(spark, tmp_path):
    """Priorities, ties, arrivals of pending and of finished items, failures that are put back three times."""
    rng, batches = random.Random(2), []
    for b in range(4):
        batches.append([(rng.randrange(60), rng.choice([0.5, 0.87, 0.93, 0.99]), rng.random() < 0.5, START + datetime.timedelta(minutes=6 * b, seconds=rng.randrange(60))) for _ in range(30)])
    stream = as_stream(spark, str(tmp_path), batches, "item long, score double, validated boolean, ts timestamp")
    ok = (F.col("item") % 4 != 0) | ((F.col("item") % 8 == 4) & (F.col("retries") >= 2))
    S.run_queue(S.queued(stream), f"{tmp_path}/queue", ok, batch=12, most=3)
    got = {r["item"]: (r["priority"], r["queued_at"], r["status"], r["retries"]) for r in S.queue_state(spark, f"{tmp_path}/queue").collect()}
    queue, now = {}, None
    for rows in batches:
        arrived = {}
        for i, score, fine, t in rows:
            if not (fine and score >= 0.95):
                p = 8 if score < 0.85 else 6 if score < 0.9 else 5
                old = arrived.get(i, (0, t))
                arrived[i] = (max(old[0], p), min(old[1], t))
                now = t if now is None else max(now, t)
        for i, (p, t) in arrived.items():
            if i in queue and queue[i]["status"] == "pending":
                queue[i]["p"] = max(queue[i]["p"], p)
            else:
                queue[i] = {"p": p, "t": t, "due": t, "status": "pending", "n": 0}
        able = sorted((-q["p"], q["t"], i) for i, q in queue.items() if q["status"] == "pending" and q["due"] <= now)
        for _, _, i in able[:12]:
            q = queue[i]
            q["n"] += 1
            if i % 4 or (i % 8 == 4 and q["n"] >= 2):
                q["status"] = "completed"
            elif q["n"] >= 3:
                q["status"] = "failed"
            else:
                q["due"] = now + datetime.timedelta(minutes=5)
    assert got == {i: (q["p"], q["t"], q["status"], q["n"]) for i, q in queue.items()}
    assert {q["status"] for q in queue.values()} >= {"completed", "pending"} and max(q["n"] for q in queue.values()) >= 2
