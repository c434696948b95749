import gzip
import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import entry, warc

from . import data

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def odd_pages(rng):
    """Groups of copies with largest ids first and last, short copies, nulls, repeated rows, one host with many pages."""
    big = [data.text(rng, 300) for _ in range(4)]
    rows = [(k, f"http://www.hot.example.com:80/p{k % 7}?q={k}#f", big[0]) for k in rng.sample(range(100), 60)]
    rows += [(200 + k, f"https://h{k}.example.org/", big[1 + k % 2]) for k in range(9)]
    rows += [(300, None, "short"), (301, "http://[::1]:8080/é x", "short"), (302, "no url\r\nat all", None), (303, "", ""), (None, None, big[3]), (304, "http://10.0.0.1/a", big[3]), (305, "http://x.example/", "漢字" * 400)]
    rows += [(306, "http://a.example/", "z" * 300_000), (307, "http://b.example/", "q" * 1000), (308, "http://b.example/", "q" * 1000), (309, "http://b.example/", "w" * 999), (310, "http://b.example/", "w" * 999)]
    rows += [(308, "http://b.example/", "q" * 1000), (None, None, None)]
    rng.shuffle(rows)
    return rows


def plain(rows):
    """What each page should give, by plain loops."""
    out, groups = [], {}
    for page_id, url, html in rows:
        b = (html or "").encode()
        groups.setdefault(b, []).append((page_id is not None, page_id or 0, url is not None, url or "", page_id))
    for page_id, url, html in rows:
        b = (html or "").encode()
        first = max(groups[b])
        again = len(b) >= warc.LEAST and first != (page_id is not None, page_id or 0, url is not None, url or "", page_id)
        out.append((page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first[4] if again else None))
    return Counter(out)


def test_round_trip(spark, tmp_path):
    rows = odd_pages(random.Random(1))
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("key", "path", "offset", "same", "own", "first", "digest")}).repartition(5)
    folder = f"{tmp_path}/archives"
    captures = warc.write_archives(warc.records(pages), folder, archive_bytes=2_000)
    index = warc.build_index(captures, f"{folder}/index", block=4)
    assert sorted(index.first) == index.first and len(index.names) > 1
    found = warc.read_records(warc.lookup(index, captures.select("key", "page_id")), folder, keep_payload=True)
    whole = warc.with_payloads(found).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in whole)
    assert got == plain(rows)
    assert Counter((r["page_id"], bytes(r["payload"])) for r in whole) == Counter((i, (h or "").encode()) for i, _, h in rows)
    records = []
    for name in os.listdir(folder):  # the archives stand by themselves: gzip members of records, each as long as it says
        if name.endswith(".warc.gz"):
            left = gzip.open(f"{folder}/{name}").read()
            while left:
                head, _, rest = left.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                n = int(fields["Content-Length"])
                assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
                records.append((fields["WARC-Type"], fields["WARC-Record-ID"]))
                left = rest[n + 4 :]
    kinds = Counter(k for k, _ in records)
    assert kinds["warcinfo"] > 5 and kinds["response"] + kinds["revisit"] == len(rows)


def test_lookup_by_url(spark, tmp_path):
    """All captures of a URL, over blocks and files; missing keys before, between and after give nothing."""
    rows = [(k, f"http://{'hot' if k % 3 else f'h{k}'}.example.com/", None) for k in range(200)]
    folder = f"{tmp_path}/archives"
    captures = warc.write_archives(warc.records(spark.createDataFrame(rows, PAGES)), folder)
    index = warc.build_index(captures.repartition(3), f"{folder}/index", block=7)
    asked = ["com,example,hot)/", "com,example,h3)/", "a", "com,example,h3)/x", "zz", "com,example,hot)/"]
    found = warc.lookup(index, spark.createDataFrame([(k,) for k in asked], "key string")).collect()
    assert sorted(r["page_id"] for r in found) == sorted([3, *(k for k in range(200) if k % 3)])
    assert all(r["key"] in asked for r in found)


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.A.Example.com:80/x?q=1#f", "com,example,a)/x?q=1"),
        ("https://user:pw@b.example:443", "example,b)/"),
        ("https://b.example:80/", "example,b:80)/"),
        ("http://10.0.0.1/a", "10.0.0.1)/a"),
        ("http://[::1]:8080/", "[::1]:8080)/"),
        ("not a url", "not a url"),
        ("", ""),
        (None, ""),
    ],
)
def test_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.url_key(F.col("u"))).first()[0] == key


def test_empty_table_and_damage(spark, tmp_path):
    assert warc.archived(spark.createDataFrame([], PAGES), f"{tmp_path}/none").count() == 0
    good = warc.encoded_record("response", "<urn:page:1:x>", "u", hashlib.sha1(b"abc").hexdigest(), b"abc", None, None)
    assert warc.decoded_record(gzip.compress(good))["payload"] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        warc.decoded_record(gzip.compress(good.replace(b"abc", b"abd")))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rows = entry.QUERIES["op13_warc"](spark, SF).collect()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({entry.ORACLE['op13_warc']})").fetchall())
    assert re.fullmatch(r"[0-9a-f]{40}", rows[0]["payload_digest"])
