import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import pii

from . import data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "_d@e.f", "%", "1.2.3.4", ".5", "300.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (234) 567-8901", "+", "é", "漢", "12", "\n", "0" * 13]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    rows += [(9000, "9" * 20000 + "@" * 500 + "a" * 20000), (9001, None)]
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(data.documents(spark, rows))).collect()}
    for i, t in rows:
        want = base(t or "")
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w[3] == k for w in want) for k in PLAIN], (i, t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()


def test_disclosing_terms(spark):
    rng = random.Random(5)
    rows = [(i, data.text(rng, 40)) for i in range(60)]
    for i in range(4):  # "wombat" stands nowhere but beside the address; "common" stands everywhere
        rows.append((100 + i, f"{data.text(rng, 20)} common wombat joe@mail.org {data.text(rng, 20)}"))
    rows += [(200 + i, f"common {data.text(rng, 10)}") for i in range(30)]
    found = pii.personal_data(data.documents(spark, rows))
    out = {r["doc_id"]: r for r in found.collect()}
    terms = {s["value"] for i in range(100, 104) for s in out[i]["spans"] if s["kind"] == "term"}
    assert "wombat" in terms and "common" not in terms
    clean = data.documents(spark, rows).join(found, "doc_id").select("doc_id", pii.sanitised(F.col("text"), F.col("spans"), F.col("remove")).alias("t"))
    text = {r["doc_id"]: r["t"] for r in clean.collect()}
    assert "<email>" in text[100] and "joe@" not in text[100] and "wombat" not in text[100] and text[5] == dict(rows)[5]


def test_disclosing_terms_are_spans_wherever_they_stand(spark):
    rng = random.Random(6)
    far = " ".join(data.text(rng, 60))[:300].strip()
    rows = [(i, data.text(rng, 40)) for i in range(200)]
    rows += [(300 + i, f"{data.text(rng, 20)} Wombat joe@mail.org {far} wombat end") for i in range(4)]
    rows += [(400, "a WOMBAT and wombats; wombat@zoo.org"), (401, "no such")]
    found = pii.personal_data(data.documents(spark, rows))
    texts, out = dict(rows), {r["doc_id"]: r for r in found.collect()}
    terms = {i: [(s["start"], s["stop"]) for s in r["spans"] if s["value"] == "wombat"] for i, r in out.items()}
    assert {i: x for i, x in terms.items() if x} == {i: [m.span() for m in re.finditer(r"(?i)\bwombat\b(?!@)", texts[i])] for i in (300, 301, 302, 303, 400)}
    assert all(len(terms[i]) == 2 and terms[i][1][0] - terms[i][0][1] > 200 for i in range(300, 304)) and len(terms[400]) == 1


def plain_terms(rows):
    """Disclosing terms by counting: terms near an entity in SUPPORT documents, and their share of its information."""
    word, near, ents, held = re.compile(r"[^\W\d_]{4,}"), {}, {}, {}
    for i, t in rows:
        spans = base(t)
        held[i] = {w.lower() for w in word.findall(t)}
        for a, _, b, kind in spans:
            e = (kind, t[a:b].lower())
            ents.setdefault(e, set()).add(i)
            low, high = max(0, a - pii.AROUND), min(len(t), b + pii.AROUND)
            found = [(m, low) for m in word.finditer(t[low:a]) if low == 0 or m.start() > 0]
            found += [(m, b) for m in word.finditer(t[b:high]) if high == len(t) or m.end() < high - b]
            for m, at in found:
                if not any(x < m.end() + at and m.start() + at < y for x, _, y, _ in spans):
                    near.setdefault((e, m.group().lower()), set()).add(i)
    n, out = len(rows), set()
    for (e, w), docs in near.items():
        if len(docs) >= pii.SUPPORT and len(ents[e]) < n:
            n_w, n_e = sum(w in h for h in held.values()), len(ents[e])
            both = sum(w in held[i] for i in ents[e])
            if np.log2(n * both / (n_w * n_e)) / np.log2(n / n_e) >= pii.GENERALISE:
                out.add(w)
    return out


def test_disclosing_terms_equal_plain_counts(spark):
    rng = random.Random(11)
    people = [(f"user{k}@mail.org", data.words(rng, 3)) for k in range(6)] + [("10.0.0.7", data.words(rng, 2))]
    rows = []
    for i in range(160):
        t = data.words(rng, 30)
        for value, own in rng.sample(people, rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(t))
            t[at:at] = [rng.choice(own), value, rng.choice(own)] if rng.random() < 0.8 else [value]
        if rng.random() < 0.1:
            t.append(rng.choice(rng.choice(people)[1]))
        rows.append((i, " ".join(t)))
    want = plain_terms(rows)
    found = pii.personal_data(data.documents(spark, rows)).collect()
    got = {s["value"] for r in found for s in r["spans"] if s["kind"] == "term"}
    assert got == want and len(want) > 3
    for r in found:  # every place of such a term, and none else
        t = dict(rows)[r["doc_id"]]
        spans = base(t)
        places = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{4,}", t) if m.group().lower() in want and not any(x < m.end() and m.start() < y for x, _, y, _ in spans)]
        assert [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "term"] == places
        assert all(v not in r["clean"] for v in ("@mail.org", "10.0.0.7"))


def test_odd_rows(spark):
    out = pii.digest(pii.personal_data(data.odd_documents(spark))).collect()
    assert len(out) == 10 and all(r["spans"] == "" for r in out)
    assert pii.personal_data(data.documents(spark, [])).count() == 0
