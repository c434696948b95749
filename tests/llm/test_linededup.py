import random
from collections import defaultdict

from lodestone.llm import linededup

from . import data


def brute(rows, least):
    """Each place with each earlier one: the run that they share goes if it has words enough."""
    seq, end, docs = [], [], []
    for d, t in sorted(rows, key=lambda r: r[0]):
        own = [x.strip() for x in t.split("\n")]
        docs.append((d, len(seq), len(seq) + len(own)))
        end += [len(seq) + len(own)] * len(own)
        seq += own
    where, gone = defaultdict(list), [False] * len(seq)
    for i, x in enumerate(seq):
        for j in where[x]:
            n = 0
            while i + n < end[i] and j + n < end[j] and seq[i + n] == seq[j + n]:
                n += 1
            if sum(len(y.split()) for y in seq[i : i + n]) >= least:
                gone[i : i + n] = [True] * n
        where[x].append(i)
    return {d: [k - a for k in range(a, b) if gone[k]] for d, a, b in docs}


def rows(seed):
    rng = random.Random(seed)
    lines = [data.text(rng, rng.choice([1, 3, 8, 20, 30])) for _ in range(40)] + [""]
    out = []
    for i in range(60):
        own = [rng.choice(lines) if rng.random() < 0.4 else data.text(rng, 6) for _ in range(rng.randint(1, 14))]
        if out and rng.random() < 0.3:
            at = rng.randrange(len(own) + 1)
            own[at:at] = rng.choice(out)[1].split("\n")
        out.append((i, "\n".join(own)))
    return out + [(100, "same line of some words\n" * 9)]


def test_removed_lines_equal_brute_force(spark):
    for seed, least in ((0, 25), (1, 5), (2, 1)):
        docs = rows(seed)
        out = linededup.line_dedup(data.documents(spark, docs), least).collect()
        want = brute(docs, least)
        text = dict(docs)
        for r in out:
            assert list(r["removed"]) == want[r["doc_id"]], (seed, r["doc_id"])
            own = text[r["doc_id"]].split("\n")
            assert r["text"] == "\n".join(x for k, x in enumerate(own) if k not in set(want[r["doc_id"]]))


def test_short_runs_of_different_places_are_not_joined(spark):
    """Lines a, b and c of nine words: ab and bc stand before abc, and each of them is too short."""
    a, b, c = (data.text(random.Random(k), 9) for k in (1, 2, 3))
    docs = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"x\n{a}\n{b}\n{c}\ny")]
    got = {r["doc_id"]: list(r["removed"]) for r in linededup.line_dedup(data.documents(spark, docs)).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [1, 2, 3]}


def test_many_blank_lines(spark):
    """Windows over many blank lines are as long as these, and cost no more than the lines."""
    passage = "\n" * 60 + data.text(random.Random(4), 20) + "\n" * 60 + data.text(random.Random(5), 20)
    docs = [(1, "one" + passage), (2, "two" + passage + "\nend")]
    got = {r["doc_id"]: list(r["removed"]) for r in linededup.line_dedup(data.documents(spark, docs)).collect()}
    assert got == brute(docs, 25) and got[2] == list(range(1, 121))


def test_first_copy_stays_whatever_the_row_order(spark):
    passage = data.text(random.Random(9), 60)
    docs = [(5, "b\n" + passage), (3, passage + "\na"), (4, passage)]
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(data.documents(spark, docs)).collect()}
    assert got == {3: passage + "\na", 4: "", 5: "b"}


def test_odd_rows(spark):
    docs = data.odd_documents(spark)
    out = linededup.line_dedup(docs)
    assert set(docs.columns) < set(out.columns)
    rows = out.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and by[1]["text"] is None and by[2]["text"] == "" and all(r["n_removed"] == 0 for r in rows)
    assert linededup.line_dedup(data.documents(spark, [])).count() == 0
