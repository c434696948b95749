import random

import pytest

from lodestone.llm import minhash

from . import data


def brute(rows, width, percent):
    """Components by comparing every pair of full shingle sets."""
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed):
    """Groups of copies with ever more edits, chains, short texts and texts alike in part."""
    rng, rows, at = random.Random(seed), [], 10
    for _ in range(12):
        base = data.words(rng, rng.choice([6, 12, 40, 120]))
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(["Zu", "qua", "xi"])
            if rng.random() < 0.3:
                base = own
            rows.append((at, " ".join(own)))
            at += 1
    shared = data.text(rng, 60)
    rows += [(at + k, shared + " " + data.text(rng, 40)) for k in range(15)]
    return rows


def test_components_equal_brute_force(spark):
    for width in (2, 5):
        rows = near_rows(width)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(data.documents(spark, rows), width=width).collect()}
        assert got == brute(rows, width, 80)


def family(seed, n, planted):
    """Copies of one template, alike by 0.66 to 0.77; planted pairs of them that share two words more are alike by 0.81."""
    rng, rows, fresh = random.Random(seed), [], iter(range(10**6))
    base = [f"b{k}" for k in range(200)]

    def edited(own, places):
        return [f"w{next(fresh)}" if k in places else w for k, w in enumerate(own)]

    def places(kept=()):
        return rng.sample([k for k in range(5, 195, 5) if k not in kept], 4 - len(kept))

    for _ in range(n):
        rows.append(edited(base, places()))
    for _ in range(planted):
        kept = places()[:2]
        own = edited(base, kept)
        rows += [edited(own, places(kept)) for _ in range(2)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_pairs_within_a_large_family_of_texts_that_are_less_alike(spark):
    rows = family(3, 420, 40)
    want = brute(rows, 5, 80)
    assert 40 <= sum(i != c for i, (_, c) in want.items()) < 80
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(data.documents(spark, rows)).collect()}
    assert got == want


def test_odd_rows(spark):
    out = minhash.near_duplicates(data.odd_documents(spark), width=2).collect()
    assert len(out) == 10
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert all(r["kept"] for r in out) and by[None]["component_id"] is None


def test_empty_table(spark):
    assert minhash.near_duplicates(data.documents(spark, [])).count() == 0


@pytest.mark.parametrize(("seed", "n", "shortest", "longest", "vocabulary"), [(1, 2500, 14, 20, 5), (3, 3000, 8, 12, 4)])
def test_short_texts_over_few_words(spark, seed, n, shortest, longest, vocabulary):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abcdefgh"[:vocabulary]) for _ in range(rng.randint(shortest, longest)))) for i in range(n)]
    want = brute(rows, 2, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(data.documents(spark, rows), width=2).collect()}
    assert got == want


def test_families_and_buckets_cut_into_blocks(spark, monkeypatch):
    rows = family(5, 150, 20)
    want = brute(rows, 5, 80)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(data.documents(spark, rows)).collect()}
    assert got == want


def test_a_repeated_doc_id_with_other_texts(spark):
    rng = random.Random(4)
    a, b = data.words(rng, 60), data.text(rng, 60)
    edited = " ".join([*a[:30], "other", *a[31:]])
    a = " ".join(a)
    docs = data.documents(spark, [(3, a), (5, a), (5, b), (7, a), (7, edited), (None, a), (8, None), (8, None), (8, "")])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).where("n_shingles > 0 and doc_id is not null").collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 3, False), (7, 3, False)]
    left = sorted(((r["doc_id"] or -1, r["text"] or "-") for r in minhash.without_near_duplicates(docs).collect()))
    assert left == sorted([(3, a), (5, b), (-1, a), (8, "-"), (8, "-")])
    both = data.documents(spark, [(2, a), (2, edited), (2, a), (9, a)])
    assert minhash.without_near_duplicates(both).count() == 1
