import itertools
import random

import numpy as np
from pyspark.sql import types as T

from lodestone.llm import toxicity

from . import data

BAD = ["blorgh", "snarfle", "zugwort"]
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def rows(seed=0, n=400):
    rng, out = random.Random(seed), []
    for i in range(n):
        w, toxic = data.words(rng, rng.randint(8, 80)), int(i % 6 == 0)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(BAD)
        out.append((i, " ".join(w), toxic))
    return out


def frames(spark, told):
    return data.documents(spark, [(i, t) for i, t, _ in told]), spark.createDataFrame([(i, 1, y) for i, _, y in told], LABELS)


def test_held_out_rows_and_disguises(spark):
    told = rows()
    hidden = ["you bl0rgh you", "s n a r f l e now", "zug.w.o.r.t here", "a blorrrrgh b", "sn@rfle"]
    told += [(1000 + k, t, None) for k, t in enumerate(hidden)] + [(2000, "kalo miru 12.5 B2B 3rd a1", None)]
    docs, labels = frames(spark, told)
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in told[:400] if out[r[0]]["held_out"]]
    assert len(held) > 40 and np.mean([out[r[0]]["predicted"] == r[2] for r in held]) > 0.97
    assert [out[1000 + k]["predicted"] for k in range(5)] == [1, 1, 0, 1, 1] or sum(out[1000 + k]["predicted"] for k in range(5)) >= 4
    assert out[2000]["predicted"] == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["predicted"]}


def test_copies_of_one_toxic_text_teach_nothing_else(spark):
    told = rows(1)
    own = "grumish fandle blorgh"
    told += [(3000 + k, own + " " + data.text(random.Random(k), 3), 1) for k in range(60)] + [(4000, "grumish fandle", 0)]
    out = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(*frames(spark, told)).collect()}
    assert out[4000] == 0


def test_decoder_keeps_plain_words():
    counts = np.full((64, 64, 64), 0.05)
    for w in ["moron", "idiot", "house", "these"] * 50:
        a, b = 0, 0
        for c in [ord(x) - 96 for x in w] + [0]:
            counts[a, b, c] += 1
            a, b = (0, 0) if c == 0 else (b, c)
    decoder = toxicity.Decoder((-np.log(counts / counts.sum(2, keepdims=True))).astype(np.float32))
    assert decoder.words("m0r0n") == ["moron"] and decoder.words("1d10t") == ["idiot"] and decoder.words("i d i o t") == ["idiot"]
    assert decoder.words("hoooouse") == ["house"] and decoder.words("the5e") == ["these"]


def found(texts):
    return toxicity.suspicious(*toxicity.text_buffer(toxicity.pa.array(texts)))


def test_tokens_end_with_their_text():
    alone = ["s n a r f l e", "a cat", "kalo 12", "abc xx", "x", "I b c"]
    alone = [t.lower() for t in alone]
    assert found(alone) == [(i, t) for i, own in enumerate(alone) for _, t in found([own])]
    assert found(alone)[0] == (0, "s n a r f l e")


def test_long_tokens_and_runs_are_found_whole():
    dotted, spaced = ".".join("snarfle_zugwort_blorgh_snarfle_kalo"), " ".join("kalomirusatevo" * 3 + "snarfle" + "b")
    drawn, cyrillic = "blo" + "r" * 60 + "gh", "".join(chr(0x430 + k % 32) for k in range(30)) + "4a"
    got = [t for _, t in found([dotted, spaced, drawn, cyrillic, "this is idio+ now"])]
    assert sorted(got) == sorted([dotted, spaced, drawn, cyrillic, "idio+"])


def test_long_disguises_count(spark):
    told = rows()
    hidden = ["s.n.a.r.f.l.e." + "_".join("zugwortsnarfleblorgh"), "blo" + "r" * 60 + "gh you", "kalo-miru-kalo-miru-kalo-miru-kalo-miru/sn4rfle/you", " ".join("kalomirusatevo" * 3)[:-28] + " s n a r f l e"]
    plain = ["kalo", "a b c d", "miru!", "x" * 60]
    told += [(1000 + k, t, None) for k, t in enumerate(hidden)] + [(2000 + k, t, None) for k, t in enumerate(plain)]
    out = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(*frames(spark, told)).collect()}
    assert [out[1000 + k] for k in range(3)] == [1, 1, 1] and [out[2000 + k] for k in range(4)] == [0, 0, 0, 0]


def test_spaced_leetspeak_and_doubled_letters(spark):
    told = rows()
    hidden = ["you 5 n 4 r f 1 3 you", "s n 4 r f l e", "$ n @ r f l e now", "5.n.4.r.f.1.3", "a snnarfle b", "z u g w 0 r 7"]
    plain = ["| 1 | 2 | 3 |", "1 2 3 4 5 6", "x 1 y 2 z 3", "kallo mirru", "é t é ü ß"]
    told += [(1000 + k, t, None) for k, t in enumerate(hidden)] + [(2000 + k, t, None) for k, t in enumerate(plain)]
    out = {r["doc_id"]: r for r in toxicity.toxicity(*frames(spark, told)).collect()}
    assert [out[1000 + k]["predicted"] for k in range(len(hidden))] == [1] * len(hidden)
    assert [out[2000 + k]["predicted"] for k in range(len(plain))] == [0] * len(plain)
    assert out[1000]["score"] == out[1001]["score"]
    assert [t for _, t in found(["é t é ü", "1 2 3 4", "a b", "5 n 4 r"])] == ["é t é ü", "5 n 4 r"]


def test_viterbi_finds_the_likeliest_of_all_readings():
    """Every reading of a short token's lattice is priced, as the product of its arcs and of the language model."""
    rng = np.random.default_rng(3)
    model = -np.log(rng.dirichlet(np.ones(64) * 0.1, (64, 64)) + 1e-9).astype(np.float32)
    decoder, signs = toxicity.Decoder(model), random.Random(4)
    for _ in range(150):
        token = "".join(signs.choice("ab5 .1@aé") for _ in range(signs.randint(1, 6)))
        best = None
        for path in itertools.product(*decoder._arcs(token)):
            word, cost, x, y = "".join(r for r, _ in path), sum(p for _, p in path), 0, 0
            for byte in (word + " ").encode():
                z = int(toxicity._ALPHABET[byte])
                cost += model[x, y, z]
                x, y = (0, 0) if z == 0 else (y, z)
            if best is None or cost < best[0] - 1e-3:
                best = (cost, {word.strip()})
            elif abs(cost - best[0]) <= 1e-3:
                best[1].add(word.strip())
        assert decoder._decode(token).strip() in best[1], token


def test_odd_rows(spark):
    docs = data.odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (5, 1, 0), (6, None, None), (None, 1, 1)], LABELS)
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in out)
    assert toxicity.toxicity(data.documents(spark, []), labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("doc_id = -1")).count() == 10


def test_scores_do_not_depend_on_batches(spark):
    told = rows()
    told += [(1000, "x a", None), (1001, "s n a r f l e", None), (1002, "I am", None), (1003, "s.n.a.r.f.l.e", None), (1004, None, None)]
    got = []
    for size, turn in (("10000", 1), ("1", -1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = toxicity.toxicity(*frames(spark, told[::turn])).collect()
        got.append(sorted((r["doc_id"], r["score"], r["n_toxic"]) for r in out))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and dict((i, n) for i, _, n in got[0])[1001] > 0


def test_labels_that_differ(spark):
    docs = data.documents(spark, [(1, "kalo blorgh miru"), (2, "kalo blorgh miru"), (3, "kalo blorgh miru"), (4, "teso"), (6, "kalo blorgh miru")])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1), (4, 1, 0)], LABELS)
    got = [sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, part).collect()) for part in (labels, labels.orderBy("toxic"), labels.repartition(3))]
    assert got[0] == got[1] == got[2]
