import random

import numpy as np

from lodestone.llm import langid

from . import data

SETS = {"aa": "ka lo mi ru te".split(), "bb": "schü tzen pfö ung ei".split(), "cc": "ção nhe lhõ que es".split()}


def rows(seed, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SETS))
        t = " ".join("".join(rng.choice(SETS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 300)))
        out.append((i, t, lang, "s", len(t)))
    return out


def test_folded_tables_give_the_networks_numbers():
    net = langid.Network(["aa", "bb"], seed=1)
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    e, pooled = net.p["embed"][x], []
    for w in langid.WIDTHS:
        z = sum(e[:, i : langid.WINDOW - w + 1 + i] @ net.p[f"w{w}"][i] for i in range(w)) + net.p[f"b{w}"]
        pooled.append(np.maximum(0, z.max(1)))
    logits = np.concatenate(pooled, 1) @ net.p["dense"] + net.p["out"]
    want = np.exp(logits - logits.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    assert np.allclose(langid.probabilities(net.folded(), x), want, atol=1e-4)


def test_gradients_follow_the_loss():
    net = langid.Network(["aa", "bb"], seed=2)
    x = np.random.default_rng(3).integers(0, 60, (4, langid.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 1, 0])

    def loss():
        t = langid.probabilities({k: v.astype(np.float64) for k, v in net.folded().items()}, x)
        return -np.log(t[np.arange(4), y]).mean()

    g = net.step(x, y)
    for name, at in (("dense", (3, 1)), ("out", (0,)), ("b3", (5,))):
        step = 1e-2
        before = net.p[name][at]
        net.p[name][at] = before + step
        up = loss()
        net.p[name][at] = before - step
        down = loss()
        net.p[name][at] = before
        assert abs((up - down) / (2 * step) - g[name][at]) < 5e-3


def test_held_out_accuracy_and_windows(spark):
    docs = spark.createDataFrame(rows(0), data.DOCUMENTS)
    out = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    held = [r for r in rows(0) if out[r[0]]["held_out"]]
    assert len(held) > 20 and np.mean([out[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    # the first windows say one thing, most of the text another: whole texts count
    turn = SETS["aa"][0] * 100 + " " + " ".join(SETS["bb"] * 400)
    both = docs.unionByName(spark.createDataFrame([(9999, turn, None, None, 0)], data.DOCUMENTS))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.language_id(both).collect()}[9999] == "bb"


def test_odd_rows(spark):
    out = {r["doc_id"]: r for r in langid.language_id(data.odd_documents(spark)).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[4]["lang_pred"] == "en"
    assert not out[None]["held_out"]
    unlabelled = spark.createDataFrame([(1, "text", None, None, 4)], data.DOCUMENTS)
    assert langid.language_id(unlabelled).first()["lang_pred"] == "und"
    assert langid.language_id(data.documents(spark, [])).count() == 0


def test_copies_of_a_text_and_rare_languages_in_the_sample(spark, monkeypatch):
    few = [(60_000 + i, f"kalo {i} miru", "xx") for i in range(3)]
    seen = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, x, y, epochs: seen.append((len(x), list(self.languages))))
    docs = spark.range(50_000).selectExpr("id as doc_id", "'the same text of all' as text", "'en' as lang").unionByName(spark.createDataFrame(few, "doc_id long, text string, lang string"))
    langid.trained(docs, 400)
    assert seen[0][0] <= 400 * langid.PER_TEXT and seen[0][1] == ["en", "xx"]
