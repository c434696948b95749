import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import packing, tokens

from . import data


def test_ids_equal_the_tokenizer_file():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code, rng = tokens.Encoder(tokens.default_path()), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", " the", "'s", "don't", "1", "é", "漢", ".", "!?", "b c", " \n ", " ", "<|endoftext|>", "<|endoftext", "|>", "<|"]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(code.packed(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_token_at_starts_and_ends():
    whole, code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.Encoder(tokens.default_path())
    for t in ("x<|endoftext|>y", "<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "a  <|endoftext|>  b", "<|endoftext|", "\n\n<|endoftext|>\n"):
        assert code.ids(t) == whole.encode(t, add_special_tokens=False).ids
    assert code.ids("x<|endoftext|>y") == [87, tokens.ADDED_ID, 88]


def test_plan_is_best_fit_decreasing():
    """Against a plain best fit over single pieces: as many sequences, no overlap, no gap."""
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice([8, 16, 64])
        hist = {n: rng.randint(1, 12) for n in rng.sample(range(1, cap + 1), rng.randint(1, cap // 2))}
        runs = packing.plan(hist, cap)
        placed, ranks = {}, {n: set() for n in hist}
        for length, a, b, seq, off in runs:
            for r in range(a, b):
                assert r not in ranks[length]
                ranks[length].add(r)
                placed.setdefault(seq + r - a, []).append((off, length))
        assert all(ranks[n] == set(range(c)) for n, c in hist.items())
        for own in placed.values():
            at = 0
            for off, length in sorted(own):
                assert off == at
                at += length
            assert at <= cap
        rooms = []
        for n in sorted(hist, reverse=True):
            for _ in range(hist[n]):
                fit = min((r for r in rooms if r >= n), default=None)
                if fit is None:
                    rooms.append(cap - n)
                else:
                    rooms.remove(fit)
                    rooms.append(fit - n)
        assert len(placed) == len(rooms)


def pieces(doc_id, text, code):
    """The pieces of one row: only the first may be shorter than the capacity, if the text needs more than one."""
    ids = np.frombuffer(code.packed(text or ""), "<u4").tolist() + [packing.END_ID]
    start, stop, out = 0, len(ids) % packing.CAPACITY or packing.CAPACITY, []
    while start < len(ids):
        out.append((doc_id, len(out), start, stop - start, tuple(ids[start:stop])))
        start, stop = stop, stop + packing.CAPACITY
    return out


def test_pieces_and_sequences_round_trip(spark):
    """Also of rows that repeat a doc_id with the same text or another one, and of null doc_ids."""
    docs = data.odd_documents(spark)
    more = [(5, "another text of five"), (6, data.text(random.Random(8), 3000)), (None, None)]
    docs = docs.select("doc_id", "text", "block", "length", "pos").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    packed = packing.best_fit_packing(docs, keep_ids=True)
    rows, code = packed.collect(), tokens.Encoder(tokens.default_path())
    want = Counter(p for r in docs.collect() for p in pieces(r["doc_id"], r["text"], code))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], tuple(r["ids"])) for r in rows) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    total = sum(r["length"] for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    seqs = packing.sequences(packed).collect()
    assert sum(len(s["ids"]) for s in seqs) == total and max(len(s["ids"]) for s in seqs) <= packing.CAPACITY
    assert len(seqs) <= -(-total // packing.CAPACITY) + 2


def test_empty_table(spark):
    assert packing.best_fit_packing(data.documents(spark, [])).count() == 0
