import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import alignment

from . import data

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_names():
    """The sign that the tokenizer file writes for each byte, the other way round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def brute(rows):
    """All tokens of a text against all, by their byte ranges."""
    whole, signs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), byte_names()
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, counts = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            want = (" " + text).encode()
            a = [(i, bytes(signs[c] for c in whole.id_to_token(i))) for i in whole.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)]
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [tuple([i for i, s, e in side if lo <= s and e <= hi] for side in spans) for lo, hi in zip([0, *both], both)] if len(a) < 500 else None
        links, low = [], 0
        for i, s, e in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= s:
                low += 1
            for j, s2, e2 in spans[1][low:]:
                if s2 >= e:
                    break
                links.append((i, j))
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(both), links, groups))
    most = {}
    for (i, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, groups in found:
        text = None if groups is None else ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = None if text is None else hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    odd = ["a  b", " lead", "trail ", "▁piece", "<s> x </s> <unk> <|endoftext|>", "<0x41>A", "漢字かな🎈é́ß", "ﬁ ①  x", "\x00\x01", "tab\tnew\nline\r\n", "don't won't 12345 3.14!!", "x" * 400, "ab" * 300, "\n\n\n", "naïve café"]
    rows = data.odd_rows(rng) + [(20 + k, t) for k, t in enumerate(odd)] + [(50 + k, data.text(rng, rng.randint(1, 60)) + rng.choice(odd)) for k in range(60)]
    docs = data.documents(spark, rows).withColumns({c: F.lit("x") for c in ("slice", "a", "b", "count", "best", "pair", "n")}).repartition(3)
    got = [tuple(r[c] for c in NAMES) for r in alignment.alignment(docs, slice_bytes=3000).collect()]
    key = lambda r: tuple((x is not None, x) for x in r[:7])
    want = sorted(brute(rows), key=key)
    got.sort(key=key)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want))
    assert sum(r[1] == 0 for r in got) >= 2 and max(r[1] - r[3] for r in got) > 50


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.randoms(use_true_random=False))
def test_doubling_finds_components(sizes, rng):
    """Also of chains over all tokens: the other side's ends are drawn at random over the same bytes."""
    a = np.cumsum(sizes)
    b = np.array(sorted({int(a[-1]), *rng.sample(range(1, int(a[-1]) + 1), rng.randint(0, min(30, int(a[-1]))))}))
    own = alignment.components(a, b)
    common = np.intersect1d(a, b)
    label = np.searchsorted(common, np.concatenate([a, b]), "left")
    assert len(set(zip(own, label))) == len(set(own)) == len(set(label))
    assert (np.concatenate([a, b])[own] == common[label]).all() and (own >= len(a)).all()


def test_long_chain_and_empty_table(spark):
    a, b = np.arange(2, 200_002, 2), np.append(np.arange(1, 200_000, 2), 200_000)
    assert (alignment.components(a, b) == len(a) + len(b) - 1).all()
    assert alignment.alignment(data.documents(spark, [])).count() == 0
    only = alignment.alignment(data.documents(spark, [(1, None), (2, "")])).collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
