import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import edits, tokens

from . import data

CODE = tokens.Encoder(tokens.default_path())
PARTS = st.sampled_from([" ", "  ", "\n", "a", "the", " the", "'s", "1", "é", ".", "!?", "b c d", " \n ", "word " * 70, "世界，", "\t", "x\ty", "(é)", "'", "\x1c", "\u00a0"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=120), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 90), st.lists(PARTS, max_size=4)), max_size=4))
def test_counts_follow_edits(parts, changes):
    text = "".join(parts)
    tree = edits.Tree(*edits.built(text, CODE))
    for start, n, put in changes:
        text, _ = edits.edit(text, tree, start, start + n, "".join(put), CODE)
        assert tuple(tree.sums[1]) == (len(text), CODE.count(text))


MARKS = st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "<|", "|", ">", "endoftext", "x", "t", " ", "a b", ".", "\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(MARKS, max_size=40), st.lists(st.tuples(st.integers(0, 200), st.integers(0, 6), st.lists(MARKS, max_size=2)), max_size=5))
def test_counts_follow_edits_in_the_added_token(parts, changes):
    """Edits that make, break and join the added token, with a leaf for every piece."""
    text, leaf = "".join(parts), edits.LEAF
    edits.LEAF = 1
    try:
        tree = edits.Tree(*edits.built(text, CODE))
        assert tree.sums[1, 1] == CODE.count(text)
        for start, n, put in changes:
            text, _ = edits.edit(text, tree, start, start + n, "".join(put), CODE)
            assert tuple(tree.sums[1]) == (len(text), CODE.count(text))
    finally:
        edits.LEAF = leaf


def test_long_text():
    text = data.text(random.Random(4), 120_000) + "<|endoftext|>" * 3 + "y" * 20_000
    tree = edits.Tree(*edits.built(text, CODE))
    assert tree.sums[1, 1] == CODE.count(text)
    text, coded = edits.edit(text, tree, 400_000, 400_010, " new ", CODE)
    assert tuple(tree.sums[1]) == (len(text), CODE.count(text)) and coded < 3000


def test_only_touched_leaves_are_coded():
    text = data.text(random.Random(3), 5000)
    tree = edits.Tree(*edits.built(text, CODE))
    _, coded = edits.edit(text, tree, 9000, 9004, "new", CODE)
    assert 0 < coded < 1500


def test_leaves_end_at_tabs_lines_and_signs():
    for text in ("世界，你好。" * 500, "def\tf\nreturn\tx\n" * 300):
        tree = edits.Tree(*edits.built(text, CODE))
        assert tree.leaves > 5
        new, coded = edits.edit(text, tree, 1000, 1001, "x", CODE)
        assert coded < 800 and tuple(tree.sums[1]) == (len(new), CODE.count(new))


def test_table_equals_whole_counts(spark):
    docs = data.odd_documents(spark)
    out = edits.edited_counts(docs, edits.seeded_edits(docs)).collect()
    assert len(out) == 10
    assert all(r["n_tokens_edited"] == CODE.count(r["text"]) for r in out)
    assert sum(r["n_edits"] for r in out) > 9
    empty = docs.where("doc_id = -1")
    assert edits.edited_counts(empty, edits.seeded_edits(docs)).count() == 0
