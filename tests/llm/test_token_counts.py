import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from curator.llm import token_counts as m
from curator.scratch import materialize
from tests.llm.common import SF, docs, words

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokens():
    return m.counter(PATH, PATTERN)


def expected(text, edits):
    for e in edits or ():
        if e is not None:
            a = min(max(e["start"] or 0, 0), len(text))
            b = min(max(e["end"] or 0, a), len(text))
            text = text[:a] + (e["insert"] or "") + text[b:]
    return text


def test_random_edits_equal_a_new_count(tokens):
    r = random.Random(0)
    bits = ["word", " ", "  ", "\n\n", "'re", "'", "l", "12", "!?", "é", "日本", " x", "\t ", "don't", "'ll"]
    for k in range(150):
        text = "".join(r.choice(bits) for _ in range(r.choice([0, 3, 50, 700])))
        tree = m.CountTree.of(tokens, text)
        assert tree.total == len(tokens.encoding.encode_ordinary(text))
        for _ in range(12):
            a = r.randint(0, len(text) + 2)
            b = a + r.choice([0, 1, 3, 200, -5])
            new = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 5, 300])))
            tree.edit(a, b, new)
            text = expected(text, [{"start": a, "end": b, "insert": new}])
            assert tree.text() == text
            assert [p for leaf in tree.leaves for p, _ in leaf.pieces()] == tokens.pattern.findall(text)
            assert (tree.total, tree.length) == (len(tokens.encoding.encode_ordinary(text)), len(text))


def test_only_the_region_is_encoded(tokens):
    tree = m.CountTree.of(tokens, " ".join(words(1, 20_000)))
    tree.edit(50_000, 50_003, "abc")
    assert tree.encoded < 12
    tree.edit(50_000, 50_000, " and".join(words(2, 3000)))
    assert tree.encoded < 6100  # a larger tree is built, and nothing else encoded


def test_rounds_of_edits_on_stored_trees(spark, tokens):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    trees = materialize(m.count_trees(d, PATH, PATTERN), "test-trees")
    for _ in range(3):
        edited = materialize(m.sample_edits(trees), "test-edits")
        for r in edited.select("doc_id", "edits").collect():
            texts[r.doc_id] = expected(texts[r.doc_id], r.edits)
        trees = materialize(m.apply_edits(edited, PATH, PATTERN), "test-trees")
        got = trees.collect()
        assert len(got) == len(texts)
        for r in got:
            want = texts[r.doc_id]
            assert "".join(r.leaves) == want and (r.n_tokens, r.n_chars) == (len(tokens.encoding.encode_ordinary(want)), len(want))
            assert r.n_tokens == sum(r.counts) == r.node_counts[1] and r.n_chars == r.node_chars[1]
        assert sum(r.n_encoded for r in got) < 0.3 * sum(len(r.chars) for r in got)


def test_query_equals_brute_force(spark, tokens):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in m.count_sampled_edits(d, PATH, PATTERN).collect()}
    edits = {r.doc_id: r.edits for r in m.sample_edits(d.withColumn("n_chars", F.length("text"))).collect()}
    for r in d.collect():
        t, x = expected(r.text, edits[r.doc_id]), got[r.doc_id]
        assert (x.n_tokens, x.n_tokens_after, x.n_chars_after) == (len(tokens.encoding.encode_ordinary(r.text)), len(tokens.encoding.encode_ordinary(t)), len(t))


def test_cases(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, " ".join(words(2, 60_000)))])
    e = m.count_trees(d, PATH, PATTERN).withColumn("edits", F.expr(f"cast(case doc_id when 1 then array(struct(9L, 3L, 'ab')) when 3 then array(null, struct(null, 1L, null)) end as {m.EDITS})"))
    got = sorted(((r.doc_id or 0, r.n_tokens_before, r.n_tokens, r.n_chars) for r in m.apply_edits(e, PATH, PATTERN).collect()))
    assert got[:5] == [(0, 1, 1, 1), (1, 0, 1, 2), (2, 0, 0, 0), (3, 2, 1, 2), (3, 2, 1, 2)]
    assert m.count_sampled_edits(docs(spark, []), PATH, PATTERN).collect() == []


def test_clashing_columns(spark):
    d = docs(spark, [(1, "a b"), (2, None)]).selectExpr("*", *[f"1 as {c}" for c in ("tie", "edits", "leaves", "chars", "counts", "n_tokens", "pieces")])
    assert sorted((r.doc_id, r.n_tokens) for r in m.count_sampled_edits(d, PATH, PATTERN).collect()) == [(1, 2), (2, 0)]
