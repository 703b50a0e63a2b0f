import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from curator.llm import bpe as m
from tests.llm.common import SF, docs, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return m.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.read_ranks(PATH), special_tokens={})


def test_table_matches_the_library(spark, theirs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in m.encode_and_decode(d, PATH, public_tokenizers.PATTERN, keep_ids=True).collect()}
    for r in d.collect():
        ids = theirs.encode_ordinary(r.text)
        assert (got[r.doc_id].ids, got[r.doc_id].n_tokens) == (ids, len(ids))
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_random_strings_match_the_library(own, theirs):
    r = random.Random(0)
    alphabets = ["ab", "aeinrst ", " \n\t.,!", "éèñßöabc", "日本語中文テスト", "🙂👍🏽é́x", "".join(map(chr, range(32, 700)))]
    for i in range(3000):
        t = "".join(r.choice(alphabets[i % 7]) for _ in range(r.randint(0, 60)))
        assert own.encode(t) == theirs.encode_ordinary(t), t
    for t in ("a" * 5000, " " * 3000 + "x", "=" * 999, "ab" * 2000, "<|endoftext|>"):
        assert own.encode(t) == theirs.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_appends_and_edits_are_exact(own):
    r = random.Random(1)
    v = own.vocabulary
    for _ in range(60):
        data = bytes(r.choice(b"abcdefghst ") for _ in range(300))
        p = m.Prefixes(v, data[:100])
        p.append(data[100:])
        assert p.last == m.Prefixes(v, data).last
        a = r.randint(0, 290)
        b = r.randint(a, min(300, a + 9))
        new = bytes(r.choice(b"xyzab") for _ in range(r.randint(0, 8)))
        done = p.replace(a, b, new)
        assert p.last == m.Prefixes(v, data[:a] + new + data[b:]).last
        assert done <= 301


def test_cases(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, " ".join(words(1, 50_000))), (3, "dup"), (3, "dup")]
    got = m.encode_and_decode(docs(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (1, 2)} == {(0, empty, empty)}
    assert m.encode_and_decode(docs(spark, []), PATH, public_tokenizers.PATTERN).collect() == []


def test_clashing_columns(spark):
    d = docs(spark, [(1, "a b"), (2, None)]).selectExpr("*", *[f"1 as {c}" for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")])
    assert sorted((r.doc_id, r.n_tokens) for r in m.encode_and_decode(d, PATH, public_tokenizers.PATTERN, keep_ids=True).collect()) == [(1, 2), (2, 0)]
