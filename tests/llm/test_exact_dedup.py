import hashlib
import re

from pyspark.sql import functions as F

from curator.llm import exact_dedup as m
from tests.llm.common import docs


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, t or ""))
    return {n: (min(g), len(g)) for n, g in groups.items()}


def test_cases_match_brute_force(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a  b"), (5, None), (6, ""), (7, " \t\n"), (8, "é x"), (9, "é x"), (10, "x" * 200_000), (11, "x" * 200_000 + " "), (4, "a  b"), (None, "solo")]
    want = brute(rows)
    got = m.exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): v for n, v in want.items()}
    for r in got:
        (_, none, i, _), size = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (None if none else i, size)
    assert sum(r.kept for r in got) == len(want)


def test_kept_rows_keep_their_columns(spark):
    d = docs(spark, [(1, "a b"), (2, "ab"), (2, "ab"), (3, None), (3, None), (4, "z")]).withColumn("h", F.lit(1)).withColumn("count", F.lit("c"))
    kept = m.keep_first(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(1, "a b"), (4, "z")]
    assert kept.count() == 3


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    real = m.content_keys
    rows = [(1, "ab"), (2, "a b"), (3, "cd"), (4, "cd")]
    monkeypatch.setattr(m, "content_keys", lambda d: real(d).withColumn("h", F.unhex(F.lit("00"))))
    monkeypatch.setattr(m.F, "md5", lambda c: F.lit("00"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in m.exact_dedup(docs(spark, rows)).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 2), 4: (3, 2)}


def test_empty_table(spark):
    assert m.exact_dedup(docs(spark, [])).collect() == []
