import random

import numpy as np
import pytest

from curator.llm import similar as m
from curator.llm.simhash import keep_one
from tests.llm.common import SF, docs, words


def brute(rows, size=5, least=0.8):
    """{doc_id: smallest doc_id of its group}, by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return sorted((d, first[find(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id, r.component_id) for r in df.collect())


def test_all_similar_pairs_of_the_tables(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        d = spark.read.parquet(f"{sf}/documents.parquet")
        want = brute([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
        assert got(m.similar_groups(d)) == want
    assert {(255, 1), (944, 709), (875, 582), (770, 643)} <= set(want)  # 7 to 9 bits of a SimHash apart


def edited(base, share, seed):
    r, w = random.Random(seed), list(base)
    for i in r.sample(range(len(w)), int(share * len(w))):
        w[i] = f"x{seed}y{i}"
    return " ".join(w)


def rows():
    hot = words(50, 20)
    out = [(10 + i, edited(words(i % 5, 150), (i % 9) / 200, i)) for i in range(90)]
    out += [(200 + i, " ".join(hot + words(300 + i, 12 + i % 7))) for i in range(60)]
    return out + [(1, None), (2, ""), (3, " \n"), (900, "One two"), (901, "one TWO"), (902, "one two three four five"), (903, "one two three four five six"), (904, " ".join(words(3, 9000)))]


def test_groups_match_all_pairs(spark, monkeypatch):
    want = brute(rows())
    assert got(m.similar_groups(docs(spark, rows()))) == want
    assert got(m.similar_groups(docs(spark, rows()), 3, 0.6)) == brute(rows(), 3, 0.6)
    monkeypatch.setattr(m, "TILE", 20)  # buckets over the limit are dealt to tiles
    monkeypatch.setattr(m, "PART", 1)
    monkeypatch.setattr(m, "CLUSTER", 1000)  # and clusters
    assert got(m.similar_groups(docs(spark, rows()))) == want


def test_one_of_each_group_stays(spark):
    base = words(1, 200)
    near = [(7, " ".join(base)), (4, " ".join([*base[:100], "other", *base[101:]])), (9, " ".join(words(2, 200)))]
    kept = keep_one(docs(spark, near), size=5, least=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 9]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    with pytest.raises(ValueError):
        m.similar_groups(docs(spark, near), least=0)


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(1)
    sets = []
    for k in range(40):
        s = np.unique(r.integers(0, 2**63, (400, 900, 4000)[k % 3]).astype(np.uint64))
        sets += [s[: int(len(s) * (0.5 + k / 80))], s[k:]]
    sig = m.Signatures([m.parities(s) for s in sets])
    i, j = (x.ravel() for x in np.indices((80, 80)))
    apart = sig.apart(i, j)
    assert len(np.unique(sig.length)) >= 3
    for a, b, n in zip(i, j, apart):
        assert n <= len(np.setxor1d(sets[a], sets[b])) and (a != b or not n)
    assert all(apart[80 * k + k + 1] > 0.8 * len(np.setxor1d(sets[k], sets[k + 1])) for k in range(70, 80, 2))  # and are close to a small one


def test_clashing_columns(spark):
    d = docs(spark, rows()).selectExpr("*", *[f"1 as {c}" for c in ("tie", "node", "root", "component_id", "n", "sig", "keys", "k", "of", "tile", "hot")])
    assert got(m.similar_groups(d)) == brute(rows())
    assert keep_one(d, size=5, least=0.8).columns == d.columns


def test_empty_table(spark):
    assert m.similar_groups(docs(spark, [])).collect() == []
