import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from curator.llm import simhash as m
from tests.llm.common import SF, docs, words


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fp, dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4) + i + 1:
            parent[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{fp[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_table_matches_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert got(m.near_duplicates(d)) == brute(rows)


def near_copies(n):
    base = words(1, 120)
    out = []
    for i in range(n):
        w = list(base)
        w[i % 120] = f"x{i}"
        w[(7 * i + 3) % 120] = f"y{i}"
        out.append((i + 5, " ".join(w)))
    return out


def test_cases_and_dense_groups(spark, monkeypatch):
    rows = [*near_copies(150), (1, None), (2, ""), (3, " \n"), (900, "One"), (901, "one two THREE four"), (902, "one two three four"), (903, "É É é é a"), (904, " ".join(words(3, 30_000))), (7, near_copies(3)[2][1])]
    want = brute(rows)
    assert got(m.near_duplicates(docs(spark, rows))) == want
    monkeypatch.setattr(m, "TILE", 20)  # buckets over the limit are dealt to tiles
    assert got(m.near_duplicates(docs(spark, rows))) == want


def test_fold_counts_past_255():
    h = np.array([5] * 700 + [2] * 699 + [9], dtype=np.uint64)
    assert m.fold(h, np.array([0, 1399, 0, 1])).tolist() == [0, 5, 0, 9]


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, " ".join(words(5, 50)))]
    kept = m.keep_one(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table(spark):
    assert m.near_duplicates(docs(spark, [])).collect() == []


def test_coordinates_and_candidates(spark):
    r = np.random.default_rng(3)
    fp = r.integers(0, 2**64, 300, dtype=np.uint64)
    for k in range(150):  # pairs at 0 to 9 bits
        fp[150 + k] = fp[k] ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, k % 10, replace=False).astype(np.uint64), initial=np.uint64(0))
    fp = np.unique(fp)
    d = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for most, blocks in ((4, 6), (4, 7), (2, 6), (8, 10)):
        column = d.select("fp", *[m.coordinates(F.col("fp"), x).alias(f"c{i}") for i, x in enumerate(m.masks(blocks))]).collect()
        want = m.table(np.array([c.fp for c in column], np.int64).view(np.uint64), blocks).astype(int)
        assert all(c[1 + b] >> 4 * p & 15 == want[i, b, p] for i, c in enumerate(column) for b in range(blocks) for p in range(m.PIVOTS))
        near = {(int(a), int(b)) for i, a in enumerate(fp) for b in fp[i + 1 :] if int(a ^ b).bit_count() <= most}
        rows = {}
        for x in m.buckets(d, most, blocks).collect():
            rows.setdefault(x.bucket, set()).add(x.fp % 2**64)
        candidates = {(a, b) for x in rows.values() for a in x for b in x if a < b}
        assert near and near <= candidates and len(candidates) < 3 * len(near) + 40
        got = {tuple(sorted((x.a % 2**64, x.b % 2**64))) for x in m.links(d, most, blocks).collect()}
        assert got == near  # no three of these are near each other, so the forest is all links


def test_discarded_pairs_are_never_near():
    r = np.random.default_rng(4)
    a = r.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a ^ (r.integers(0, 2**64, 2000, dtype=np.uint64) & r.integers(0, 2**64, 2000, dtype=np.uint64) & r.integers(0, 2**64, 2000, dtype=np.uint64))
    low = np.abs(m.table(a, 6) - m.table(b, 6)).max(axis=2).sum(axis=1)
    assert (low <= np.bitwise_count(a ^ b)).all() and low.max() > 8


def test_blocks_grow_with_the_fingerprints():
    assert [m.blocks_for(n) for n in (0, 10**6, 10**9, 10**10)] == [6, 6, 7, 8]


def test_other_shingles_and_bits(spark):
    base = words(1, 60)
    rows = [(k + 1, " ".join([*base[:k], "other", *base[k + 1 :]])) for k in range(0, 60, 7)] + [(500, " ".join(words(2, 60))), (None, " ".join(base))]
    groups = {r.doc_id: r.component_id for r in m.near_duplicates(docs(spark, rows), size=2, most=12).collect()}
    assert set(groups.values()) == {1, 500} and groups[None] == 1


def test_clashing_columns(spark):
    d = docs(spark, near_copies(6)).selectExpr("*", "1 as tie", "2 as fp", "3 as node", "4 as component_id", "5 as root", "6 as bucket", "7 as n")
    assert got(m.near_duplicates(d)) == brute(near_copies(6))
    assert m.keep_one(d).columns == d.columns
