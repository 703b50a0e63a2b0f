import random

import numpy as np

from curator.llm import similar as m
from tests.llm.common import docs, words
from tests.llm.test_similar import brute, edited, got
from tests.llm.test_similar_fingerprints import groups


def signed(spark, fp, n):
    return spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(n, fp.view(np.int64)))], "node long, n int, fp long")


def test_a_group_of_near_fingerprints_has_few_links_more_than_rows(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**64, 3, dtype=np.uint64)
    flip = [np.bitwise_or.reduce(np.uint64(1) << r.choice(64, 3, replace=False).astype(np.uint64)) for _ in range(900)]
    fp = np.unique(np.repeat(base, 300) ^ np.array(flip, np.uint64))
    n = np.full(len(fp), 100)
    links = m.near_fingerprints(signed(spark, fp, n), 10, 0.8).distinct().collect()
    a, b = (np.array([x[k] for x in links]) for k in (0, 1))
    i, j = np.triu_indices(len(fp), 1)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= 10
    assert groups(len(fp), a, b) == groups(len(fp), i[near], j[near])
    assert len(links) < 3 * len(fp)  # 17,030 for 895 rows when each of 66 buckets had links of its own


def test_stars_connect_what_links_connect():
    r = np.random.default_rng(3)
    for count in (0, 1, 40, 200):
        a, b = r.integers(0, 200, (2, count))
        x, y = m.stars(a, b)
        assert groups(200, a, b) == groups(200, x, y)
        assert len(y) == len(set(y.tolist())) and (x < y).all()
    chain = np.arange(5000)
    assert (m.stars(chain + 1, chain)[0] == 0).all()


def test_partners_by_place_lose_no_first_common_shingle():
    r = random.Random(4)
    for least in (0.5, 0.8, 1.0):
        sets = []
        for g in range(30):
            base = sorted(r.sample(range(1000), r.randint(1, 90)))
            sets += [base, sorted({*base[: -1 - g % 3], *r.sample(range(1000), g % 4)} or {0}), sorted(r.sample(base, max(1, len(base) - g % 5)))]
        count = [int(m._first(len(s), least)) for s in sets]
        rows = sorted((k, (len(s) << 8) + (p << 8) // c, i) for i, (s, c) in enumerate(zip(sets, count)) for p, k in enumerate(s[:c]))
        k, at, of = (np.array(x, np.int64) for x in zip(*rows))
        kept = {(int(k[x]), int(of[x])) for x in m.partnered(k, at, least)}
        assert len(kept) < len(rows)
        similar = 0
        for i, s in enumerate(sets):
            for j in range(i):
                t = set(sets[j])
                if len(t & set(s)) >= least * len(t | set(s)) - 1e-9:
                    first = min(t & set(s))
                    assert (first, i) in kept and (first, j) in kept
                    similar += 1
        assert similar


def test_partners_by_place_drop_far_places():
    full = lambda n, place: (n << 8) + place
    k = np.array([1, 1, 2, 2, 3, 4, 4])
    at = np.array([full(100, 0), full(100, 255), full(100, 100), full(100, 120), full(100, 0), full(70, 0), full(100, 0)])
    assert m.partnered(k, at, 0.8).tolist() == [2, 3]
    many = np.full(m.PAIRED + 1, 7)
    assert len(m.partnered(many, np.full(len(many), full(100, 255)), 0.8)) == len(many)  # too many to compare: all stay
    assert len(m.partnered(many[1:], np.full(len(many) - 1, full(100, 255)), 0.8)) == 0


def test_names_that_clash_change_no_group(spark, monkeypatch):
    rows = [(100 * i + k, edited(words(i, 150), k / 150, i)) for i in range(20) for k in (0, 1 + i % 5)]
    monkeypatch.setattr(m, "SHINGLE_BITS", 8)
    monkeypatch.setattr(m, "BUCKET_BITS", 3)
    assert got(m.similar_groups(docs(spark, rows))) == brute(rows)
    monkeypatch.setattr(m, "near_fingerprints", lambda signed, most, least: spark.createDataFrame([], "a long, b long"))
    assert got(m.similar_groups(docs(spark, rows), most=0)) == brute(rows)
