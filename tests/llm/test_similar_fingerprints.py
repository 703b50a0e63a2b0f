import numpy as np
import pytest

import corpus_pipeline
from curator.llm import similar as m
from curator.llm.simhash import bucket_keys, fold, near_duplicates, shingle_digests
from tests.llm.common import docs, words
from tests.llm.test_similar import brute, edited, got, rows

NONE = "a long, b long"


def fingerprint(text):
    raw = shingle_digests(text.encode(), 5)
    return int(fold(np.frombuffer(raw, ">u8").astype(np.uint64), np.array([len(raw) // 8]))[0])


def pairs():
    """Copies of 40 texts with one to five of 150 words replaced."""
    return [(100 * i + k, edited(words(i, 150), k / 150, i)) for i in range(40) for k in (0, 1 + i % 5)]


def test_links_come_from_fingerprints_and_the_rest_from_the_exact_search(spark, monkeypatch):
    text = dict(pairs())
    bits = {i: (fingerprint(text[100 * i]) ^ fingerprint(text[100 * i + 1 + i % 5])).bit_count() for i in range(40)}
    similar = {c // 100 for d, c in brute(pairs()) if d != c}
    near, far = ({i for i in similar if (bits[i] <= 10) == x} for x in (True, False))
    assert len(near) > 5 and far
    linked = lambda: {c // 100 for d, c in got(near_duplicates(docs(spark, pairs()), size=5, most=10, least=0.8)) if d != c}
    assert linked() == similar
    with monkeypatch.context() as p:
        p.setattr(m, "beyond", lambda signed, most, least: spark.createDataFrame([], NONE))
        assert linked() == near
    with monkeypatch.context() as p:
        p.setattr(m, "near_fingerprints", lambda signed, most, least: spark.createDataFrame([], NONE))
        assert linked() == far


def test_the_stage_asks_for_fingerprints(spark, monkeypatch):
    asked, own = [], m.near_fingerprints
    monkeypatch.setattr(m, "near_fingerprints", lambda signed, most, least: asked.append((most, least)) or own(signed, most, least))
    kept = corpus_pipeline.near_copies(spark, docs(spark, rows()), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in brute(rows()) if d == c)
    assert asked == [(10, 0.8)]


@pytest.mark.parametrize("most", [0, 14])
def test_groups_do_not_depend_on_the_radius(spark, monkeypatch, most):
    monkeypatch.setattr(m, "WIDE", 20)  # buckets over the limit are dealt to tiles
    assert got(m.similar_groups(docs(spark, rows()), most=most)) == brute(rows())
    with pytest.raises(ValueError):
        m.similar_groups(docs(spark, rows()), most=63)


def groups(count, a, b):
    root = np.arange(count)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root.tolist()
        root = new


def test_within_connects_all_near_pairs(monkeypatch):
    r = np.random.default_rng(5)
    bucket = np.sort(np.append(r.integers(0, 40, 400), np.full(60, 7)))
    fp = r.integers(0, 2**64, 460, dtype=np.uint64)
    fp[np.flatnonzero(bucket == 7)[:60]] = np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)  # a dense bucket
    fp[r.integers(0, 460, 100)] = 5
    n = r.integers(1, 30, 460)
    order = np.lexsort((n, bucket))
    bucket, fp, n = bucket[order], fp[order], n[order]
    i, j = (x.ravel() for x in np.triu_indices(460, 1))
    ok = (bucket[i] == bucket[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= 6) & (np.minimum(n[i], n[j]) >= 0.8 * np.maximum(n[i], n[j]) - 1e-9)
    for size in (1 << 20, 50):
        monkeypatch.setattr(m, "PAIRS", size)
        a, b = m.within(bucket, fp, n, 6, 0.8)
        assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} <= set(zip(i[ok].tolist(), j[ok].tolist()))
        assert groups(460, a, b) == groups(460, i[ok], j[ok])
    assert len(m.within(bucket[:1], fp[:1], n[:1], 6, 0.8)[0]) == 0


def test_near_fingerprints_share_a_bucket():
    r = np.random.default_rng(6)
    a = r.integers(0, 2**64, 500, dtype=np.uint64)
    for most in (3, 10, 14):
        flip = [np.bitwise_or.reduce(np.uint64(1) << r.choice(64, most, replace=False).astype(np.uint64)) for _ in a]
        x, y = (bucket_keys(z, most, most + 2) for z in (a, a ^ np.array(flip, np.uint64)))
        assert (x == y).any(axis=1).all()
        assert (x[0] == x[1:]).any(axis=0).mean() < 1
