import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from curator.llm import substring_dedup as m
from curator.llm.arrow import U64, mix
from tests.llm.common import SF, docs, words


def brute(rows, size=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = Counter()
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_table_matches_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(m.substring_dedup(d)) == brute([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])


def cases():
    p, q = words(1, 90), words(2, 35)
    rows = [(1, " ".join(words(10, 40) + p + words(11, 20))), (2, " ".join(p)), (3, " ".join(words(12, 9) + p[20:60])), (4, " ".join(q)), (5, "\n".join(words(13, 50) + q)), (6, " ".join(q[1:])),
            (7, "a " * 200), (8, "a b " * 60), (9, None), (10, ""), (11, " \t"), (12, " ".join(p[:50]) + " x " + " ".join(p[50:])), (13, " ".join(words(14, 3000) + p[5:45] + words(15, 3000))),
            (14, "é ü " * 17), (14, "é ü " * 17), (None, " ".join(words(16, 60))), (15, " ".join(words(17, 34))), (16, " ".join(words(17, 34)))]
    return rows + [(100 + i, " ".join(words(200 + i, i % 40) + p[i % 30 : 40 + i % 50] + words(300 + i, 30))) for i in range(60)]


@pytest.mark.parametrize("rounds", [1, 5, 9])
def test_cases_match_brute_force(spark, rounds):
    rows = cases()
    assert got(m.substring_dedup(docs(spark, rows), rounds=rounds)) == brute(rows)


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(0)
    for _ in range(20):
        h = mix(r.integers(0, 4, 400).astype(U64))
        w = m.windows(h, np.array([0, 150, 150, 400]), 12, 4)
        by_words = {}
        for i, p in enumerate(w.word):
            by_words.setdefault(h[p : p + 12].tobytes(), set()).add((int(w.name[i]), int(w.offset[i])))
        assert all(len(x) == 1 for x in by_words.values())


def test_text_and_ranges(spark):
    p = words(1, 36)
    got = m.substring_dedup(docs(spark, [(1, " ".join(["x", *p])), (2, " ".join([*p, "y"]))]), keep_text=True).collect()
    assert sorted((r.doc_id, r.kept_text, tuple(r.removed)) for r in got) == [(1, "x", (1, 37)), (2, "y", (0, 36))]


def test_empty_table(spark):
    assert m.substring_dedup(docs(spark, [])).collect() == []


def thue_morse(n, a, b):
    return [b if i.bit_count() & 1 else a for i in range(n)]


def test_made_collisions_of_sums_remove_nothing(spark):
    w, x, y = words(1, 34), "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    rows = [(1, " ".join([*w, x])), (2, " ".join([*w, y])), (3, " ".join(thue_morse(2048, "p", "q"))), (4, " ".join(thue_morse(2048, "q", "p")))]
    result = got(m.substring_dedup(docs(spark, rows)))
    assert result == brute(rows)
    assert {n for d, _, n, _ in result if d in (1, 2)} == {0}


def test_digests_tell_words_with_one_name_apart(monkeypatch):
    monkeypatch.setattr(m.xxhash, "xxh3_64_intdigest", len)
    t = m.Text(*m.utf8(m.pa.array([" ".join(f"{c}{x}" for c in "abcdefghijkl") for x in "ab"])))
    assert len(set(t.names().tolist())) == 1
    assert len(set(t.digests(np.array([0, 12]), 12))) == 2


def test_digests_are_of_words():
    t = m.Text(*m.utf8(m.pa.array(["a  b c d", "a b\tc d", None, "a b c d"])))
    assert len(set(t.digests(np.array([0, 4, 8]), 4))) == 1 and len(set(t.digests(np.array([0, 1]), 3))) == 2
    assert len(set(t.digests(np.array([0, 0]), 4, [b"1", b"2"]))) == 2


def test_repeated_rows_and_clashing_columns(spark):
    p = " ".join(words(1, 60))
    rows = [(1, p)] * 30 + [(2, p + " end"), (3, " ".join(words(2, 60)))]
    d = docs(spark, rows).selectExpr("*", "1 as tie", "2 as at", "3 as name", "4 as _id", "5 as maybe_member")
    assert got(m.substring_dedup(d)) == brute(rows)
