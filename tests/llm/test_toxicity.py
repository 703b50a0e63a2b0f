import math
import re

import numpy as np

from curator.llm import toxicity as m
from tests.llm.common import docs, words

LABELS = "doc_id long, toxic int, quality int"


def corpus(n=400):
    rows, marks = [], []
    for i in range(n):
        w = words(i, 30 + i % 50)
        toxic = i % 4 == 0
        for k in range(9, len(w), 10):
            w[k] += "."
        if toxic:
            w[11 + i % 12] = ["Vile", "rotten", "grim!!"][i % 3]
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic), 1))
    return rows, marks


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = m.detect(d, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    got = np.array([(r.predicted, r.toxic) for r in rows])
    assert len(got) > 500
    hit = (got[:, 0] & got[:, 1]).sum()
    assert hit / got[:, 0].sum() > 0.9 and hit / got[:, 1].sum() > 0.6, got.sum(axis=0)


def test_sentences_are_found_from_document_labels(spark):
    rows, marks = corpus()
    extra = [(1000, None), (1001, ""), (1002, "12 !?"), (1003, f"{' '.join(words(5, 9))}. é so vile, ba. {' '.join(words(6, 5))}"), (1003, "x"), (None, "rotten"), (1004, " ".join(words(7, 30_000)))]
    w, b = m.learn(docs(spark, rows), spark.createDataFrame([*marks, (3, None, 1), (None, 1, 1), (5000, 1, 1)], LABELS))
    got = m.score(docs(spark, [*rows, *extra]), w, b).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got if r.doc_id != 1003}
    right = [(by[i].score >= 0.5) == bool(t) for i, t, _ in marks]
    assert np.mean(right) > 0.97
    assert by[1000].score == by[1001].score == by[1002].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    text = extra[3][1]
    found = max((r for r in got if r.doc_id == 1003), key=lambda r: r.score).offending
    assert [text[s.start : s.end] for s in found] == ["é so vile, ba"]


def test_without_labels(spark):
    rows, _ = corpus(20)
    none = m.detect(docs(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert len(none) == 20 and {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}
    assert m.detect(docs(spark, []), spark.createDataFrame([(1, 1, 1)], LABELS)).collect() == []


def test_scores_match_brute_force(spark):
    rows, marks = corpus(200)
    rows += [(500, "É vile! Rotten\nvile... grim"), (501, "vilest"), (502, None), (503, "a\n\n."), (504, "vilenesses rotten?! x1vile2rotten")]
    w, b = m.learn(docs(spark, rows[:200]), spark.createDataFrame(marks, LABELS), positives=30, negatives=60)
    name = lambda x: int(m.hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
    got = {r.doc_id: r for r in m.score(docs(spark, rows), w, b).collect()}
    for i, text in rows:
        clear = 1.0
        for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
            feats = set()
            for word in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda x: x[0].lower(), sentence)):
                feats |= {name(word)} | {name(word[:k]) ^ k for k in m.BEGINNINGS if len(word) > k}
            slots = {f >> 64 - m.BITS for f in feats}
            if feats:
                clear *= 1 - 1 / (1 + math.exp(-(b + sum(float(w[s]) for s in slots))))
        assert abs(got[i].score - (1 - clear)) < 1e-6, i


def test_likelihood_falls_and_penalty_clears_weights():
    r = np.random.default_rng(1)
    feature, sentence = r.integers(0, 50, 600), np.repeat(np.arange(200), 3)
    document, label = np.repeat(np.arange(50), 4), np.array([1, 0] * 25)
    feature[::12][: 25] = 60  # one sentence of some documents
    label[:] = [int((feature[12 * i : 12 * i + 12] == 60).any()) for i in range(50)]
    w, b = m.fit(feature, sentence, document, label)
    assert w[60] > 5 and (w[:50] > w[60] / 2).sum() == 0 and (w == 0).sum() > (1 << m.BITS) - 60


def test_clashing_columns(spark):
    rows, marks = corpus(60)
    d = docs(spark, rows).selectExpr("*", *[f"1 as {c}" for c in ("toxic", "score", "_id", "one", "rank", "r", "offending")])
    labels = spark.createDataFrame(marks, LABELS).selectExpr("*", "'x' as text", "1 as rank", "2 as r")
    assert m.detect(d, labels).count() == 60
