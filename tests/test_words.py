import random
from collections import Counter

from pyspark.sql import functions as F

from curator.functions import text as T
from curator.operators import admission as A
from curator.operators import tokens as K
from curator.operators import words as W

NAMES = [f"w{i}" for i in range(30)]


def made(n=60, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.choice(NAMES) for _ in range(rng.randint(0, 40))]) for i in range(n)] + [(n, []), (n + 1, None), (n + 2, ["w1"] * 500)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unknown_words_without_a_row_for_each(spark, monkeypatch):
    """words are counted in their arrays."""
    monkeypatch.setattr(W, "PIECE", 50)
    rows = made()
    d = spark.createDataFrame(rows, "doc_id long, w array<string>").repartition(3)
    counts = Counter(w for _, ws in rows for w in ws or [])
    vocab = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:7]
    got = A.vocabulary(d, 7)
    assert [r.word for r in got.collect()] == vocab and "Generate" not in plan(got)
    rates = A.unk_rates(d, got)
    assert {r.doc_id: (r.n_words, r.n_unk) for r in rates.collect()} == {i: (len(ws or []), sum(w not in vocab for w in ws or [])) for i, ws in rows}
    assert "Generate" not in plan(rates)


def test_grams_without_a_row_for_each(spark, monkeypatch):
    """n-grams of several lengths, searched in one block and in many, across pieces."""
    monkeypatch.setattr(W, "PIECE", 64)
    rows, rng = made(), random.Random(5)
    d = spark.createDataFrame(rows, "doc_id long, w array<string>").repartition(3)
    items = [(0, "w1 w2"), (1, "w1"), (2, "w1 w1 w1"), (3, "not here"), (4, "")] + [(5 + i, " ".join(ws[2:17])) for i, (_, ws) in enumerate(rows[:8])] + [(20, " ".join(rng.choice(NAMES) for _ in range(13)))]
    fp = A.eval_fingerprints(spark.createDataFrame(items, "item_id long, text string"))
    grams = {tuple(ws[j : j + k]) for ws in (t.split() for _, t in items) for k in [min(13, len(ws))] if k for j in range(len(ws) - k + 1)}
    want = {i: n for i, ws in rows for n in [sum(any(tuple((ws or [])[j : j + len(g)]) == g for j in range(len(ws or []))) for g in grams)] if n}
    for most in (200_000, 5):
        monkeypatch.setattr(A, "GRAMS", most)
        got = A.contamination_hits(d, fp)
        assert {r.doc_id: r.hits for r in got.collect()} == want and "Generate" not in plan(got)


def test_ids_are_made_in_bounded_batches(spark):
    """encoding holds Arrow arrays of at most 500 rows or 4 MB, no lists of words."""
    rows = made()
    d = spark.createDataFrame(rows, "doc_id long, w array<string>")
    a = K.Adapter(["w3", "w1", "w2"])
    ids = {r.doc_id: (r.ids, r.decoded) for r in a.decode(a.encode(d)).collect()}
    number = {"w3": 1, "w1": 2, "w2": 3}
    assert ids == {i: (None, None) if ws is None else ([number.get(w, 0) for w in ws], " ".join(w if w in number else "<unk>" for w in ws)) for i, ws in rows}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4_000_000


def test_scripts_of_mixed_texts(spark):
    """characters are counted only where there are others than Latin ones."""
    texts = ["abc", "1 2", "", None, "ab कख", "abc कख", "ab कख", "س", "é", "١ abc", "తె అ b"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    count = lambda t, chars: sum(any(a <= c <= b for a, b in zip(chars[0::3], chars[2::3])) for c in t or "")
    want = [max(((count(t, c), -i, n) for i, (n, c) in enumerate(T.SCRIPTS.items())))[2] if any(count(t, c) for c in T.SCRIPTS.values()) else "Zyyy" for t in texts]
    out = d.select(T.script_of(F.col("t")).alias("s"))
    assert [r.s for r in out.collect()] == want and "RLIKE" in plan(out)
