import numpy as np

from curator.llm import language as m
from tests.llm.common import docs, words

SYLLABLES = {"xx": "ka ko ku sa so su ta to".split(), "yy": "ber gen ung sch ein ach".split(), "zz": "лав ро ди мен ста".split()}


def corpus(n=240):
    names = list(SYLLABLES)
    return [(i, " ".join(words(i, 5 + i % 60, SYLLABLES[names[i % 3]])), None if i % 11 == 0 else names[i % 3]) for i in range(n)]


def test_held_out_accuracy_on_the_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = m.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_cases(spark):
    rows = [*corpus(), (1000, None, "xx"), (1001, "", "xx"), (1002, "123 !?", "yy"), (1003, "kasoka", None), (1003, "kasoka", None), (None, "gen ung", None), (1004, "K", None), (1005, " ".join(words(9, 40_000, SYLLABLES["zz"])), None)]
    got = m.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1005)] == ["und", "und", "und", "xx", "yy", "zz"]
    assert by[1000].score == 0 and by[1004].lang_pred in SYLLABLES
    right = [by[i].lang_pred == list(SYLLABLES)[i % 3] for i in range(240)]
    assert np.mean(right) > 0.97


def test_labels_are_not_inputs(spark):
    f = m.learn(docs(spark, corpus()))
    a = {r.doc_id: (r.lang_pred, r.score) for r in m.predict(docs(spark, corpus(60)), f).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in m.predict(docs(spark, [(i, t, "qq") for i, t, _ in corpus(60)]), f).collect()}
    assert a == b


def test_masks_return_all_languages_of_a_gram():
    h, _, _ = m.grams(["kasa"])
    f = m.Filters.of({"a": h, "b": h[:2], "c": np.zeros(0, np.uint64)})
    share, letters = f.shares(["kasa", "", "qqq"])
    assert letters.tolist() == [4, 0, 3] and share[0, 0] == 1 and 0 < share[0, 1] < 1 and share[0, 2] == 0


def test_filter_and_empty_table(spark):
    rows = [*corpus(), (1000, None), (1001, "..."), (1002, "漢字" * 30)]
    kept = m.keep_known(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == set(range(240))
    assert m.identify(docs(spark, [])).collect() == []


def test_gram_rows_do_not_depend_on_partitions(spark):
    d = docs(spark, corpus()).select("lang", "text").where("lang is not null")
    few, many = m.gram_counts(d.coalesce(1)), m.gram_counts(d.repartition(97))
    assert few.count() == many.count() == sum(len(np.unique(m.grams([t])[0])) for _, t, lang in corpus() if lang)
    total = lambda c: {(r.lang, r.gram): r.n for r in c.groupBy("lang", "gram").sum("n").toDF("lang", "gram", "n").collect()}
    assert total(few) == total(many)


def test_more_languages_than_a_mask_word(spark):
    letters = "abcdefghij"
    own = {f"l{i:02}": f"{letters[i // 10]}{letters[i % 10]}x" for i in range(70)}
    rows = [(i * 10 + k, " ".join(s * (3 + k) for _ in range(20)), name) for i, (name, s) in enumerate(own.items()) for k in range(4)]
    got = {r.doc_id: r.lang_pred for r in m.identify(docs(spark, rows)).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.97


def test_shares_match_brute_force(spark):
    f = m.learn(docs(spark, corpus()))
    for text in ("kasoka su", "gen ung ach kaso", "лаврод", "x", "", "Ka, SU!"):
        h = m.grams([text])[0]
        masks = [{n for i, n in enumerate(f.names) if all(int(f.planes[0][a[j]]) >> i & 1 for a in m.probes(h))} for j in range(len(h))]
        for i, n in enumerate(f.names):
            share = sum(n in x for x in masks) / max(len(h), 1)
            assert abs(f.shares([text])[0][0, i] - min(max((share - f.wrong[i]) / (1 - f.wrong[i]), 0), 1)) < 1e-9


def test_clashing_columns(spark):
    d = docs(spark, corpus(60)).selectExpr("*", "1 as tie", "2 as r", "3 as most", "4 as taught", "5 as rank", "6 as _row")
    assert m.identify(d).count() == 60
    assert m.keep_known(d).columns == d.columns
