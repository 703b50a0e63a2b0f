import re

import pytest

from curator.llm import decontaminate as m
from tests.llm.common import docs, words
from tests.llm.test_decontaminate import bench

ITEMS = [(i, " ".join(words(i, 20 + 4 * i))) for i in range(9)]


def found(texts, items=ITEMS):
    pieces = m.Pieces.of(items)
    return {(d, pieces.items[pieces.item[o]]) for d, o, *_ in m.regions(texts, pieces)}


def surrounded(w, k):
    return " ".join([*words(1000 + k, k % 11), *w, *words(2000 + k, k % 7)])


def test_thirteen_words_in_a_row_are_found_at_every_phase():
    parts = [(i, t.split()[k : k + 13]) for i, t in ITEMS for k in range(len(t.split()) - 12)]
    parts = [(i, w) for i, w in parts if len("".join(w)) >= m.LEAST]
    texts = [surrounded(w, k) for k, (_, w) in enumerate(parts)]
    got = found(texts)
    assert len(parts) > 100 and {(k, i) for k, (i, _) in enumerate(parts)} <= got
    assert all(parts[d][0] == i for d, i in got)


@pytest.mark.parametrize("other", ["z", "zwuvwxyzwuvwxyzwuvwxyzwu"])
def test_one_replaced_word_is_found_at_every_place(other):
    parts = []
    for i, t in ITEMS:
        w = t.split()
        for k in range(len(w) - 12):
            for j in range(1, 12):
                u, v = len("".join(w[k : k + j])), len("".join(w[k + j + 1 : k + 13]))
                if max(u, v) >= m.Q and u + v + len(w[k + j]) >= m.LEAST:
                    parts.append((i, [*w[k : k + j], other, *w[k + j + 1 : k + 13]]))
    texts = [surrounded(w, k) for k, (_, w) in enumerate(parts)]
    assert len(parts) > 1000 and {(k, i) for k, (i, _) in enumerate(parts)} <= found(texts)


def test_runs_of_the_table(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    parts = [(i, t.split()[k : k + 13]) for i, t in items for k in range(0, len(t.split()) - 12, 3)]
    assert {(k, i) for k, (i, _) in enumerate(parts)} <= found([surrounded(w, k) for k, (_, w) in enumerate(parts)], items)


def test_scripts_without_spaces_and_clean_texts():
    item = "".join(words(70, 90))
    assert {d for d, _ in found([f"x{item[k : k + 95]}x" for k in range(0, len(item) - 95)], [(1, item)])} == set(range(len(item) - 95))
    assert not found([" ".join(words(5000 + k, 300)) for k in range(40)])


def test_place_of_a_replaced_word(spark):
    w = words(31, 13)
    text = " ".join(["Lead", *w[:6], "Qqqqqqqqqqq", *w[7:], "end"])
    (r,) = m.search(docs(spark, [(1, text)]), bench(spark, [(4, " ".join(w))])).collect()
    assert (r.item_id, text[r.start : r.end]) == (4, re.search("(?<=Lead ).*(?= end)", text)[0])
