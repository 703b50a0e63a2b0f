import random
from decimal import Decimal

import numpy as np

from curator.llm import decontaminate as m
from tests.llm.common import SF, docs, words


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(texts, pieces):
    """All (text, piece) with at most the budget of edits, by full alignment."""
    out = set()
    for d, t in enumerate(texts):
        c = m.compared([t])[0]
        for o, x in enumerate(pieces.chars):
            row = np.zeros(len(c) + 1, int)
            for i, ch in enumerate(x, 1):
                new = np.empty_like(row)
                new[0] = i
                diag = np.minimum(row[:-1] + (c != ch), row[1:] + 1)
                for j in range(len(c)):
                    new[j + 1] = min(diag[j], new[j] + 1)
                row = new
            if row.min() <= pieces.edits[o]:
                out.add((d, o))
    return out


def edited(text, n, seed):
    r = random.Random(seed)
    t = list(text)
    for _ in range(n):
        i = r.randrange(len(t))
        t[i : i + r.randint(0, 1)] = [r.choice("abcxyz")] * r.randint(0, 1)
    return "".join(t)


def test_regions_match_full_alignment():
    items = [(i, " ".join(words(i, 12 + 3 * i))) for i in range(8)]
    pieces = m.Pieces.of(items)
    texts = [f"{' '.join(words(100 + i, i % 9))} {edited(items[i % 8][1], i % 7, i)} {' '.join(words(200 + i, 5))}" for i in range(40)]
    texts += ["", "x", items[3][1][:70], items[5][1].upper().replace(" ", " - "), " ".join(words(77, 300))]
    found = {(d, o) for d, o, *_ in m.regions(texts, pieces)}
    assert found == brute(texts, pieces)
    assert found


def test_long_lists_of_hits_are_counted_in_parts(monkeypatch):
    items = [(i, "abcdefghijkl" * 9) for i in range(3)]
    pieces, texts = m.Pieces.of(items), ["abcdefghijkl" * 20, "zz"]
    want = sorted(m.regions(texts, pieces))
    monkeypatch.setattr(m, "HITS", 50)
    assert sorted(m.regions(texts, pieces)) == want and want


def test_table_finds_all_passages_and_no_others(spark):
    d, b = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in m.search(d, b).collect()}
    strip = lambda t: "".join(c for c in t.lower() if c.isalnum())
    items = [(r.item_id, strip(r.text)) for r in b.collect()]
    exact = {(r.doc_id, i) for r in d.collect() for t in [strip(r.text)] for i, x in items if x in t}
    assert exact and exact <= got
    texts = {r.doc_id: strip(r.text) for r in d.collect()}
    for doc, item in got - exact:  # near or partial: shares half a piece at least, literally
        x = dict(items)[item]
        assert any(x[i : i + 20] in texts[doc] for i in range(len(x) - 19))


def test_cases(spark, monkeypatch):
    item, other = " ".join(words(1, 40)), " ".join(words(2, 40))
    rows = [(1, f"{item}."), (2, None), (3, ""), (4, other[: len(other) // 2 + 60]), (None, item.upper()), (5, item), (5, item), (6, " ".join(words(3, 20_000)) + item), (7, " ".join(words(4, 500))), (8, "yes")]
    b = bench(spark, [(1, item), (2, other), (3, None), (4, ""), (5, "yes"), (None, " ".join(words(9, 30)))])
    got = sorted(((r.doc_id or 0, r.item_id) for r in m.search(docs(spark, rows), b).collect()))
    assert got == [(0, 1), (1, 1), (4, 2), (5, 1), (5, 1), (6, 1), (8, 5)]
    assert sorted((r.doc_id or 0, r.item_id) for r in m.search(docs(spark, rows), b, block_chars=300).collect()) == got
    kept = m.keep_clean(docs(spark, rows), b)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert m.search(docs(spark, []), b).collect() == [] and m.search(docs(spark, rows), bench(spark, [])).collect() == []


def test_short_items():
    pieces = m.Pieces.of([(1, "Paris is the capital of France"), (2, "yes"), (3, "No."), (4, "the capital"), (5, "abcdefghijkl")])
    texts = ["In short: PARIS is the capital, of France!", "Paris is the capital of Francesca", "yes", "yes, it is", "no", "x abcdefghijkl y", "xabcdefghijkl", "abcdefghijklm abcdefghijkl", "The capital!"]
    got = {(d, pieces.items[pieces.item[o]], texts[d][a:b]) for d, o, a, b, _ in m.regions(texts, pieces)}
    assert got == {(0, 1, "PARIS is the capital, of France"), (2, 2, "yes"), (4, 3, "no"), (5, 5, "abcdefghijkl"), (7, 5, "abcdefghijkl"), (8, 4, "The capital")}


def test_types_and_repeats_of_items_and_clashing_columns(spark):
    item, other = " ".join(words(1, 40)), " ".join(words(2, 40))
    d = docs(spark, [(1, item + " " + other), (2, "x")]).selectExpr("*", "1 as tie", "2 as item_id", "3 as pieces", "4 as start", "5 as edits", "6 as keep_one")
    for kind, one, two in (("int", 1, 2), ("string", "a", "b"), ("decimal(5,0)", Decimal(1), Decimal(2))):
        b = spark.createDataFrame([(one, item), (one, item), (one, other), (two, other), (two, None)], f"item_id {kind}, text string").selectExpr("*", "7 as doc_id")
        for size in (m.BLOCK_CHARS, 300):
            assert sorted((r.doc_id, r.item_id) for r in m.search(d, b, size).collect()) == [(1, one), (1, one), (1, two)]
    kept = m.keep_clean(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_items_are_asked_before_pieces_without_loss(monkeypatch):
    items = [(i, " ".join(words(i % 9, 10 + 5 * i))) for i in range(14)] + [(20, "yes"), (21, "Paris is the capital"), (22, ""), (23, None), (24, "x" * 300)]
    texts = []
    for i in range(120):
        w = (items[i % 14][1] or "").split()
        k = i % max(1, len(w) - 13)
        part = w[k : k + 13] if i % 3 else w
        if i % 4 == 1:
            part[len(part) // 2] = "replaced"
        texts.append(" ".join([*words(500 + i, i % 40), edited(" ".join(part), i % 5, i), *words(700 + i, 20)]))
    texts += ["yes", "", "Paris is the capital", "x" * 400, "aa"]
    pieces = m.Pieces.of(items)
    want = {}
    for d, o, start, end, edits in m.regions(texts, pieces):
        want.setdefault((d, int(pieces.item[o])), []).append((start, end, edits))
    block = m.Block.of(items)
    for hits in (m.HITS, 60):
        monkeypatch.setattr(m, "HITS", hits)
        asked = m.candidates(texts, block)
        got = {(d, i): [x[2:] for x in m.regions([texts[d]], block.pieces(i))] for d, i in asked}
        assert {k: sorted(v) for k, v in got.items() if v} == {k: sorted(v) for k, v in want.items()}
    assert len(want) > 60 and len(asked) < 3 * len(want)
