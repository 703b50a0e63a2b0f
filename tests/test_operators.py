import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curator.functions import text as T
from curator.operators import admission, lanes, ledger, packing, selection
from curator.operators.checks import Evidence
from curator.operators.sized import running_sum


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_admission_reasons_in_order(spark):
    long_item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    d = frame(spark, [(1, "plain text here", "ok"), (2, "plain  text here", "ok"), (3, f"x {long_item} y", "ok"), (4, f"x {long_item} y", "bad"), (5, f"has {admission.CANARY} in it", "ok"), (6, "mail a.b@c.de or +91 12345 67890", "ok"), (7, "unk unk", "ok")], "doc_id long, text string, source string")
    b = frame(spark, [(1, long_item), (2, "")], "item_id long, text string")
    unk = frame(spark, [(7, 0.02), (1, 0.01)], "doc_id long, unk_rate double")
    got = {r.doc_id: r for r in admission.admit(d, b, ["ok"], "source", unk).collect()}
    assert {i: list(r.reasons) for i, r in got.items()} == {1: [], 2: ["exact_duplicate"], 3: ["benchmark_contamination"], 4: ["license_not_allowed:bad", "benchmark_contamination"], 5: ["eval_canary"], 6: [], 7: ["tokenizer_coverage"]}
    assert got[2].dup_of == 1 and got[6].pii_redactions == 2 and got[6].redacted == "mail <EMAIL> or <PHONE>"


def test_a_dropped_original_is_no_original(spark):
    d = frame(spark, [(1, "k", False), (2, "k", True), (3, "k", True)], "doc_id long, key string, clean boolean")
    got = {r.doc_id: r.dup_of for r in admission.first_wins(d, "key", F.col("clean")).collect()}
    assert got == {1: None, 2: None, 3: 2}


def test_text_functions(spark):
    d = frame(spark, [("Café D'Été 12",), ("हिन्दी a",), ("éß",), (None,)], "t string")
    rows = d.select(T.words(F.col("t")).alias("w"), T.script_of(F.col("t")).alias("s")).collect()
    assert [r.w for r in rows] == [["café", "d", "été", "12"], ["हिन्दी", "a"], ["éß"], None]
    assert [r.s for r in rows][:3] == ["Latn", "Deva", "Zyyy"]


def test_firewall(spark):
    admission.require_clean(frame(spark, [], "shard_id string"))
    with pytest.raises(admission.FirewallViolation):
        admission.require_clean(frame(spark, [("s",)], "shard_id string"))


def test_running_sum_in_two_levels(spark):
    d = spark.range(500).select(F.lit("a").alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = running_sum(d, ["k"], [F.col("id")], F.col("v"), F.floor(F.col("id") / 13), "before").orderBy("id").collect()
    assert [r.before for r in got] == [sum(i % 7 for i in range(k)) for k in range(500)]


def test_lane_limits(spark):
    rows = [(1, "code", 600, 0), (2, "code", 5000, 0), (3, "agentic", 10, 2), (4, "agentic", 10, 1), (5, "reasoning", 64, 0), (6, "reasoning", 65, 0), (7, "indic", 201, 0), (8, "web", 10**6, 0)]
    d = frame(spark, rows, "doc_id long, lane_hint string, n_tokens long, tool_calls long")
    got = {r.doc_id: (r.lane, r.pool, r.subpool) for r in lanes.assign(d, 512, 4096).collect()}
    assert got == {1: ("long_context", "main", "all"), 2: (None, None, None), 3: ("agentic", "main", "all"), 4: ("agentic", "reserve", "all"), 5: ("reasoning", "main", "low"), 6: ("reasoning", "main", "medium"), 7: ("indic", "main", "B2_B3"), 8: ("web", "main", "all")}


def naive_row(spans, docs, length):
    t, lab, m, s, p = [], [], [], [], []
    for k, (d, a, b) in enumerate(spans):
        tokens, elig = docs[d]
        for i in range(a, b):
            inside = i + 1 < b and elig[i + 1] == 1
            t.append(tokens[i])
            lab.append(tokens[i + 1] if inside else -100)
            m.append(int(inside))
            s.append(k + 1)
            p.append(i - a)
    pad = length - len(t)
    return t + [-1] * pad, lab + [-100] * pad, m + [0] * pad, s + [0] * pad, p + [0] * pad


def test_random_rows_match_a_naive_packer(spark):
    r, length = random.Random(0), 16
    docs = {d: (list(range(100 * d, 100 * d + n)), [r.randint(0, 1) for _ in range(n)]) for d, n in ((d, r.randint(1, 20)) for d in range(10))}
    rows = {}
    for k in range(60):
        spans, room = [], length
        while room > 0 and len(spans) < 4:
            d = r.randrange(10)
            a = r.randrange(len(docs[d][0]))
            b = min(len(docs[d][0]), a + room, a + r.randint(1, 16))
            spans.append((d, a, b))
            room -= b - a
        rows[k] = spans
    s = frame(spark, [(k, i, *x) for k, spans in rows.items() for i, x in enumerate(spans)], "row_id long, ord int, doc_id long, start int, end int")
    d = frame(spark, [(i, t, e) for i, (t, e) in docs.items()], "doc_id long, tokens array<int>, elig array<int>")
    for g in packing.materialize_rows(s, d, length, -1).collect():
        assert (g.tokens, g.labels, g.loss_mask, g.segment_ids, g.position_ids) == naive_row(rows[g.row_id], docs, length)
    pairs = {g.row_id: g.allowed for g in packing.attention_pairs(s, length).collect()}
    for k, spans in rows.items():
        seg = naive_row(spans, docs, length)[3]
        assert pairs[k] == sum(i == j or (seg[i] == seg[j] != 0) for i in range(length) for j in range(i + 1))


def test_bad_spans_raise(spark):
    d = frame(spark, [(1, [1, 2, 3], [1, 1, 1])], "doc_id long, tokens array<int>, elig array<int>")
    for spans in ([(1, 0, 1, 0, 4)], [(1, 0, 1, 0, 3), (1, 1, 1, 0, 3)]):
        with pytest.raises(Exception, match="span out of range|row overflows"):
            packing.materialize_rows(frame(spark, spans, "row_id long, ord int, doc_id long, start int, end int"), d, 5, -1).collect()


def test_policies(spark):
    n = [5, 9, 3, 12, 7, 4]
    d = frame(spark, [("k", i, x) for i, x in enumerate(n)], "k string, i long, n_tokens long")
    rows = {}
    for r in packing.next_fit(d, ["k"], "i", 16).collect():
        rows.setdefault(r.row, []).append(r.n_tokens)
    assert {k: sorted(v) for k, v in rows.items()} == {0: [5, 9], 1: [3, 12], 2: [4, 7]}
    assert [[n[i] for i in row] for row in packing.look_ahead_rows(n, 16, 4)] == [[12, 3], [9, 7], [5, 4]]
    assert packing.best_fit_decreasing(Counter(n), 16) == 3
    with pytest.raises(packing.PackingError):
        packing.look_ahead_rows([17], 16, 4)
    spans = packing.concat_chop(d.withColumn("doc_id", F.col("i")), ["k"], [F.col("i")], F.floor(F.col("i") / 2), 16).collect()
    assert sum(r.end - r.start for r in spans) == sum(n)
    assert pd.Series([r.end - r.start for r in spans]).groupby([r.row for r in spans]).sum().tolist() == [16, 16, 8]


def decide(spark, rows):
    return {(r.lane, r.idx): r for r in selection.decide(frame(spark, rows, "step int, lane string, mode string, idx long, score double, quota int, deferrals int")).collect()}


def test_selector(spark):
    got = decide(spark, [(1, "web", "selector", i, s, 2, 2 * (i == 12)) for i, s in enumerate((0.9, 0.8, 0.7, 0.6, 0.5))])
    assert [got["web", i].status for i in range(5)] == ["accepted", "accepted", "deferred", "rejected", "rejected"]
    assert got["web", 0].cutoff == 0.8
    assert decide(spark, [(1, "web", "selector", i, s, 2, 2) for i, s in enumerate((0.9, 0.8, 0.7))])["web", 2].reason == "defer_expired"


def test_overrides_and_bypass(spark):
    got = decide(spark, [(1, "web", "selector", 0, 0.5, 1, 0), (1, "indic", "always_on", 1, 0.1, 2, 0), (1, "indic", "always_on", 2, 0.9, 2, 0), (1, "code", "keep_all", 3, -1.0, 1, 0), (1, "long_context", "bypass", 4, -1.0, 1, 0), (2, "web", "selector_off", 5, 0.0, 1, 0)])
    assert {i: r.reason for (_, i), r in got.items()} == {0: "opus_selected", 1: "protected_floor_override", 2: "always_on_above_cutoff", 3: "keep_1.0_static_filter_only", 4: "selector_bypass_long_context", 5: "selector_off_anneal"}


def test_deferral_queue_is_first_in_first_out():
    rows = pd.DataFrame({"idx": range(40), "score": [1 - i / 100 for i in range(40)]})
    got = selection.plan_lane(rows, [(s, 2, 5) for s in range(6)])
    assert (got.groupby("step").status.apply(lambda s: (s == "accepted").sum()) == 2).all()
    assert got[(got.idx == 2)].status.tolist() == ["deferred", "accepted"]
    assert got.deferrals.max() <= selection.MAX_DEFERRALS


@pytest.fixture(scope="module")
def chain(spark):
    return ledger.build(frame(spark, [(b, i, f"p{b}{i}") for b in range(2) for i in range(1, 31)], "branch long, ledger_offset long, payload string"))


def test_tampering_is_found(spark, chain):
    assert {r.first_bad for r in ledger.verify(chain).collect()} == {None}
    for change in (
        chain.withColumn("payload", F.when(F.col("ledger_offset") == 7, "x").otherwise(F.col("payload"))),
        chain.where("ledger_offset <> 7").withColumn("payload", F.col("payload")),
        chain.withColumn("record_hash", F.when(F.col("ledger_offset") == 7, "0").otherwise(F.col("record_hash"))),
    ):
        got = ledger.verify(change).collect()
        assert {r.n_valid for r in got} == {6}
        assert ledger.valid_prefix(change).count() == 12


def test_recovery(spark, chain):
    head = {r.branch: r.record_hash for r in chain.where("ledger_offset = 10").collect()}
    c = frame(spark, [(0, 10, head[0]), (1, 10, head[0])], "branch long, ledger_offset long, head_hash string")
    assert {r.branch: (r.kept, r.orphans, r.refused) for r in ledger.recover(chain, c).collect()} == {0: (10, 20, None), 1: (10, 20, "head_differs")}


def test_checks_fail_closed(spark):
    e = Evidence()
    e.check("a", "raises", lambda: 1 / 0)
    e.check("b", "holds", lambda: True)
    e.control("c", "unnoticed", lambda: True)
    assert [e.requirement(r) for r in "abcd"] == [False, True, False, False]
    assert e.table(spark).count() == 3


def one_by_one(lengths, size):
    """Rows of best-fit decreasing, one document at a time."""
    free = []
    for n in sorted(lengths, reverse=True):
        best = min((f for f in free if f >= n), default=None)
        if best is not None:
            free.remove(best)
        free.append((size if best is None else best) - n)
    return len(free)


def test_best_fit_decreasing_by_counts():
    r = random.Random(3)
    for _ in range(400):
        size = r.choice([7, 16, 50])
        n = [r.randint(1, r.choice([3, size])) for _ in range(r.randint(0, 60))]
        assert packing.best_fit_decreasing(Counter(n), size) == one_by_one(n, size), (size, n)


def test_next_fit_in_buckets_and_long_documents(spark):
    r = random.Random(4)
    rows = [(f"k{i % 3}", i, r.choice([0, 1, 3, 8, 16, 17, 40])) for i in range(400)]
    d = frame(spark, rows, "k string, i long, n_tokens long").repartition(5)
    want, got = {}, {}
    for k in ("k0", "k1", "k2"):
        row, free = 0, 16
        for _, i, n in (x for x in rows if x[0] == k):
            if n > 16:
                want[i] = None
                continue
            if n > free:
                row, free = row + 1, 16
            want[i], free = row, free - n
    for bucket in (None, F.floor(F.col("i") / 20), F.floor(F.col("i") / 7), F.lit(0)):
        got = {x.i: x.row for x in packing.next_fit(d, ["k"], "i", 16, bucket).collect()}
        assert got == want
    c = {x.k: x for x in packing.counterfactual(d, ["k"], "i", 16, F.floor(F.col("i") / 30)).collect()}
    for k, x in c.items():
        n = [z for y, _, z in rows if y == k]
        own = sum(-(-z // 16) for z in n if z > 16)
        assert (x.pad_only, x.concat_chop) == (sum(-(-z // 16) for z in n), -(-sum(n) // 16))
        assert x.next_fit == own + 1 + max(want[i] for y, i, z in rows if y == k and z <= 16)
        assert x.best_fit_decreasing == own + one_by_one([z for z in n if 0 < z <= 16], 16)
    longest = {x.i: (x.row, x.ord) for x in packing.best_fit(d, ["k"], "i", 16, 4).collect()}
    assert set(longest) == set(want) and {i for i, x in longest.items() if x == (None, None)} == {i for i, x in want.items() if x is None}
