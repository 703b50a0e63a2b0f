import pandas as pd

from curator.operators import selection
from curator.plans import ledger

SF = "/root/testdata/sf0.01"


def test_every_candidate_has_a_fate(spark):
    got = {r.idx: r.fate.split(",") for r in ledger.deferral_fate(spark, SF).collect()}
    assert set(got) == {r.idx for r in ledger.candidates(spark, SF).collect()}
    assert all(f[-1] in ("accepted", "rejected") for f in got.values())


def test_steps_drain_lane_and_queue():
    for n in [*range(40), 500]:
        rows = pd.DataFrame({"idx": range(n), "score": [(7 * i % 11) / 11 - i / 1e4 for i in range(n)]})
        got = selection.plan_lane(rows, selection.steps_to_drain(n, 2, 5))
        last = got.groupby("idx").status.last()
        assert len(last) == n and not (last == "deferred").any()
