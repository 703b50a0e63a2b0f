"""Verification: requirements made of checks that are recomputed from tables, with negative controls.

A check that raises is a failed check, never a crash and never a pass. A requirement without checks fails. A control
runs the same check on tampered tables and must fail there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curator.operators import ledger


@dataclass
class Evidence:
    """Results of checks by requirement."""

    rows: list[tuple[str, str, bool, str]] = field(default_factory=list)
    counts: list[tuple[str, str, int, int, bool]] = field(default_factory=list)

    def check(self, requirement: str, name: str, f: Callable[[], bool | DataFrame]) -> bool:
        """Record a check: True, or a DataFrame of violations that must be empty."""
        try:
            got = f()
            bad = got.limit(1).collect() if isinstance(got, DataFrame) else []
            ok, detail = (not bad, str(bad[0].asDict()) if bad else "") if isinstance(got, DataFrame) else (bool(got), "")
        except Exception as e:  # noqa: BLE001  a failing check is a result
            ok, detail = False, f"{type(e).__name__}: {e}"[:200]
        self.rows.append((requirement, name, ok, detail))
        return ok

    def control(self, requirement: str, name: str, f: Callable[[], bool | DataFrame]) -> bool:
        """Record that a check fails on tampered input."""
        probe = Evidence()
        caught = not probe.check(requirement, name, f)
        self.rows.append((requirement, f"control: {name}", caught, "" if caught else "the tampering went unnoticed"))
        return caught

    def count(self, requirement: str, name: str, checked: Callable[[], DataFrame], bad: Callable[[DataFrame], DataFrame], control: bool = False) -> bool:
        """Record how many things were checked and how many of them violate; a control must have violations, any other check none."""
        label = f"control: {name}" if control else name
        try:
            things = checked()
            n, wrong = things.count(), bad(things).count()
            ok, detail = n > 0 and (wrong > 0) == control, ""
        except Exception as e:  # noqa: BLE001  a failing check is a result
            n, wrong, ok, detail = 0, -1, False, f"{type(e).__name__}: {e}"[:200]
        self.rows.append((requirement, label, ok, detail))
        self.counts.append((requirement, label, n, wrong, ok))
        return ok

    def counted(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.counts, "requirement string, check string, n_checked long, n_bad long, ok boolean")

    def requirement(self, name: str) -> bool:
        mine = [ok for r, _, ok, _ in self.rows if r == name]
        return bool(mine) and all(mine)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "requirement string, check string, ok boolean, detail string")


def broken_chain(records: DataFrame) -> DataFrame:
    """Violations: records that break their branch's chain."""
    return ledger.checked(records).where("bad").select("branch", "ledger_offset")


def trained_without_decision(decisions: DataFrame, trained: DataFrame) -> DataFrame:
    """Violations of one accepted decision for each trained row and the other way round; both have (step, idx)."""
    a = decisions.where("status = 'accepted'").groupBy("step", "idx").agg(F.count("*").alias("decided"))
    b = trained.groupBy("step", "idx").agg(F.count("*").alias("rows"))
    return a.join(b, ["step", "idx"], "full_outer").where("coalesce(decided, 0) <> 1 or coalesce(rows, 0) <> 1")


def lost_deferrals(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """Candidates last seen deferred that are not in the final queue (idx)."""
    last = decisions.groupBy("idx").agg(F.max_by("status", "step").alias("status"))
    return last.where("status = 'deferred'").join(queue.select("idx"), "idx", "left_anti")


def bad_rows(spans: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Rows whose spans overflow, or leave their documents."""
    j = spans.join(docs.select("doc_id", "n_tokens"), "doc_id", "left")
    g = j.groupBy("row_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.max(F.coalesce(F.col("end") > F.col("n_tokens"), F.lit(True)) | (F.col("start") < 0) | (F.col("end") <= F.col("start"))).alias("outside"))
    return g.where((F.col("n") > length) | F.col("outside"))


def wrong_perplexity(tokens: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Trace lines whose perplexity is not the exponential of their loss."""
    return tokens.where(F.abs(F.col("ppl") - F.exp("loss")) > tolerance * F.exp("loss"))


def sample_sums(samples: DataFrame, tokens: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Samples whose loss is not the sum of their tokens' losses."""
    t = tokens.groupBy(*keys).agg(F.sum("loss").alias("_sum"))
    return samples.join(t, keys, "full_outer").where(F.abs(F.coalesce("loss_sum", F.lit(0)) - F.coalesce("_sum", F.lit(0))) > tolerance)


def event_order(log: DataFrame, expected: list[str]) -> bool:
    """True if the events (line, event) occur in the expected order, each first seen after the one before."""
    first = {r.event: r.line for r in log.where(F.col("event").isin(expected)).groupBy("event").agg(F.min("line").alias("line")).collect()}  # one row an event name
    lines = [first.get(e) for e in expected]
    return None not in lines and lines == sorted(lines)


def rebuilt_rows(spans: DataFrame, docs: DataFrame, length: int, pad: int) -> DataFrame:
    """(row_id, sha256) of rows packed token by token in a loop: a second way to what ``materialize_rows`` does with arrays."""
    j = spans.join(docs.select("doc_id", "tokens", "elig"), "doc_id").select("row_id", "ord", "start", "end", "tokens", "elig")

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, s in enumerate(part.sort_values("ord").itertuples(index=False), 1):
            for i in range(int(s.start), int(s.end)):
                last = i + 1 == s.end
                label = -100 if last or not s.elig[i + 1] else s.tokens[i + 1]
                out.append((s.tokens[i], label, 0 if label == -100 else 1, number, i - s.start))
        out += [(pad, -100, 0, 0, 0)] * (length - len(out))
        text = ";".join(",".join(str(int(x[k])) for x in out) for k in range(5))
        return pd.DataFrame([[key[0], hashlib.sha256(text.encode()).hexdigest()]], columns=["row_id", "sha256"])

    return j.groupBy("row_id").applyInPandas(pack, "row_id long, sha256 string")


def row_digests(rows: DataFrame) -> DataFrame:
    """(row_id, sha256) of rows as ``rebuilt_rows`` digests them."""
    text = F.concat_ws(";", *[F.array_join(c, ",") for c in ("tokens", "labels", "loss_mask", "segment_ids", "position_ids")])
    return rows.select("row_id", F.sha2(text, 256).alias("sha256"))


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks or has otherwise, and the other way round, by ``keys``; both have the same columns."""
    return ledger.compare(a, b, keys, [c for c in a.columns if c not in keys])


def crossing_labels(rows: DataFrame) -> DataFrame:
    """Positions whose label is not the next token of the same segment."""
    each = rows.select("row_id", F.posexplode(F.arrays_zip("labels", F.slice("tokens", F.lit(2), F.size("tokens")).alias("next"), "segment_ids", F.slice("segment_ids", F.lit(2), F.size("tokens")).alias("after"))).alias("i", "x"))
    labelled = each.select("row_id", "i", "x.*").where("labels <> -100")
    return labelled.where(~F.coalesce((F.col("labels") == F.col("next")) & (F.col("segment_ids") == F.col("after")) & (F.col("segment_ids") > 0), F.lit(False)))


def decided_again(candidates: DataFrame, band: float = 0.5, max_deferrals: int = 2) -> DataFrame:
    """(step, lane, idx, status) decided from sorted arrays of each step and lane: a second way to ``selection.decide``."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "idx", "deferrals", "quota", "mode")))
    each = candidates.groupBy("step", "lane").agg(order.alias("c")).select("step", "lane", F.posexplode("c").alias("i", "x"))
    status = F.when(F.col("x.mode") != "selector", "accepted").when(F.col("i") < F.col("x.quota"), "accepted").when((F.col("i") < F.col("x.quota") + F.ceil(F.col("x.quota") * band)) & (F.col("x.deferrals") < max_deferrals), "deferred").otherwise("rejected")
    return each.select("step", "lane", "x.idx", status.alias("status"))
