"""Selection of candidates by score: similarity to proxies, decisions by lane, deferral across steps."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BAND, MAX_DEFERRALS, QUEUE = 0.5, 2, 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_vector(vectors: DataFrame, column: str) -> DataFrame:
    """One row with the mean of an array column, summed by position with map-side combination."""
    each = vectors.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("proxy"))  # one row for each dimension


def score(candidates: DataFrame, proxies: DataFrame, column: str = "embedding") -> DataFrame:
    """``candidates`` with the cosine similarity of each vector to the proxies' mean, which is one row."""
    return candidates.crossJoin(F.broadcast(mean_vector(proxies, column))).withColumn("score", F.round(cosine(F.col(column), F.col("proxy")), 9)).drop("proxy")


def lane_mode(lane: Column, stage: Column, protected: list[str], keep: dict[str, float]) -> Column:
    some = [k for k, v in keep.items() if v < 1]
    return F.when(stage == "anneal", "selector_off").when(lane.isin(protected), "always_on").when(lane.isin(some), "selector").when(lane.isin(list(keep)), "keep_all").otherwise("bypass")


def n_candidates(quota: Column, mode: Column, keep: Column) -> Column:
    return F.when(quota == 0, 0).when(mode == "selector", F.ceil(quota / keep - F.lit(1e-9))).otherwise(quota).cast("int")


def decide(candidates: DataFrame, band: float = BAND, max_deferrals: int = MAX_DEFERRALS) -> DataFrame:
    """``candidates`` (step, lane, mode, idx, score, quota, deferrals) with rank, cutoff, status and reason.

    A step's candidates are few, so its windows are small; steps are independent. The cutoff is the score of the last accepted
    candidate of the step's selector lane.
    """
    rank = F.row_number().over(Window.partitionBy("step", "lane").orderBy(F.desc("score"), "idx")) - 1
    d = candidates.withColumn("rank_in_lane", rank)
    last = F.when((F.col("mode") == "selector") & (F.col("rank_in_lane") == F.col("quota") - 1), F.col("score"))
    d = d.withColumn("cutoff", F.max(last).over(Window.partitionBy("step")))
    r, q = F.col("rank_in_lane"), F.col("quota")
    selected = F.when(r < q, F.struct(F.lit("accepted").alias("status"), F.lit("opus_selected").alias("reason"))).when(
        r < q + F.ceil(F.lit(band) * q),
        F.when(F.col("deferrals") >= max_deferrals, F.struct(F.lit("rejected").alias("status"), F.lit("defer_expired").alias("reason"))).otherwise(F.struct(F.lit("deferred").alias("status"), F.lit("marginal_utility").alias("reason"))),
    ).otherwise(F.struct(F.lit("rejected").alias("status"), F.lit("low_proxy_utility").alias("reason")))
    under = F.coalesce(F.col("score") < F.col("cutoff"), F.lit(False))
    reason = F.when(F.col("mode") == "selector_off", "selector_off_anneal").when(F.col("mode") == "always_on", F.when(under, "protected_floor_override").otherwise("always_on_above_cutoff")).when(F.col("mode") == "keep_all", "keep_1.0_static_filter_only").otherwise("selector_bypass_long_context")
    d = d.withColumn("d", F.when(F.col("mode") == "selector", selected).otherwise(F.struct(F.lit("accepted").alias("status"), reason.alias("reason"))))
    return d.withColumns({"status": F.col("d.status"), "reason": F.col("d.reason")}).drop("d")


def plan_lane(rows: pd.DataFrame, steps: list[tuple[int, int, int]], queue_cap: int = QUEUE, band: float = BAND, max_deferrals: int = MAX_DEFERRALS, blocked: frozenset = frozenset(), kinds: dict[int, tuple] | None = None) -> pd.DataFrame:
    """Decisions of a selector lane over all steps: deferred candidates come back first, in the order they left.

    ``rows`` (idx, score) are drawn in order of idx; ``steps`` are (step, quota, candidates). One step's queue depends on the one before,
    so this is a loop; its state is a queue of at most ``queue_cap``. ``blocked`` candidates hold evaluation data: they are rejected before anything is
    ranked. ``kinds`` says the pool and row length of each step; a candidate deferred under another kind is rejected when its turn comes.
    """
    kinds = kinds or {}
    queue: list[tuple[int, float, int, tuple | None]] = []
    fresh = iter(rows.sort_values("idx")[["idx", "score"]].itertuples(index=False, name=None))
    out = defaultdict(list)

    def record(step: int, idx: int, s: float, rank: int, deferrals: int, status: str, reason: str) -> None:
        for k, v in (("step", step), ("idx", idx), ("score", s), ("rank_in_lane", rank), ("deferrals", deferrals), ("status", status), ("reason", reason)):
            out[k].append(v)

    for step, quota, size in steps:
        kind, taken = kinds.get(step), []
        while queue and len(taken) < size:
            idx, s, deferrals, was = queue.pop(0)
            if was != kind:
                record(step, idx, s, -1, deferrals, "rejected", "stage_mismatch")
            else:
                taken.append((idx, s, deferrals))
        while len(taken) < size and (row := next(fresh, None)) is not None:
            if row[0] in blocked:
                record(step, *row, -1, 0, "rejected", "eval_firewall")
            else:
                taken.append((*row, 0))
        for rank, (idx, s, deferrals) in enumerate(sorted(taken, key=lambda c: (-c[1], c[0]))):
            if rank < quota:
                status, reason = "accepted", "opus_selected"
            elif rank < quota + -(-quota * band // 1):
                if deferrals >= max_deferrals:
                    status, reason = "rejected", "defer_expired"
                elif len(queue) >= queue_cap:
                    status, reason = "rejected", "defer_queue_full"
                else:
                    status, reason = "deferred", "marginal_utility"
                    queue.append((idx, s, deferrals + 1, kind))
            else:
                status, reason = "rejected", "low_proxy_utility"
            record(step, idx, s, rank, deferrals, status, reason)
    return pd.DataFrame(out, columns=["step", "idx", "score", "rank_in_lane", "deferrals", "status", "reason"])


def preview(rows: pd.DataFrame, steps: list[tuple[int, int, int]], step: int, **more) -> pd.DataFrame:
    """What ``step`` would decide, without deciding it: planning is a function of what came before, so a copy of it is run one step on."""
    upto = [s for s in steps if s[0] <= step]
    planned = plan_lane(rows, upto, **more)
    return planned[planned["step"] == step].reset_index(drop=True)


def steps_to_drain(n: int, quota: int, size: int, band: float = BAND, max_deferrals: int = MAX_DEFERRALS) -> list[tuple[int, int, int]]:
    """Steps of ``size`` that use up ``n`` candidates and their queue; those beyond the end are empty and give no rows.

    A step defers at most ``back = ceil(band quota)``, so each draws ``size - back`` new ones at least until all are drawn. The queue of at most ``QUEUE``
    then empties, each of its candidates coming back ``max_deferrals`` times at most.
    """
    back = int(min(size, -(-quota * band // 1)))
    new = size - back
    count = -(-n // new) + max_deferrals + 1 if new else n * (max_deferrals + 1)
    return [(s, quota, size) for s in range(count + (QUEUE * (max_deferrals + 1)))]


PLANNED = "step int, idx long, score double, rank_in_lane int, deferrals int, status string, reason string"


def plan_steps(candidates: DataFrame, lane: str, steps: list[tuple[int, int, int]] | Callable[[int], list[tuple[int, int, int]]]) -> DataFrame:
    """``plan_lane`` for each value of ``lane``, side by side. steps: the same for all, or a function of a lane's number of candidates."""
    kind = candidates.schema[lane].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return plan_lane(rows, steps(len(rows)) if callable(steps) else steps).assign(**{lane: key[0]})[[lane, *PLANNED_COLUMNS]]

    return candidates.groupBy(lane).applyInPandas(run, f"{lane} {kind}, {PLANNED}")


PLANNED_COLUMNS = [c.split()[0] for c in PLANNED.split(", ")]
