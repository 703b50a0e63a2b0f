"""Queries on the mixture plan: stages, ramps, quotas, floors, bands, supply."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.operators import mixture as M
from curator.operators import selection as S
from curator.plans import packing
from curator.plans.tables import values

#: The published fork.
FORK = {"S2_broaden": {"indic": 16, "web": 49.5}, "S3_reasoning_code": {"indic": 16, "web": 36.5}}
QUOTA = "step int, stage string, segment string, lane string, mix_pct double, base_window int, row_len int, quota int, cum_target double, cum_positions long, cum_total long, floor_pct double"


def schedule(spark, plan=None):
    return values(spark, [tuple(asdict(q).values()) for q in M.compile_quotas(plan or M.default_plan())], QUOTA)


def stage_plan(spark, sf):
    return values(spark, [(s.name, s.start, s.end, s.window) for s in M.default_plan().stages], "stage string, step_start int, step_end int, seq_len int")


def effective_mix(spark, sf):
    """Every step's mix: steps meet the stages whose ramp or span they are in."""
    p = M.default_plan()
    stages = values(spark, [(i, s.start, s.end, k, float(v)) for i, s in enumerate(p.stages) for k, v in s.mix.items()], "i int, lo int, hi int, lane string, pct double")
    steps = spark.range(1, p.stages[-1].end + 1).select(F.col("id").cast("int").alias("step"))
    own = steps.join(F.broadcast(stages), F.col("step").between(F.col("lo"), F.col("hi")))  # five stages
    before, after = stages.alias("b"), stages.alias("a")
    ramps = before.join(after, (F.col("a.i") == F.col("b.i") + 1) & (F.col("a.lane") == F.col("b.lane"))).select(F.col("a.lane").alias("r_lane"), (F.col("a.lo") - 1).alias("r_lo"), F.col("b.pct").alias("p0"), F.col("a.pct").alias("p1"))
    j = own.join(F.broadcast(ramps), (F.col("lane") == F.col("r_lane")) & F.col("step").between(F.col("r_lo"), F.col("r_lo") + 1), "left")
    alpha = (F.col("step") - F.col("r_lo") + 1) / 3
    return j.select("step", "lane", F.round(F.when(F.col("r_lo").isNull(), F.col("pct")).otherwise((1 - alpha) * F.col("p0") + alpha * F.col("p1")), 6).alias("pct"))


def base_window(spark, sf):
    p = M.default_plan()
    return values(spark, [(s, M.base_window(p, s)) for s in range(1, 43)], "step int, window int")


def quota_schedule(spark, sf):
    return schedule(spark).select("step", "stage", "lane", "base_window", "row_len", "quota")


def fork_quota_diff(spark, sf):
    a, b = schedule(spark), schedule(spark, M.fork(M.default_plan(), FORK, 15))
    j = a.select("step", "lane", F.col("quota").alias("parent_quota")).join(b.select("step", "lane", F.col("quota").alias("fork_quota")), ["step", "lane"])
    return j.where("parent_quota <> fork_quota")


def subpool_quotas(spark, sf):
    p = M.default_plan()
    gates = {s: {b: M.REASONING_SHARES[b] for b in bands} for s, bands in M.REASONING_GATES.items()}
    order = {"indic": ["B0_B1", "B2_B3", "B4_B5"], "reasoning": list(M.REASONING_SHARES)}
    rows = M.sub_quotas(p, M.compile_quotas(p), {"indic": M.DIFFICULTY_SHARES, "reasoning": gates}, order, {"indic": set(order["indic"]), "reasoning": {"low", "medium"}})
    return values(spark, rows, "step int, lane string, band string, rows int")


def floor_compliance(spark, sf):
    """Protected lanes at every step against their floors, from the published quotas alone."""
    w = Window.partitionBy("segment").orderBy("step")
    s = schedule(spark).withColumn("positions", F.col("quota") * F.col("row_len"))
    per_step = s.groupBy("segment", "step").agg(F.sum("positions").alias("n")).withColumn("total", F.sum("n").over(w))
    lanes = s.where("floor_pct > 0").withColumn("actual", F.sum("positions").over(Window.partitionBy("segment", "lane").orderBy("step")))
    j = lanes.join(per_step.select("segment", "step", "total"), ["segment", "step"])
    return j.select("step", "lane", F.col("actual").cast("long").alias("actual"), F.col("total").cast("long").alias("total"), (F.col("actual") >= F.col("floor_pct") / 100 * F.col("total") - 1e-6).alias("holds"))


def rounding_bounds(spark, sf):
    """At every stage's end: how far free base lanes are from their targets, in rows."""
    s = schedule(spark).where("floor_pct = 0 and lane <> 'long_context'")
    last = s.withColumn("rank", F.row_number().over(Window.partitionBy("segment", "lane").orderBy(F.desc("step")))).where("rank = 1")
    return last.select("segment", "lane", F.round((F.col("cum_target") - F.col("cum_positions")) / F.col("row_len"), 6).alias("rows_behind"))


def candidate_counts(spark, sf):
    """How many candidates each lane draws at each step: a selector sees 1/keep times its quota."""
    keep = F.create_map(*[x for k, v in M.default_plan().keep.items() for x in (F.lit(k), F.lit(v))])
    s = schedule(spark).withColumn("mode", S.lane_mode(F.col("lane"), F.col("stage"), ["indic", "reasoning", "agentic"], M.default_plan().keep))
    return s.select("step", "lane", "mode", S.n_candidates(F.col("quota"), F.col("mode"), F.coalesce(keep[F.col("lane")], F.lit(1.0))).alias("n_candidates"))


def learning_rates(spark, sf):
    """The learning rate's factor and the phase of every step: four steps of warm-up, the annealing steps going down."""
    p = M.default_plan()
    anneal = p.stages[-1]
    rows = [(s, round(M.lr_factor(s, 4, anneal.start, anneal.end - anneal.start + 1), 6), M.phase_of(s, anneal.start - 1)) for s in range(1, anneal.end + 1)]
    return values(spark, rows, "step int, factor double, phase string")


def stage_shares(spark, sf):
    """Planned and actual percent of each stage and lane."""
    s = schedule(spark).withColumn("positions", F.col("quota") * F.col("row_len"))
    g = s.groupBy("stage", "lane").agg(F.sum("positions").alias("positions"), F.round(F.avg("mix_pct"), 6).alias("planned_pct"))
    return g.withColumn("actual_pct", F.round(100 * F.col("positions") / F.sum("positions").over(Window.partitionBy("stage")), 6))


def supply_check(spark, sf):
    """Demand of the main lanes against the tokens of the corpus."""
    p = M.default_plan()
    demand = values(spark, [(k, sum(q.quota * q.row_len for q in M.compile_quotas(p) if q.lane == k), float(p.keep.get(k, 1.0))) for k in p.lanes], "lane string, accepted long, keep double")
    have = packing.lane_pool_summary(spark, sf).where("pool = 'main'").groupBy("lane").agg(F.sum("n_tokens").alias("available"))
    d = demand.join(have, "lane", "left").withColumn("wanted", F.ceil(F.col("accepted") / F.col("keep") - F.lit(1e-9))).withColumn("available", F.coalesce("available", F.lit(0)))
    passes = F.when(F.col("available") > 0, F.ceil(F.col("wanted") / F.col("available"))).otherwise(0)
    return d.select("lane", "wanted", "available", passes.cast("long").alias("passes")).withColumn("satisfiable", (F.col("wanted") == 0) | F.col("passes").between(1, p.max_passes))


#: The contract's stages and shares again, as the SQL needs them: web, code, stem, indic, reasoning, agentic, long_context.
MIX = """
stages(i, stage, lo, hi, win, shares) AS (VALUES
  (0, 'S1_foundation', 1, 8, 128, [70, 14, 6, 10, 0, 0, 0]::DOUBLE[]),
  (1, 'S2_broaden', 9, 20, 128, [55.5, 26, 8, 10, 0.5, 0, 0]),
  (2, 'S3_reasoning_code', 21, 32, 256, [42.5, 34, 12, 10, 1, 0.5, 0]),
  (3, 'S4_long_context', 33, 40, 256, [31.5, 28, 9, 10, 2, 1.5, 18]),
  (4, 'anneal', 41, 42, 256, [22, 23, 12, 20, 8, 5, 10])),
lanes AS (SELECT ['web', 'code', 'stem', 'indic', 'reasoning', 'agentic', 'long_context'] AS names),
mix AS (SELECT i, lo, hi, unnest(names) AS lane, unnest(shares) AS pct FROM stages, lanes),
steps AS (SELECT unnest(range(1, 43))::INTEGER AS step)
"""


def quotas_sql(name: str, fork: bool = False) -> str:
    """The quota compiler as a recursion over steps, its state being lists by lane: targets, positions and rows. With ``fork`` the override of FORK holds from step 15 on."""
    own = "CASE WHEN {0}.i IN (1, 2) AND n.step >= 15 THEN [{0}.shares[1] - 6, {0}.shares[2], {0}.shares[3], 16, {0}.shares[5], {0}.shares[6], {0}.shares[7]] ELSE {0}.shares END" if fork else "{0}.shares"
    return f"""
{name}_plan AS (
  SELECT n.step, s.stage, s.stage || {"CASE WHEN s.i IN (1, 2) AND n.step >= 15 THEN '+' ELSE '' END" if fork else "''"} AS seg, CASE WHEN n.step >= 19 THEN 256 ELSE 128 END AS w, {own.format('s')} AS own,
         CASE WHEN a.i IS NULL THEN {own.format('s')} ELSE list_transform(range(1, 8), lambda k: (1 - (n.step - a.lo + 2) / 3) * ({own.format('b')})[k] + (n.step - a.lo + 2) / 3 * ({own.format('a')})[k]) END AS mix,
         a.i AS after, (n.step - a.lo + 2) / 3 AS alpha
  FROM steps n JOIN stages s ON n.step BETWEEN s.lo AND s.hi LEFT JOIN stages a ON n.step IN (a.lo - 1, a.lo) AND a.i > 0 LEFT JOIN stages b ON b.i = a.i - 1),
{name} AS (
  SELECT 0 AS step, '' AS seg, '' AS stage, 0 AS w, []::DOUBLE[] AS own, []::DOUBLE[] AS mix, []::DOUBLE[] AS target, []::BIGINT[] AS done, 0::BIGINT AS total, []::BIGINT[] AS q
  UNION ALL
  SELECT step, seg, stage, w, own, mix, target, list_transform(range(1, 8), lambda k: before[k] + rows_[k] * CASE WHEN k > 5 THEN 1024 ELSE w END), total, rows_
  FROM (SELECT *, list_transform(range(1, 4), lambda k: whole[k] + CASE WHEN free >= 0 THEN len(list_filter(list_sort(flatten(list_transform(range(1, 4), lambda j: list_transform(range(0, free), lambda x: {{'p': -round(due[j] - whole[j] - x, 9), 'l': j}}))))[1 : free], lambda y: y.l = k))
                ELSE -len(list_filter(list_sort(flatten(list_transform(range(1, 4), lambda j: list_transform(range(0, whole[j]), lambda x: {{'p': due[j] - whole[j] + x, 'l': j}}))))[1 : -free], lambda y: y.l = k)) END) || [q4, q5, q6, q7] AS rows_
  FROM (SELECT *, 2048 // w - q4 - q5 - list_sum(whole)::BIGINT AS free
  FROM (SELECT *, list_transform(due, lambda d: greatest(0, floor(d + 1e-9))::BIGINT) AS whole
  FROM (SELECT *, list_transform(range(1, 4), lambda k: (target[k] - before[k]) / w) AS due,
               greatest(ceil((own[4] / 100 * total - before[4]) / w - 1e-9), CASE WHEN target[4] - before[4] > 1e-9 THEN floor((target[4] - before[4]) / w + 0.5) ELSE 0 END, 0)::BIGINT AS q4,
               greatest(ceil((own[5] / 100 * total - before[5]) / w - 1e-9), CASE WHEN target[5] - before[5] > 1e-9 THEN floor((target[5] - before[5]) / w + 0.5) ELSE 0 END, 0)::BIGINT AS q5
  FROM (SELECT * REPLACE (total + 1024 * more AS total, q6 + more AS q6)
  FROM (SELECT *, greatest(0, ceil((own[6] / 100 * total - before[6] - 1024 * q6 - 1e-9) / (1024 * (1 - own[6] / 100))))::BIGINT AS more
  FROM (SELECT * REPLACE (total + 2048 + 1024 * (q6 + q7) AS total)
  FROM (SELECT *, CASE WHEN target[6] - before[6] > 1e-9 THEN floor((target[6] - before[6]) / 1024 + 0.5) ELSE 0 END::BIGINT AS q6, CASE WHEN target[7] - before[7] > 1e-9 THEN floor((target[7] - before[7]) / 1024 + 0.5) ELSE 0 END::BIGINT AS q7
  FROM (SELECT * REPLACE (list_transform(range(1, 8), lambda k: target[k] + 2048::DOUBLE / 100 / (1 - (mix[6] + mix[7]) / 100) * mix[k]) AS target)
  FROM (SELECT n.step, n.seg, n.stage, n.w, n.own, n.mix, CASE WHEN n.seg = s.seg THEN s.target ELSE list_transform(range(7), lambda x: 0::DOUBLE) END AS target,
               CASE WHEN n.seg = s.seg THEN s.done ELSE list_transform(range(7), lambda x: 0::BIGINT) END AS before, CASE WHEN n.seg = s.seg THEN s.total ELSE 0 END AS total
        FROM {name} s JOIN {name}_plan n ON n.step = s.step + 1))))))))))),
{name}_rows AS (SELECT step, stage, seg, w, unnest(names) AS lane, unnest(range(1, 8)) AS k, unnest(mix) AS mix_pct, unnest(own) AS own, unnest(target) AS target, unnest(done) AS done, total, unnest(q) AS quota FROM {name}, lanes WHERE step > 0),
{name}_lanes AS (SELECT *, CASE WHEN k > 5 THEN 1024 ELSE w END AS row_len FROM {name}_rows)
"""


#: The contract's bands by stage, with what has no supply passed on: difficulty of indic, lengths of reasoning (low and medium have supply).
BANDS = """
bands(lane, k, i, names, shares) AS (VALUES
  ('indic', 4, 0, ['B0_B1', 'B2_B3', 'B4_B5'], [50, 40, 10]::DOUBLE[]), ('indic', 4, 1, ['B0_B1', 'B2_B3', 'B4_B5'], [30, 50, 20]), ('indic', 4, 2, ['B0_B1', 'B2_B3', 'B4_B5'], [15, 50, 35]),
  ('indic', 4, 3, ['B0_B1', 'B2_B3', 'B4_B5'], [10, 45, 45]), ('indic', 4, 4, ['B0_B1', 'B2_B3', 'B4_B5'], [0, 40, 60]),
  ('reasoning', 5, 0, ['low', 'medium'], [0, 0]), ('reasoning', 5, 1, ['low', 'medium'], [40, 35]), ('reasoning', 5, 2, ['low', 'medium'], [40, 35 + 20]),
  ('reasoning', 5, 3, ['low', 'medium'], [40, 35 + 20]), ('reasoning', 5, 4, ['low', 'medium'], [0, 20 + 5])),
"""
SUBPOOLS = f"""{BANDS}
shared AS (SELECT lane, k, i, names, list_transform(shares, lambda x: x / greatest(list_sum(shares), 1e-12)) AS part FROM bands),
weighed AS (SELECT p.step, p.seg, o.lane, o.names, CASE WHEN p.after IS NULL THEN o.part ELSE list_transform(range(1, len(o.names) + 1), lambda j: (1 - p.alpha) * sb.shares[o.k] * b.part[j] + p.alpha * sa.shares[o.k] * a.part[j]) END AS raw, q.quota
  FROM quota_plan p JOIN stages s ON s.stage = p.stage JOIN shared o ON o.i = s.i JOIN quota_lanes q ON q.step = p.step AND q.lane = o.lane
  LEFT JOIN stages sa ON sa.i = p.after LEFT JOIN stages sb ON sb.i = p.after - 1 LEFT JOIN shared a ON a.i = p.after AND a.lane = o.lane LEFT JOIN shared b ON b.i = p.after - 1 AND b.lane = o.lane),
sub AS (
  SELECT 0 AS step, '' AS seg, lane, []::VARCHAR[] AS names, []::DOUBLE[] AS owed, []::BIGINT[] AS given, []::BIGINT[] AS now FROM (SELECT DISTINCT lane FROM bands)
  UNION ALL
  SELECT step, seg, lane, names, owed, list_transform(range(1, len(names) + 1), lambda j: given[j] + now[j]), now
  FROM (SELECT *, list_transform(range(1, len(names) + 1), lambda j: len(list_filter(list_sort(flatten(list_transform(range(1, len(names) + 1), lambda m: list_transform(range(0, quota), lambda x: {{'p': -round(owed[m] - given[m] - x, 9), 'l': m}}))))[1 : quota], lambda y: y.l = j))) AS now
  FROM (SELECT * REPLACE (list_transform(range(1, len(names) + 1), lambda j: owed[j] + quota * raw[j] / greatest(list_sum(raw), 1e-12)) AS owed)
  FROM (SELECT n.step, n.seg, n.lane, n.names, n.raw, n.quota, CASE WHEN n.seg = s.seg THEN s.owed ELSE list_transform(n.names, lambda x: 0::DOUBLE) END AS owed, CASE WHEN n.seg = s.seg THEN s.given ELSE list_transform(n.names, lambda x: 0::BIGINT) END AS given
        FROM sub s JOIN weighed n ON n.step = s.step + 1 AND n.lane = s.lane)))),
sub_rows AS (SELECT step, lane, unnest(names) AS band, unnest(now) AS n FROM sub WHERE step > 0)
"""
QUOTAS = f"{MIX}, {quotas_sql('quota')}"
SQL = {
    "stage_plan": f"WITH {MIX} SELECT stage, lo::INTEGER AS step_start, hi::INTEGER AS step_end, win::INTEGER AS seq_len FROM stages",
    "quota_schedule": f"WITH RECURSIVE {QUOTAS} SELECT step, stage, lane, w AS base_window, row_len, quota::INTEGER AS quota FROM quota_lanes",
    "fork_quota_diff": f"WITH RECURSIVE {QUOTAS}, {quotas_sql('forked', True)} SELECT a.step, a.lane, a.quota::INTEGER AS parent_quota, b.quota::INTEGER AS fork_quota FROM quota_lanes a JOIN forked_lanes b ON a.step = b.step AND a.lane = b.lane WHERE a.quota <> b.quota",
    "subpool_quotas": f"WITH RECURSIVE {QUOTAS}, {SUBPOOLS} SELECT step, lane, band, n::INTEGER AS rows FROM sub_rows WHERE n > 0",
    "floor_compliance": f"WITH RECURSIVE {QUOTAS} SELECT step, lane, done AS actual, total, done >= own / 100 * total - 1e-6 AS holds FROM quota_lanes WHERE k IN (4, 5, 6) AND own > 0",
    "rounding_bounds": f"WITH RECURSIVE {QUOTAS} SELECT seg AS segment, lane, round((target - done) / row_len, 6) AS rows_behind FROM quota_lanes WHERE (k <= 3 OR k IN (4, 5, 6) AND own = 0) QUALIFY row_number() OVER (PARTITION BY seg, lane ORDER BY step DESC) = 1",
    "candidate_counts": f"""WITH RECURSIVE {QUOTAS}, m AS (SELECT step, lane, quota, CASE WHEN stage = 'anneal' THEN 'selector_off' WHEN k IN (4, 5, 6) THEN 'always_on' WHEN lane = 'web' THEN 'selector' WHEN lane IN ('code', 'stem') THEN 'keep_all' ELSE 'bypass' END AS mode FROM quota_lanes)
        SELECT step, lane, mode, CASE WHEN mode = 'selector' THEN ceil(quota / 0.4::DOUBLE - 1e-9) ELSE quota END::INTEGER AS n_candidates FROM m""",
    "learning_rates": f"WITH {MIX} SELECT step, round(CASE WHEN step > 40 THEN (43 - step) / 3 ELSE least(1, step / 4) END, 6) AS factor, CASE WHEN step > 40 THEN 'anneal' WHEN step <= 40 / 3 THEN 'early' WHEN step <= 80 / 3 THEN 'mid' ELSE 'late' END AS phase FROM steps",
    "stage_shares": f"""WITH RECURSIVE {QUOTAS}, g AS (SELECT stage, lane, sum(quota * row_len)::BIGINT AS positions, round(avg(mix_pct), 6) AS planned_pct FROM quota_lanes GROUP BY stage, lane)
        SELECT *, round(100 * positions / sum(positions) OVER (PARTITION BY stage), 6) AS actual_pct FROM g""",
    "effective_mix": f"""WITH {MIX}, ramps AS (SELECT a.lane, a.lo - 1 AS r, b.pct AS q0, a.pct AS q1 FROM mix a JOIN mix b ON a.i = b.i + 1 AND a.lane = b.lane)
        SELECT step, m.lane, round(CASE WHEN r IS NULL THEN pct ELSE (1 - (step - r + 1) / 3.0::DOUBLE) * q0 + (step - r + 1) / 3.0::DOUBLE * q1 END, 6) AS pct
        FROM steps JOIN mix m ON step BETWEEN lo AND hi LEFT JOIN ramps x ON x.lane = m.lane AND step BETWEEN r AND r + 1""",
    "base_window": f"WITH {MIX} SELECT step, (CASE WHEN step >= 19 THEN 256 ELSE 128 END)::INTEGER AS \"window\" FROM steps",
    "supply_check": f"""WITH RECURSIVE {QUOTAS}, {packing.POOLED}, d AS (SELECT lane, sum(quota * row_len) AS accepted, CASE WHEN lane = 'web' THEN 0.4 ELSE 1.0 END::DOUBLE AS keep FROM quota_lanes GROUP BY lane),
        h AS (SELECT lane, sum(n_tokens) AS available FROM pooled WHERE pool = 'main' GROUP BY lane),
        w AS (SELECT d.lane, ceil(accepted / keep - 1e-9)::BIGINT AS wanted, coalesce(available, 0)::BIGINT AS available FROM d LEFT JOIN h USING (lane)),
        p AS (SELECT *, (CASE WHEN available > 0 THEN ceil(wanted / available) ELSE 0 END)::BIGINT AS passes FROM w)
        SELECT *, wanted = 0 OR passes BETWEEN 1 AND 4 AS satisfiable FROM p""",
}
QUERIES = {f.__name__: f for f in (stage_plan, effective_mix, base_window, quota_schedule, fork_quota_diff, subpool_quotas, floor_compliance, rounding_bounds, stage_shares, candidate_counts, learning_rates, supply_check)}
