"""Queries on endless lane streams, pools, row order, proxy rows and row digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator.functions import text as T
from curator.operators import audit
from curator.operators import ledger as L
from curator.operators import mixture as M
from curator.operators import streams as S
from curator.plans import ledger, packing
from curator.plans.admission import W
from curator.plans.mixture import MIX, schedule
from curator.plans.tables import table, values

SEED, LENGTH, PROXY = packing.SEED, packing.BASE, 24
#: Rows that are asked of each lane.
ROWS = {"web": 400, "stem": 300, "code": 500, "indic": 50, "agentic": 60}


def lane_tokens(spark, sf):
    return packing.lane_docs(spark, sf).where("lane is not null and pool = 'main'").select("doc_id", "lane", "n_tokens")


def asked(spark):
    return values(spark, list(ROWS.items()), "lane string, n_rows long")


def endless_rows(spark, sf):
    """Rows of streams that begin again where they end: spans by lane and row."""
    s = S.endless_rows(lane_tokens(spark, sf), SEED, LENGTH, asked(spark))
    return s.select("lane", F.col("row").alias("row_no"), F.col("pass").alias("pass_no"), "doc_id", F.col("start").alias("start_tok"), F.col("end").alias("end_tok"))


def stream_cursors(spark, sf):
    return S.cursors(lane_tokens(spark, sf), SEED, LENGTH, asked(spark)).select("lane", F.col("row").alias("row_no"), F.col("pass").alias("pass_no"), "idx", "doc_id", "tok_off")


def pool_selection(spark, sf):
    """The pool that each lane reads at each step."""
    p = M.default_plan()
    steps = values(spark, [(s, p.stage(s).name) for s in range(1, p.stages[-1].end + 1)], "step int, stage string")
    reserves = packing.pooled(spark, sf).where("lane is not null").groupBy("lane").agg(F.max((F.col("pool") == "reserve").cast("int")).alias("has"))
    return steps.crossJoin(F.broadcast(reserves)).select("step", "lane", S.pool_for(F.col("stage"), F.col("has") == 1).alias("pool"))  # steps and lanes


def step_row_order(spark, sf):
    """The places of accepted rows within their steps, long rows last."""
    d = ledger.decisions(spark, sf).where("status = 'accepted'").withColumn("row_len", F.when(F.col("lane") == "long_context", 1024).otherwise(256))
    return S.row_order(d, ["web", "code", "stem", "indic", "long_context"], F.lit(256)).select("step", "place", "lane", "idx")


def proxy_rows(spark, sf):
    """Benchmark items as padded rows."""
    b = table(spark, sf, "benchmark").select("item_id", (T.n_words(F.col("text")) + 1).alias("n_tokens"))
    return S.padded_rows(b, PROXY).select("item_id", "n_real", "n_pad", "cut")


def row_hashes(spark, sf):
    return S.row_hashes(packing.packed(spark, sf))


def schedule_steps(spark, sf):
    """Positions of every step and the running total of its segment, from the compiled schedule."""
    s = schedule(spark).groupBy("step").agg(F.sum(F.col("quota") * F.col("row_len")).cast("long").alias("positions"), F.sum("quota").cast("long").alias("n_rows"), F.round(F.sum("mix_pct"), 6).alias("mix_pct"))
    return s.select("step", "mix_pct", (F.col("positions") >= 2048).alias("full"))


def resume_run(spark, sf):
    """What resuming each branch at its checkpoint keeps, drops and expects, and whether the first batch after it is the declared one and the one from before the crash."""
    c = ledger.chain(spark, sf)
    good = c.where("ledger_offset = 150").select("branch", "ledger_offset", F.col("record_hash").alias("head_hash"))
    declared = L.bind(good, c).select("branch", F.col("next_hash").alias("declared"))
    side = ledger.records(spark, sf).select("branch", "ledger_offset")
    again = c.where("ledger_offset > 150").withColumn("record_hash", F.when((F.col("branch") == 3) & (F.col("ledger_offset") == 151), "other").otherwise(F.col("record_hash")))
    return L.resume(c, good, side, declared, again)


def double_build(spark, sf):
    """The shard documents built twice, from tables dealt out differently: rows that only one build has."""
    a = packing.chunks(spark, sf).select("doc_id", *packing.STREAM, "chunk", "offset", "n_tokens", "content")
    b = packing.L.chunk(packing.pooled(spark, sf).where("lane is not null").repartition(13, "n_tokens").select("doc_id", *packing.STREAM, "n_tokens", "lang", "source", "content", "pii"), packing.STREAM, packing.TARGET)
    b = b.withColumn("offset", F.when(F.col("doc_id") == 7, -1).otherwise(F.col("offset"))).select(a.columns)  # and one planted difference
    return audit.multiset_difference(a, b)


LANES_SQL = ", ".join(f"('{k}', {v})" for k, v in ROWS.items())
ENDLESS = f"""{packing.LANED},
q(lane, n_rows) AS (VALUES {LANES_SQL}),
d0 AS (SELECT doc_id, lane, n_tokens FROM laned WHERE lane IS NOT NULL AND pool = 'main'),
tt AS (SELECT lane, n_rows, n_rows * {LENGTH} AS wanted, ceil(n_rows * {LENGTH} / sum(n_tokens))::BIGINT AS np FROM d0 JOIN q USING (lane) GROUP BY lane, n_rows),
pp AS (SELECT d0.*, wanted, unnest(range(0, np)) AS pass_no FROM d0 JOIN tt USING (lane)),
po AS (SELECT *, substr(sha256('{SEED}|' || lane || '|' || pass_no || '|' || doc_id), 1, 16) AS h FROM pp),
ps AS (SELECT *, row_number() OVER (PARTITION BY lane, pass_no ORDER BY h, doc_id) - 1 AS idx, sum(n_tokens) OVER (PARTITION BY lane ORDER BY pass_no, h, doc_id) - n_tokens AS p0 FROM po),
sx AS (SELECT *, least(p0 + n_tokens, wanted) AS p1 FROM ps WHERE p0 < wanted),
sr AS (SELECT *, unnest(range((p0 // {LENGTH})::BIGINT, ((p1 - 1) // {LENGTH} + 1)::BIGINT)) AS row_no FROM sx),
endless AS (SELECT lane, row_no, pass_no, idx, doc_id, greatest(0, row_no * {LENGTH} - p0)::BIGINT AS start_tok, (least(p1, (row_no + 1) * {LENGTH}) - p0)::BIGINT AS end_tok, p0 <= row_no * {LENGTH} AS first FROM sr)
"""
ROW_ARRAYS = f"""{packing.CONV},
pl AS (SELECT row_id, ord, i, i - a AS p, e AND i > a AS m, lead(e AND i > a, 1, false) OVER (PARTITION BY row_id, ord ORDER BY i) AS nx, sum(1) OVER (PARTITION BY row_id ORDER BY ord, i) - 1 AS k FROM sp JOIN pos ON pos.doc_id = sp.doc_id AND i >= a AND i < a + n),
al AS (SELECT row_id, k::BIGINT AS k, i AS t, CASE WHEN nx THEN i + 1 ELSE -100 END AS l, nx::INT AS m, ord + 1 AS s, k::BIGINT - p AS x FROM pl
       UNION ALL SELECT row_id, k, -1, -100, 0, 0, k FROM (SELECT row_id, unnest(range(count(*), 8192)) AS k FROM pl GROUP BY row_id))
"""
SQL = {
    "endless_rows": f"WITH {ENDLESS} SELECT lane, row_no, pass_no::INTEGER AS pass_no, doc_id, start_tok, end_tok FROM endless",
    "stream_cursors": f"WITH {ENDLESS} SELECT lane, row_no, pass_no::INTEGER AS pass_no, idx, doc_id, start_tok AS tok_off FROM endless WHERE first",
    "pool_selection": f"WITH {packing.POOLED}, lane_pools AS (SELECT lane, max((pool = 'reserve')::INT) = 1 AS has FROM pooled WHERE lane IS NOT NULL GROUP BY lane) SELECT step::INTEGER AS step, lane, CASE WHEN step > 40 AND has THEN 'reserve' ELSE 'main' END AS pool FROM range(1, 43) t(step), lane_pools",
    "step_row_order": f"WITH {ledger.CAND} SELECT step, (row_number() OVER (PARTITION BY step ORDER BY list_position(['web', 'code', 'stem', 'indic', 'long_context'], lane), rank_in_lane) - 1)::INTEGER AS place, lane, idx FROM dec WHERE status = 'accepted'",
    "proxy_rows": f"WITH b AS (SELECT item_id, len({W.format('text')}) + 1 AS n FROM benchmark) SELECT item_id, least(n, {PROXY}) AS n_real, {PROXY} - least(n, {PROXY}) AS n_pad, n > {PROXY} AS cut FROM b",
    "row_hashes": f"WITH {ROW_ARRAYS} SELECT row_id, " + ", ".join(f"sha256(string_agg({c}::VARCHAR, ',' ORDER BY k)) AS {name}_sha256" for c, name in (("t", "tokens"), ("l", "labels"), ("m", "mask"), ("s", "segments"), ("x", "attention"))) + " FROM al GROUP BY row_id",
    "schedule_steps": f"WITH {MIX} SELECT step, 100.0::DOUBLE AS mix_pct, true AS full FROM steps",
    "resume_run": f"""WITH {ledger.RECORDS} SELECT branch, 150::BIGINT AS checkpoint_offset, 150::BIGINT AS kept, count(*) - 150 AS orphans, count(*) - 150 AS side_dropped, 2 AS attempt, NULL::VARCHAR AS refused, branch <> 3 AS as_declared, branch <> 3 AS as_before FROM rec GROUP BY branch""",
    "double_build": f"WITH {packing.LANED} SELECT side, count(*) AS n FROM laned, (VALUES ('first'), ('second')) t(side) WHERE doc_id = 7 AND lane IS NOT NULL GROUP BY side",
}
QUERIES = {f.__name__: f for f in (endless_rows, stream_cursors, pool_selection, step_row_order, proxy_rows, row_hashes, schedule_steps, resume_run, double_build)}
