"""Queries on ledgers, selection and audits. ``events`` stands in for ledger records, ``embeddings`` for candidates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.functions.hashing import canonical_json
from curator.operators import audit as Q
from curator.operators import ledger as L
from curator.operators import packing as P
from curator.operators import selection as S
from curator.operators.sized import running_sum
from curator.plans import packing
from curator.plans.tables import table

KEEP = {"web": 0.4, "code": 1.0, "stem": 1.0}
STEP, CHECKPOINT = 50, 10


def records(spark, sf):
    """Events as records: branch, offset in the order of time, canonical payload."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    e = e.withColumn("branch", F.col("user_id") % 4)
    e = running_sum(e, ["branch"], [F.col("ts"), F.col("event_id")], F.lit(1), F.date_trunc("hour", "ts"), "before")
    e = e.withColumn("ledger_offset", F.col("before") + 1).drop("before").withColumn("step", F.floor((F.col("ledger_offset") - 1) / STEP).cast("long"))
    return e.withColumn("payload", canonical_json(branch=F.col("branch"), cents=F.col("cents"), event_id=F.col("event_id"), event_type=F.col("event_type"))).drop("ts")


def chain(spark, sf):
    return L.build(records(spark, sf))


def tampered(spark, sf):
    """Every branch's record 100 + branch has another payload, its own hash left as it was."""
    hit = F.col("ledger_offset") == 100 + F.col("branch")
    return chain(spark, sf).withColumn("payload", F.when(hit, F.replace("payload", F.lit('"cents":'), F.lit('"cents":9'))).otherwise(F.col("payload")))


def checkpoints(ledger):
    """Offset 150 of each branch; branch 2's head is wrong and branch 3's offset too large."""
    c = ledger.where("ledger_offset = 150").select("branch", F.when(F.col("branch") == 3, 10**9).otherwise(F.col("ledger_offset")).cast("long").alias("ledger_offset"), F.when(F.col("branch") == 2, "0").otherwise(F.col("record_hash")).alias("head_hash"))
    return c


def ledger_chain(spark, sf):
    return chain(spark, sf).select("branch", "ledger_offset", "prev_record_hash", "record_hash")


def ledger_verify(spark, sf):
    return L.verify(chain(spark, sf))


def ledger_tamper_first_break(spark, sf):
    return L.verify(tampered(spark, sf)).select("branch", "first_bad", "n_valid")


def recover_to_checkpoint(spark, sf):
    c = chain(spark, sf)
    return L.recover(c, checkpoints(c))


def orphaned_records(spark, sf):
    c = chain(spark, sf)
    return L.orphans(c, checkpoints(c)).select("branch", "ledger_offset", "event_id")


def side_ledger_truncate(spark, sf):
    return L.truncate(records(spark, sf), "step", 3).select("branch", "step", "event_id")


def stream_fingerprint(spark, sf):
    b = L.batch_hashes(chain(spark, sf), "branch", F.col("step"))
    return L.stream_fingerprint(b, "branch", "batch")


def replay_compare(spark, sf):
    """A replay that lost one record, changed one and has one more."""
    c = chain(spark, sf).select("branch", "ledger_offset", "cents", "event_type", "record_hash")
    r = c.where("not (branch = 0 and ledger_offset = 7)").withColumn("cents", F.when((F.col("branch") == 1) & (F.col("ledger_offset") == 9), -1).otherwise(F.col("cents")))
    more = c.where("branch = 2 and ledger_offset = 1").withColumn("ledger_offset", F.lit(-1).cast("long"))
    return L.compare(c, r.unionByName(more), ["branch", "ledger_offset"], ["cents", "event_type", "record_hash"])


def fork_divergence(spark, sf):
    """Branch 0 and a fork of it after record 120 that goes on with branch 1's records: where they part."""
    c = records(spark, sf)
    child = c.where("branch = 0 and ledger_offset <= 120").unionByName(c.where("branch = 1 and ledger_offset > 120").withColumn("branch", F.lit(0).cast("long")))
    a, b = L.build(c.where("branch = 0")), L.build(child.select(c.columns))
    d = L.compare(a, b, ["ledger_offset"], ["record_hash"])
    return d.agg(F.min("ledger_offset").alias("first_difference"), F.count("*").alias("n_different"))


def checkpoint_binding(spark, sf):
    c = chain(spark, sf)
    return L.bind(checkpoints(c), c)


def spans(spark, sf):
    r = records(spark, sf)
    return r.select("branch", "step", (F.col("user_id") % 50).alias("shard"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 100 + 1).alias("n_tokens"), F.when(F.col("event_type") == "click", 0).otherwise(F.col("event_id") % 100 + 1).alias("n_loss"), "cents", "event_id", "event_type")


def audit_q1_behind_checkpoints(spark, sf):
    s = spans(spark, sf)
    c = s.where(F.col("step") % CHECKPOINT == 0).select("branch", F.col("step").alias("checkpoint")).distinct()
    return Q.behind_checkpoints(s, c, "branch", "step")


def following_checkpoints(spark, sf):
    """The checkpoint that every step is first part of."""
    s = spans(spark, sf).select("branch", "step").distinct()
    c = s.where(F.col("step") % CHECKPOINT == 0).withColumnRenamed("step", "checkpoint")
    return Q.following_checkpoint(s, c, "branch", "step")


def audit_q2_token_window(spark, sf):
    s = spans(spark, sf)
    steps = s.groupBy("branch", "step").agg(F.sum("n_tokens").alias("n"))
    hit = Q.token_window(steps, "branch", "step", "n", F.lit(3000), F.lit(9000)).select("branch", "step")
    return Q.influence(s.join(hit, ["branch", "step"], "left_semi"), F.lit(True))


def step_losses(spark, sf):
    return spans(spark, sf).groupBy("branch", "step").agg((F.sum("cents") / F.count("*")).alias("loss"))


def loss_jump(spark, sf):
    return Q.largest_jump(step_losses(spark, sf), "branch", "step", "loss").withColumn("jump", F.round("jump", 6))


def candidates(spark, sf):
    """Vectors with a step, lane, quota and earlier deferrals; label 0 is the proxy set."""
    e = table(spark, sf, "embeddings")
    scored = S.score(e.where("label <> 0"), e.where("label = 0"))
    lane = F.when(F.col("label") <= 4, "web").when(F.col("label") <= 6, "code").when(F.col("label") == 7, "stem").when(F.col("label") == 8, "indic").otherwise("long_context")
    c = scored.select((F.col("vec_id") % 20).cast("int").alias("step"), lane.alias("lane"), F.col("vec_id").alias("idx"), "score", (F.col("vec_id") % 3).cast("int").alias("deferrals"))
    stage = F.when(F.col("step") >= 18, "anneal").otherwise("main")
    c = c.withColumn("mode", S.lane_mode(F.col("lane"), stage, ["indic", "reasoning", "agentic"], KEEP))
    n = F.count("*").over(Window.partitionBy("step", "lane"))
    return c.withColumn("quota", F.when(F.col("mode") == "selector", F.ceil(n * 0.4)).otherwise(n).cast("int"))


def opus_scores(spark, sf):
    return candidates(spark, sf).select("idx", "step", "lane", F.round("score", 6).alias("score"))


def decisions(spark, sf):
    return S.decide(candidates(spark, sf))


def opus_decide(spark, sf):
    return decisions(spark, sf).select("step", "lane", "idx", "rank_in_lane", "status", "reason")


def opus_floor_overrides(spark, sf):
    return decisions(spark, sf).where("reason = 'protected_floor_override'").select("step", "lane", "idx")


def decisions_by_lane(spark, sf):
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    return decisions(spark, sf).groupBy("lane").agg(of("accepted").alias("accepted"), of("deferred").alias("deferred"), of("rejected").alias("rejected"), F.round(of("rejected") / F.count("*"), 6).alias("rejection_rate"))


def deferral_fate(spark, sf):
    """A selector lane planned with its queue until candidates and queue are used up, for each label."""
    c = candidates(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), "label"), "idx").select("label", "idx", "score")
    planned = S.plan_steps(c, "label", lambda n: S.steps_to_drain(n, 2, 5))
    return planned.groupBy("label", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "status"))), lambda x: x["status"]), ",").alias("fate"))


def audit_q3_before_jump(spark, sf):
    j = loss_jump(spark, sf).where("branch = 0").select((F.col("step") % 20).cast("int").alias("step"), F.lit(0).alias("branch"))
    d = decisions(spark, sf).withColumn("branch", F.lit(0))
    return Q.before_jump(j, d, "branch", "step").select("spike", "step", "lane", "idx")


def audit_q4_review(spark, sf):
    return Q.review(decisions(spark, sf))


def audit_q5_overrides(spark, sf):
    d = decisions(spark, sf).where("status = 'accepted'").select("reason", (F.col("idx") % 7 + 1).alias("n_loss"), (F.col("idx") % 11).alias("loss_sum"))
    return Q.overrides(d)


def audit_q6_report_card(spark, sf):
    s = spans(spark, sf).select("shard", "n_loss", F.col("cents").alias("loss"), (F.col("cents") + F.col("n_loss") * (F.col("event_id") % 5 - 2) / 10).alias("loss_after"), (F.col("step") % 2).alias("pass"))
    return Q.report_card(s)


def audit_q7_firewall_trace(spark, sf):
    """Blocked events and evaluation reads in one list."""
    s = spans(spark, sf)
    blocked = s.where("event_type = 'error'").select(F.lit("blocked").alias("event"), "branch", "step", "event_id")
    return blocked.unionByName(s.where("event_type = 'view' and shard < 3").select(F.lit("eval_read").alias("event"), "branch", "step", "event_id"))


def perf_metrics(spark, sf):
    s = spans(spark, sf).groupBy("branch", "step").agg(F.sum("n_tokens").alias("real_tokens"), F.sum("n_loss").alias("loss_tokens"), F.count("*").alias("candidates_scored"), F.sum(F.when(F.col("event_type") != "click", 1).otherwise(0)).alias("accepted_rows"))
    s = s.withColumns({"token_positions": F.col("candidates_scored") * 100, "t_plan_s": F.col("candidates_scored") / 100, "t_total_s": F.col("candidates_scored") / 40})
    return Q.performance(s, "branch")


def perf_by_policy(spark, sf):
    """Utilisation of the chopped rows, and rows their documents would need under other policies."""
    rows = packing.pack_concat_chop_rows(spark, sf).agg(F.count("*").alias("n_rows"), F.sum("n_real").alias("n_real"))
    d = packing.stream(spark, sf)
    needed = d.agg(F.sum(F.ceil(F.col("n_tokens") / packing.BASE)).alias("pad_only_rows"), F.ceil(F.sum("n_tokens") / packing.BASE).alias("concat_rows"))
    return rows.crossJoin(needed).select("n_rows", "n_real", F.round(F.col("n_real") / (F.col("n_rows") * packing.BASE), 6).alias("utilization"), "pad_only_rows", "concat_rows")


def latencies(spark, sf):
    return Q.latency(records(spark, sf).select("cents"), "cents").select("n", "mean", "p50", "max")


def top3_tokens(spark, sf):
    return Q.top_tokens(spans(spark, sf), ["branch", "step"], "cents", "event_id").select("branch", "step", "event_id", "rank")


def multiset_equal(spark, sf):
    a = records(spark, sf).select("branch", "event_type")
    b = a.where("branch <> 1 or event_type <> 'click'").unionByName(a.where("branch = 2").limit(0))
    return Q.multiset_difference(a, b)


def two_run_compare(spark, sf):
    """Hashes of the batches of two runs that differ in one record."""
    a = L.batch_hashes(chain(spark, sf), "branch", F.col("step"))
    b = L.batch_hashes(L.build(records(spark, sf).withColumn("payload", F.when((F.col("branch") == 1) & (F.col("ledger_offset") == 130), "x").otherwise(F.col("payload")))), "branch", F.col("step"))
    return L.compare(a, b, ["branch", "batch"], ["batch_hash", "n_records"])


def counterfactual_policies(spark, sf):
    """Rows needed by the multilingual lane's streams under four policies."""
    d = packing.lane_stream(spark, sf, "indic").select("subpool", "h", "n_tokens")
    return P.counterfactual(d, ["subpool"], "h", packing.BASE, packing.stream_bucket(d))


RECORDS = """
r0 AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, user_id % 4 AS branch, ts FROM events),
rec AS (SELECT event_id, user_id, event_type, cents, branch, row_number() OVER (PARTITION BY branch ORDER BY ts, event_id) AS o,
          '{"branch":' || branch || ',"cents":' || cents || ',"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload FROM r0),
recs AS (SELECT *, (o - 1) // 50 AS step FROM rec)
"""
CHAIN = f"""{RECORDS},
ch AS (SELECT branch, o, repeat('0', 64) AS prev, sha256(repeat('0', 64) || '|' || payload) AS h FROM rec WHERE o = 1
       UNION ALL SELECT r.branch, r.o, ch.h, sha256(ch.h || '|' || r.payload) FROM ch JOIN rec r ON r.branch = ch.branch AND r.o = ch.o + 1)
"""
BATCH = f"{CHAIN}, bt AS (SELECT branch, (o - 1) // 50 AS batch, sha256(string_agg(h, ',' ORDER BY o)) AS bh FROM ch GROUP BY ALL)"
SPANS = f"{RECORDS}, sp AS (SELECT branch, step, user_id % 50 AS shard, user_id AS doc_id, event_id % 100 + 1 AS n_tokens, CASE WHEN event_type = 'click' THEN 0 ELSE event_id % 100 + 1 END AS n_loss, cents, event_id, event_type FROM recs)"
CAND = """
px AS (SELECT i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) WHERE label = 0 GROUP BY i),
pv AS (SELECT list(x ORDER BY i) AS proxy FROM px),
sc AS (SELECT vec_id AS idx, label, round(list_cosine_similarity(embedding::DOUBLE[], proxy), 9) AS score FROM embeddings, pv WHERE label <> 0),
c0 AS (SELECT *, (idx % 20)::INTEGER AS step, idx % 3 AS deferrals, CASE WHEN label <= 4 THEN 'web' WHEN label <= 6 THEN 'code' WHEN label = 7 THEN 'stem' WHEN label = 8 THEN 'indic' ELSE 'long_context' END AS lane FROM sc),
c1 AS (SELECT *, CASE WHEN step >= 18 THEN 'selector_off' WHEN lane = 'indic' THEN 'always_on' WHEN lane = 'web' THEN 'selector' WHEN lane IN ('code', 'stem') THEN 'keep_all' ELSE 'bypass' END AS mode FROM c0),
c2 AS (SELECT *, CASE WHEN mode = 'selector' THEN ceil(count(*) OVER (PARTITION BY step, lane) * 0.4) ELSE count(*) OVER (PARTITION BY step, lane) END AS quota, row_number() OVER (PARTITION BY step, lane ORDER BY score DESC, idx) - 1 AS rk FROM c1),
c3 AS (SELECT *, max(CASE WHEN mode = 'selector' AND rk = quota - 1 THEN score END) OVER (PARTITION BY step) AS cutoff FROM c2),
dec AS (SELECT step, lane, idx, rk::INTEGER AS rank_in_lane,
          CASE WHEN mode <> 'selector' OR rk < quota THEN 'accepted' WHEN rk < quota + ceil(0.5 * quota) AND deferrals < 2 THEN 'deferred' ELSE 'rejected' END AS status,
          CASE WHEN mode = 'selector_off' THEN 'selector_off_anneal' WHEN mode = 'always_on' THEN CASE WHEN score < cutoff THEN 'protected_floor_override' ELSE 'always_on_above_cutoff' END
               WHEN mode = 'keep_all' THEN 'keep_1.0_static_filter_only' WHEN mode = 'bypass' THEN 'selector_bypass_long_context' WHEN rk < quota THEN 'opus_selected'
               WHEN rk < quota + ceil(0.5 * quota) THEN CASE WHEN deferrals >= 2 THEN 'defer_expired' ELSE 'marginal_utility' END ELSE 'low_proxy_utility' END AS reason FROM c3)
"""
JUMP = f"""{SPANS}, sl AS (SELECT branch, step, sum(cents) / count(*) AS loss FROM sp GROUP BY ALL),
dj AS (SELECT branch, step, loss - lag(loss) OVER (PARTITION BY branch ORDER BY step) AS jump FROM sl),
jp AS (SELECT branch, step, jump FROM dj WHERE jump IS NOT NULL QUALIFY row_number() OVER (PARTITION BY branch ORDER BY jump DESC, step) = 1)
"""
SQL = {
    "ledger_chain": f"WITH RECURSIVE {CHAIN} SELECT branch, o AS ledger_offset, prev AS prev_record_hash, h AS record_hash FROM ch",
    "ledger_verify": f"WITH {RECORDS} SELECT branch, count(*) AS n_records, NULL::BIGINT AS first_bad, count(*) AS n_valid FROM rec GROUP BY branch",
    "ledger_tamper_first_break": f"WITH {RECORDS} SELECT branch, 100 + branch AS first_bad, 99 + branch AS n_valid FROM rec GROUP BY branch",
    "recover_to_checkpoint": f"""WITH {RECORDS} SELECT branch, CASE WHEN branch = 3 THEN 1000000000 ELSE 150 END::BIGINT AS checkpoint_offset, CASE WHEN branch = 3 THEN count(*) ELSE 150 END AS kept,
        CASE WHEN branch = 3 THEN 0 ELSE count(*) - 150 END AS orphans, CASE branch WHEN 2 THEN 'head_differs' WHEN 3 THEN 'offset_beyond_ledger' END AS refused FROM rec GROUP BY branch""",
    "orphaned_records": f"WITH {RECORDS} SELECT branch, o AS ledger_offset, event_id FROM rec WHERE branch < 3 AND o > 150",
    "side_ledger_truncate": f"WITH {RECORDS} SELECT branch, step, event_id FROM recs WHERE step <= 3",
    "stream_fingerprint": f"""WITH RECURSIVE {BATCH}, fo AS (SELECT branch, batch, sha256(repeat('0', 64) || '|' || batch || ':' || bh) AS h FROM bt WHERE batch = 0
        UNION ALL SELECT bt.branch, bt.batch, sha256(fo.h || '|' || bt.batch || ':' || bt.bh) FROM fo JOIN bt ON bt.branch = fo.branch AND bt.batch = fo.batch + 1)
        SELECT branch, arg_max(h, batch) AS fingerprint FROM fo GROUP BY branch""",
    "replay_compare": "SELECT * FROM (VALUES (0::BIGINT, 7::BIGINT, 'only_first'), (1, 9, 'cents'), (2, -1, 'only_second')) t(branch, ledger_offset, difference)",
    "fork_divergence": f"WITH {RECORDS} SELECT 121::BIGINT AS first_difference, greatest(count(*) FILTER (WHERE branch = 0), count(*) FILTER (WHERE branch = 1)) - 120 AS n_different FROM rec",
    "checkpoint_binding": f"""WITH RECURSIVE {CHAIN} SELECT b.branch, CASE WHEN b.branch = 3 THEN 1000000000 ELSE 150 END::BIGINT AS ledger_offset, b.branch < 2 AS bound, CASE WHEN b.branch < 3 THEN c.h END AS next_hash
        FROM (SELECT DISTINCT branch FROM rec) b JOIN ch c ON c.branch = b.branch AND c.o = 151""",
    "audit_q1_behind_checkpoints": f"""WITH {SPANS}, ck AS (SELECT DISTINCT branch, step AS checkpoint FROM sp WHERE step % 10 = 0)
        SELECT ck.branch, checkpoint, sum(n_tokens)::BIGINT AS tokens, sum(n_loss)::BIGINT AS loss_tokens, count(DISTINCT doc_id) AS docs FROM ck JOIN sp ON sp.branch = ck.branch AND sp.step <= checkpoint GROUP BY ALL""",
    "following_checkpoints": f"WITH {SPANS}, s AS (SELECT DISTINCT branch, step FROM sp) SELECT branch, step, (SELECT min(c.step) FROM s c WHERE c.branch = s.branch AND c.step >= s.step AND c.step % 10 = 0) AS checkpoint FROM s",
    "audit_q2_token_window": f"""WITH {SPANS}, st AS (SELECT branch, step, sum(n_tokens) AS n FROM sp GROUP BY ALL), cu AS (SELECT *, sum(n) OVER (PARTITION BY branch ORDER BY step) AS e FROM st)
        SELECT shard, sum(n_tokens)::BIGINT AS tokens, sum(n_loss)::BIGINT AS loss_tokens, count(DISTINCT doc_id) AS docs FROM sp JOIN cu USING (branch, step) WHERE e > 3000 AND e - n < 9000 GROUP BY shard""",
    "loss_jump": f"WITH {JUMP} SELECT branch, step, round(jump, 6) AS jump FROM jp",
    "opus_scores": f"WITH {CAND} SELECT idx, step, lane, round(score, 6) AS score FROM c0",
    "opus_decide": f"WITH {CAND} SELECT * FROM dec",
    "opus_floor_overrides": f"WITH {CAND} SELECT step, lane, idx FROM dec WHERE reason = 'protected_floor_override'",
    # a step takes five, the queue first; two are accepted and the third waits if it may
    "deferral_fate": f"""WITH RECURSIVE {CAND}, cs AS (SELECT label, list({{'i': idx, 's': score, 'd': 0}} ORDER BY idx) AS cs FROM sc GROUP BY label),
        pl AS (SELECT label, 0 AS step, cs[1:0] AS q, 1::BIGINT AS nxt, []::STRUCT(i BIGINT, st VARCHAR)[] AS made FROM cs
               UNION ALL
               SELECT label, step + 1, rest || CASE WHEN waits THEN [{{'i': o[3].i, 's': -o[3].k, 'd': o[3].d + 1}}] ELSE q[1:0] END, nxt,
                      list_transform(range(1, len(o) + 1), lambda j: {{'i': o[j].i, 'st': CASE WHEN j <= 2 THEN 'accepted' WHEN j = 3 AND waits THEN 'deferred' ELSE 'rejected' END}})
               FROM (SELECT *, len(o) >= 3 AND o[3].d < 2 AND len(rest) < 6 AS waits
               FROM (SELECT label, step, q, q[6:] AS rest, nxt + 5 - least(5, len(q)) AS nxt, list_sort(list_transform(q[1:5] || cs[nxt : nxt + 4 - least(5, len(q))], lambda x: {{'k': -x.s, 'i': x.i, 'd': x.d}})) AS o
                     FROM pl JOIN cs USING (label) WHERE len(q) > 0 OR nxt <= len(cs)))),
        ea AS (SELECT label, step, unnest(made) AS m FROM pl)
        SELECT label, m.i AS idx, string_agg(m.st, ',' ORDER BY step) AS fate FROM ea GROUP BY ALL""",
    "decisions_by_lane": f"WITH {CAND} SELECT lane, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'deferred') AS deferred, count(*) FILTER (WHERE status = 'rejected') AS rejected, round(count(*) FILTER (WHERE status = 'rejected') / count(*), 6) AS rejection_rate FROM dec GROUP BY lane",
    "audit_q3_before_jump": f"WITH {JUMP}, {CAND} SELECT (jp.step % 20)::INTEGER AS spike, dec.step, lane, idx FROM jp JOIN dec ON dec.step BETWEEN jp.step % 20 - 2 AND jp.step % 20 WHERE branch = 0 AND status = 'accepted'",
    "audit_q4_review": f"""WITH {CAND}, c AS (SELECT lane, idx, max((status = 'accepted')::INT) AS a, max((status = 'deferred')::INT) AS d FROM dec GROUP BY ALL)
        SELECT lane, count(*) AS considered, sum(a)::BIGINT AS trained, sum(1 - a)::BIGINT AS never_trained, sum(a * d)::BIGINT AS deferred_then_accepted FROM c GROUP BY lane""",
    "audit_q5_overrides": f"WITH {CAND} SELECT reason = 'protected_floor_override' AS overridden, count(*) AS n_rows, round(sum(idx % 11) / greatest(1, sum(idx % 7 + 1)), 6) AS mean_loss FROM dec WHERE status = 'accepted' GROUP BY ALL",
    "audit_q6_report_card": f"""WITH {SPANS}, s AS (SELECT shard, n_loss, cents::DOUBLE AS loss, cents + n_loss * (event_id % 5 - 2) / 10.0::DOUBLE AS after, step % 2 AS pass FROM sp),
        k AS (SELECT *, (after - loss) / greatest(1, n_loss) AS delta FROM s)
        SELECT shard, sum(n_loss)::BIGINT AS n_loss, round(sum(loss) / greatest(1, sum(n_loss)), 6) AS mean_loss, round(sum(after) / greatest(1, sum(n_loss)), 6) AS mean_loss_after,
          round(sum(loss) FILTER (WHERE pass = 0) / greatest(1, sum(n_loss) FILTER (WHERE pass = 0)), 6) AS first_pass_loss,
          count(*) FILTER (WHERE n_loss > 0 AND delta < -0.05) AS useful, count(*) FILTER (WHERE n_loss > 0 AND delta > 0.05) AS harmful, count(*) FILTER (WHERE n_loss > 0 AND abs(delta) <= 0.05) AS neutral, count(*) FILTER (WHERE n_loss = 0) AS no_signal
        FROM k GROUP BY shard""",
    "audit_q7_firewall_trace": f"WITH {SPANS} SELECT 'blocked' AS event, branch, step, event_id FROM sp WHERE event_type = 'error' UNION ALL SELECT 'eval_read', branch, step, event_id FROM sp WHERE event_type = 'view' AND shard < 3",
    "perf_metrics": f"""WITH {SPANS}, s AS (SELECT branch, step, sum(n_tokens) AS rt, sum(n_loss) AS lt, count(*) AS c, count(*) FILTER (WHERE event_type <> 'click') AS a FROM sp GROUP BY ALL)
        SELECT branch, count(*) AS steps, round(sum(rt) / sum(c * 100), 6) AS packing_utilization, round(sum(lt) / sum(c * 100), 6) AS loss_bearing_fraction, round(1 - sum(rt) / sum(c * 100), 6) AS padding_fraction,
          round((sum(rt) - sum(lt)) / sum(c * 100), 6) AS context_only_fraction, round(sum(c * 100) / sum(c / 40), 6) AS raw_token_positions_per_s, round(sum(lt) / sum(c / 40), 6) AS useful_tokens_per_s,
          round(sum(c / 100) / sum(c / 40), 6) AS loader_time_fraction, round(sum(a) / sum(c), 6) AS acceptance_rate FROM s GROUP BY branch""",
    "perf_by_policy": f"""WITH {packing.CHOP}, a AS (SELECT count(DISTINCT row_no) AS n_rows, sum(end_tok - start_tok)::BIGINT AS n_real FROM spans),
        b AS (SELECT sum(ceil(n_tokens / 512))::BIGINT AS pad_only_rows, ceil(sum(n_tokens) / 512)::BIGINT AS concat_rows FROM s)
        SELECT n_rows, n_real, round(n_real / (n_rows * 512), 6) AS utilization, pad_only_rows, concat_rows FROM a, b""",
    "counterfactual_policies": f"WITH RECURSIVE {packing.POOLED}, {packing.policies('subpool', 'indic')} SELECT subpool, pad_only, concat_chop, own + next_fit AS next_fit, own + best_fit AS best_fit_decreasing FROM policies",
    "latencies": f"WITH {RECORDS}, s AS (SELECT cents, row_number() OVER (ORDER BY cents) - 1 AS i, count(*) OVER () AS n FROM rec) SELECT count(*) AS n, round(avg(cents), 6) AS mean, max(cents) FILTER (WHERE i = n // 2) AS p50, max(cents) AS max FROM s",
    "top3_tokens": f"WITH {SPANS}, t AS (SELECT branch, step, event_id, row_number() OVER (PARTITION BY branch, step ORDER BY cents DESC, event_id)::INTEGER AS rank FROM sp) SELECT * FROM t WHERE rank <= 3",
    "multiset_equal": f"WITH {RECORDS} SELECT 'first' AS side, count(*) AS n FROM rec WHERE branch = 1 AND event_type = 'click' HAVING count(*) > 0",
    "two_run_compare": f"WITH {RECORDS} SELECT DISTINCT branch, step AS batch, 'batch_hash' AS difference FROM recs WHERE branch = 1 AND step >= 2",
}
QUERIES = {f.__name__: f for f in (ledger_chain, ledger_verify, ledger_tamper_first_break, recover_to_checkpoint, orphaned_records, side_ledger_truncate, stream_fingerprint, replay_compare, fork_divergence, checkpoint_binding, audit_q1_behind_checkpoints, following_checkpoints, audit_q2_token_window, loss_jump, opus_scores, opus_decide, opus_floor_overrides, decisions_by_lane, deferral_fate, audit_q3_before_jump, audit_q4_review, audit_q5_overrides, audit_q6_report_card, audit_q7_firewall_trace, perf_metrics, perf_by_policy, latencies, top3_tokens, multiset_equal, two_run_compare, counterfactual_policies)}
