"""Queries on learning traces. Tokens are the words of conversations behind a marker for each turn; losses are stand-ins that follow from ids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.functions import text as T
from curator.operators import learning as R
from curator.operators import ledger as L
from curator.operators import mixture as M
from curator.plans import ledger, packing
from curator.plans.admission import W
from curator.plans.tables import table

STEPS, MAIN = 42, 40


def shard_tokens(spark, sf):
    """(conv_id, tokens, elig) of every conversation."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.array(F.concat(F.lit("<"), "role", F.lit(">"))), T.words(F.coalesce("text", F.lit("")))).alias("t"), F.col("role").isin("assistant", "tool_call").alias("e"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "t", "e")))
    g = c.groupBy("conv_id").agg(parts.alias("p"))
    tokens = F.concat(F.flatten(F.transform("p", lambda x: x["t"])), F.array(F.lit("<eos>")))
    elig = F.concat(F.flatten(F.transform("p", lambda x: F.array_repeat(x["e"], F.size(x["t"])))), F.array(F.lit(True)))
    return g.select("conv_id", tokens.alias("tokens"), elig.alias("elig"))


def trace(spark, sf):
    """A line for each loss-bearing token: step, conversation, offset, token, loss, perplexity."""
    t = shard_tokens(spark, sf).select("conv_id", F.posexplode(F.arrays_zip("tokens", "elig")).alias("doc_offset", "x")).select("conv_id", "doc_offset", F.col("x.tokens").alias("token"), F.col("x.elig").alias("elig"))
    t = t.where("elig and doc_offset > 0").withColumn("step", (F.col("conv_id") % STEPS + 1).cast("int"))
    losses = t.select("conv_id", "doc_offset", ((F.col("conv_id") * 131 + F.col("doc_offset") * 17) % 6000 / 1000).alias("loss"))
    return R.build_trace(t.drop("elig"), losses, ["conv_id"])


def learning_trace(spark, sf):
    return trace(spark, sf).select("step", "conv_id", "doc_offset", "token", F.round("loss", 6).alias("loss"), F.round("ppl", 6).alias("ppl"))


def learning_trace_hash(spark, sf):
    line = F.concat_ws(",", "step", "conv_id", "doc_offset", "token", F.round(F.col("loss") * 1000).cast("long").cast("string"))
    return R.trace_hash(trace(spark, sf), "step", line, ["conv_id", "doc_offset"])


def token_lookup(spark, sf):
    """A trace with some changed tokens against the shards: the lines that do not hold."""
    changed = F.when((F.col("conv_id") + F.col("doc_offset")) % 97 == 0, F.lit("changed")).otherwise(F.col("token"))
    return R.not_in_shards(trace(spark, sf).withColumn("token", changed), shard_tokens(spark, sf), ["conv_id"]).select("conv_id", F.col("doc_offset").cast("long").alias("doc_offset"), "token")


def learning_samples(spark, sf):
    """Spans with their sums and names."""
    s = R.samples(trace(spark, sf), ["step", "conv_id"])
    lengths = shard_tokens(spark, sf).select("conv_id", F.size("tokens").alias("end"))
    j = s.join(lengths, "conv_id")
    name = R.sample_id(F.col("conv_id"), F.lit(0), F.col("end"), F.lit(0))
    return j.select("step", name.alias("sample_id"), R.span_id(F.col("conv_id"), F.lit(0), F.col("end")).alias("span_id"), "n_loss", F.round("loss_sum", 6).alias("loss_sum"))


def lane_samples(spark, sf):
    """Samples of the lanes' documents: every token but the first bears loss."""
    d = packing.lane_docs(spark, sf).where("lane is not null").select("doc_id", "lane", "lang", (F.col("n_tokens") - 1).alias("n_loss"), (F.col("doc_id") % STEPS + 1).cast("int").alias("step"))
    return d.withColumn("loss_sum", F.col("n_loss") * (F.col("doc_id") * 37 % 5000 / 1000))


def lane_phase_loss(spark, sf):
    """Mean loss by lane and phase of the run."""
    p = M.default_plan()
    phase = F.create_map(*[x for s in range(1, STEPS + 1) for x in (F.lit(s), F.lit(M.phase_of(s, p.stages[-1].start - 1)))])
    return R.mean_loss(lane_samples(spark, sf), F.col("lane"), phase[F.col("step")].alias("phase"))


def validation_loss_by_language(spark, sf):
    """Mean loss by language of the documents held out for validation."""
    return R.mean_loss(lane_samples(spark, sf).where("doc_id % 10 = 0"), F.col("lang"))


def decisions_with_ledger(spark, sf):
    """Decisions with the model that scored them: the state after the batch before."""
    b = L.batch_hashes(ledger.chain(spark, sf).where("branch = 0"), "branch", F.col("step")).select(F.col("batch").alias("step"), "batch_hash")
    return R.scoring_models(ledger.decisions(spark, sf).select("step", "lane", "idx"), b)


def decision_records(spark, sf):
    """Decisions with their names and the loss-bearing tokens that a score is worth."""
    d = ledger.decisions(spark, sf).withColumn("n_loss", F.col("idx") % 100 + 1)
    number = F.row_number().over(Window.partitionBy("step").orderBy("lane", "rank_in_lane")) - 1
    return d.select(R.decision_id("main", F.col("step"), number).alias("decision_id"), R.candidate_id(F.col("idx"), F.lit(0), F.col("n_loss"), F.lit(0)).alias("candidate_id"), "idx", F.round(F.greatest("score", F.lit(0.0)) * F.col("n_loss"), 3).alias("effective_tokens"))


TRACE = f"""
cw AS (SELECT conv_id, turn, role, ['<' || role || '>'] || {W.format("coalesce(text, '')")} AS t FROM conversations),
ct AS (SELECT *, sum(len(t)) OVER (PARTITION BY conv_id ORDER BY turn) - len(t) AS s FROM cw),
tk AS (SELECT conv_id, (s + unnest(range(0, len(t))))::BIGINT AS doc_offset, unnest(t) AS token, role IN ('assistant', 'tool_call') AS e FROM ct
       UNION ALL SELECT conv_id, sum(len(t))::BIGINT, '<eos>', true FROM cw GROUP BY conv_id),
tr AS (SELECT (conv_id % 42 + 1)::INTEGER AS step, conv_id, doc_offset, token, (conv_id * 131 + doc_offset * 17) % 6000 AS milli FROM tk WHERE e AND doc_offset > 0)
"""
LANE = f"{packing.LANED}, sm AS (SELECT doc_id, lane, lang, n_tokens - 1 AS n, doc_id % 42 + 1 AS step, (n_tokens - 1) * (doc_id * 37 % 5000 / 1000) AS l FROM laned WHERE lane IS NOT NULL)"
SQL = {
    "learning_trace": f"WITH {TRACE} SELECT step, conv_id, doc_offset::INTEGER AS doc_offset, token, milli / 1000 AS loss, round(exp(milli / 1000), 6) AS ppl FROM tr",
    "learning_trace_hash": f"WITH {TRACE} SELECT step, count(*) AS n_lines, sha256(string_agg(step || ',' || conv_id || ',' || doc_offset || ',' || token || ',' || milli, chr(10) ORDER BY conv_id, doc_offset)) AS trace_sha256 FROM tr GROUP BY step",
    "token_lookup": f"WITH {TRACE} SELECT conv_id, doc_offset, 'changed' AS token FROM tr WHERE (conv_id + doc_offset) % 97 = 0 AND token <> 'changed'",
    "learning_samples": f"""WITH {TRACE}, n AS (SELECT conv_id, count(*) AS n FROM tk GROUP BY conv_id), s AS (SELECT step, conv_id, count(*) AS n_loss, sum(milli) AS m FROM tr GROUP BY ALL)
        SELECT step, 'smp-' || substr(sha256(conv_id || '|0|' || n || '|0'), 1, 16) AS sample_id, conv_id || '[0:' || n || ')' AS span_id, n_loss, round(m / 1000, 6) AS loss_sum FROM s JOIN n USING (conv_id)""",
    "lane_phase_loss": f"WITH {LANE} SELECT lane, CASE WHEN step > 40 THEN 'anneal' WHEN step <= 40 / 3 THEN 'early' WHEN step <= 80 / 3 THEN 'mid' ELSE 'late' END AS phase, sum(n)::BIGINT AS n_loss, round(sum(l) / greatest(1, sum(n)), 6) AS mean_loss FROM sm GROUP BY ALL",
    "validation_loss_by_language": f"WITH {LANE} SELECT lang, sum(n)::BIGINT AS n_loss, round(sum(l) / greatest(1, sum(n)), 6) AS mean_loss FROM sm WHERE doc_id % 10 = 0 GROUP BY lang",
    "decisions_with_ledger": f"WITH RECURSIVE {ledger.BATCH}, {ledger.CAND} SELECT dec.step, lane, idx, bh AS scoring_model FROM dec LEFT JOIN bt ON bt.branch = 0 AND bt.batch = dec.step - 1",
    "decision_records": f"""WITH {ledger.CAND}, d AS (SELECT dec.*, sc.score, dec.idx % 100 + 1 AS n, row_number() OVER (PARTITION BY step ORDER BY lane, rank_in_lane) - 1 AS k FROM dec JOIN sc USING (idx))
        SELECT printf('sel-main-s%05d-%03d', step, k) AS decision_id, 'cand-' || substr(sha256(idx || '|0|' || n || '|0'), 1, 16) AS candidate_id, idx, round(greatest(score, 0) * n, 3) AS effective_tokens FROM d""",
}
QUERIES = {f.__name__: f for f in (learning_trace, learning_trace_hash, token_lookup, learning_samples, lane_phase_loss, validation_loss_by_language, decisions_with_ledger, decision_records)}
