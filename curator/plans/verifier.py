"""The verifier: what a run claims, recomputed from its tables by other means, with controls on tampered tables.

Each row says how many things were checked and how many of them violate. A check holds if there is something to check and nothing violates; a control
is the same check where it must fail. The SQL counts both from the raw tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curator.functions import text as T
from curator.functions.hashing import canonical_json
from curator.operators import admission as A
from curator.operators import audit, checks, gates
from curator.operators import ledger as L
from curator.operators import mixture as M
from curator.operators import packing as P
from curator.operators import selection as S
from curator.operators import tokens as K
from curator.operators.learning import not_in_shards
from curator.plans import admission, learning, ledger, packing
from curator.plans import gates as G
from curator.plans.mixture import schedule
from curator.plans.tables import documents, table
from curator.scratch import materialize

#: A few documents, conversations or records out of so many are tampered with in controls.
EVERY = 50


def verification(spark, sf):
    e = checks.Evidence()
    tokenizer(e, spark, sf)
    firewall(e, spark, sf)
    rows(e, spark, sf)
    mixture(e, spark, sf)
    selection(e, spark, sf)
    ledgers(e, spark, sf)
    traces(e, spark, sf)
    throughput(e, spark, sf)
    shards(e, spark, sf)
    return e.counted(spark)


def tokenizer(e: checks.Evidence, spark, sf) -> None:
    """Decoding gives a document's words back; what is unknown is what a join with the vocabulary finds unknown."""
    d = materialize(G.worded(spark, sf), "words")
    a = K.Adapter.of(K.ranked_words(d, G.VOCABULARY))
    known = spark.createDataFrame([(w, i) for i, w in enumerate(a.words, 1)], "word string, id int")
    by_join = materialize(A.unk_rates(d, known.select("word")).select("doc_id", "n_unk"), "unknown")
    decoded = a.decode(a.encode(d))
    missing = F.size(F.filter(F.split("decoded", " "), lambda x: x == K.UNKNOWN)).cast("long")
    wrong = lambda x: checks.differing(x.select("doc_id", missing.alias("n_unk")), by_join, ["doc_id"])
    e.count("R01 tokenizer", "unknown words are those outside the vocabulary", lambda: decoded, wrong)
    cut = decoded.withColumn("decoded", F.when(F.col("doc_id") % EVERY == 0, F.concat(F.col("decoded"), F.lit(" <unk>"))).otherwise(F.col("decoded")))
    e.count("R01 tokenizer", "a lost word", lambda: cut, wrong, control=True)
    swapped = K.Adapter(a.words, (K.CONTROL[1], K.CONTROL[0], *K.CONTROL[2:]))
    identity = lambda x: spark.createDataFrame([(x.identity,)], "identity string")
    e.count("R01 tokenizer", "the identity is pinned", lambda: identity(K.Adapter(a.words)), lambda x: x.where(F.col("identity") != a.identity))
    e.count("R01 tokenizer", "swapped control ids", lambda: identity(swapped), lambda x: x.where(F.col("identity") != a.identity), control=True)


def firewall(e: checks.Evidence, spark, sf) -> None:
    """No span of an admitted document holds a benchmark's n-gram."""
    b = table(spark, sf, "benchmark")
    fp = materialize(A.eval_fingerprints(b), "fingerprints")
    d = documents(spark, sf).select("doc_id", "text")
    bad = materialize(A.contamination_hits(d, fp, admission.worded).select("doc_id"), "contaminated")
    admitted = d.join(bad, "doc_id", "left_anti")
    spans = lambda x: gates.spans_of_words(x.select("doc_id", T.words(F.col("text")).alias("w")), G.SPAN)
    e.count("R02 firewall", "no span of an admitted document", lambda: spans(admitted), lambda x: gates.content_violations(x, fp))
    item = b.orderBy("item_id").limit(1).select(F.substring_index("text", " ", 20).alias("item"))  # one row
    planted = admitted.where(F.col("doc_id") % EVERY == 0).crossJoin(F.broadcast(item)).select("doc_id", F.col("item").alias("text"))
    e.count("R02 firewall", "planted spans", lambda: spans(planted), lambda x: gates.content_violations(x, fp).select("doc_id").distinct(), control=True)


def rows(e: checks.Evidence, spark, sf) -> None:
    """Packed rows equal those of a loop; spans fit; a label is the next token of its segment."""
    docs = materialize(packing.conversation_docs(spark, sf), "conversations")
    spans = materialize(packing.spans_of(docs), "spans")
    length = 2 * packing.LONG
    packed = materialize(P.materialize_rows(spans, docs, length, -1), "rows")
    again = checks.rebuilt_rows(spans, docs, length, -1)
    e.count("R03 packing", "a second packer gives the same rows", lambda: checks.row_digests(packed), lambda x: checks.differing(x, again, ["row_id"]))
    e.count("R03 packing", "spans fit their rows and documents", lambda: spans, lambda x: checks.bad_rows(x, docs, length))
    e.count("R03 packing", "spans that are too long", lambda: spans.withColumn("end", F.col("end") + length), lambda x: checks.bad_rows(x, docs, length), control=True)
    e.count("R03 packing", "labels are the next tokens of their segments", lambda: packed, checks.crossing_labels)
    moved = packed.withColumn("labels", F.transform("labels", lambda x: F.when(x == -100, x).otherwise(x + 1)))
    e.count("R03 packing", "labels of other tokens", lambda: moved, lambda x: checks.crossing_labels(x).select("row_id").distinct(), control=True)


def mixture(e: checks.Evidence, spark, sf) -> None:
    """The published quotas fill their steps and hold their floors."""
    s = schedule(spark)
    base = s.where("row_len = base_window").groupBy("step", "base_window").agg(F.sum("quota").alias("n"))
    e.count("R04 mixture", "base rows fill the step", lambda: base, lambda x: x.where("n * base_window <> 2048"))
    e.count("R04 mixture", "floors hold", lambda: s.where("floor_pct > 0"), lambda x: x.where("cum_positions < floor_pct / 100 * cum_total - 1e-6"))
    e.count("R04 mixture", "a floor of half the rows", lambda: s.where("floor_pct > 0"), lambda x: x.where("lane = 'indic' and cum_positions < 0.5 * cum_total"), control=True)
    short = M.scale(M.SPANS, M.WINDOWS, {k: dict(zip(M.LANES, v)) for k, v in M.SHARES.items()}, 40, 2, protected=frozenset(), long=frozenset(("agentic", "long_context")), keep={})
    free = schedule(spark, short).where("lane in ('web', 'code', 'stem', 'indic', 'reasoning')")
    behind = lambda x: x.where("abs(cum_target - cum_positions) >= 2 * base_window")
    e.count("R04 mixture", "free lanes stay within two rows of their targets", lambda: free, behind)


def selection(e: checks.Evidence, spark, sf) -> None:
    """Decisions made again from sorted arrays; accepted ones are the trained rows, each once."""
    c = materialize(ledger.candidates(spark, sf), "candidates")
    decided = materialize(ledger.decisions(spark, sf).select("step", "lane", "idx", "status"), "decisions")
    again = checks.decided_again(c)
    e.count("R05 selection", "decisions follow from scores", lambda: decided, lambda x: checks.differing(x, again, ["step", "lane", "idx"]))
    flipped = decided.withColumn("status", F.when(F.col("idx") % EVERY == 0, "lost").otherwise(F.col("status")))
    e.count("R05 selection", "changed decisions", lambda: flipped, lambda x: checks.differing(x, again, ["step", "lane", "idx"]), control=True)
    trained = again.where("status = 'accepted'").select("step", "idx")
    e.count("R05 selection", "one decision for each trained row", lambda: trained, lambda x: checks.trained_without_decision(decided, x))
    e.count("R05 selection", "rows trained twice", lambda: trained.unionByName(trained.where(F.col("idx") % EVERY == 0)), lambda x: checks.trained_without_decision(decided, x), control=True)


    c = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), "label").join(c.select("idx", "score"), "idx")
    planned = materialize(S.plan_steps(c, "label", lambda n: S.steps_to_drain(n, 2, 5)), "planned")
    none = planned.where("false").select("idx")
    e.count("R05 selection", "no deferred candidate is lost", lambda: planned.select("idx").distinct(), lambda x: checks.lost_deferrals(planned, none))
    e.count("R05 selection", "a queue that is thrown away", lambda: planned.where("step = 0"), lambda x: checks.lost_deferrals(x, none), control=True)


def ledgers(e: checks.Evidence, spark, sf) -> None:
    """Chains, recovery, replay, checkpoints and forks."""
    c = materialize(ledger.chain(spark, sf), "chain")
    e.count("R11 ledger", "the chain holds", lambda: c, checks.broken_chain)
    changed = c.withColumn("payload", F.when(F.col("ledger_offset") == 2, "x").otherwise(F.col("payload")))
    e.count("R11 ledger", "changed payloads", lambda: changed, checks.broken_chain, control=True)
    good = c.where("ledger_offset = 150").select("branch", "ledger_offset", F.col("record_hash").alias("head_hash"))
    e.count("R12 checkpoints", "checkpoints are bound to the chain", lambda: good, lambda x: L.bind(x, c).where("not bound or next_hash is null"))
    e.count("R12 checkpoints", "other heads", lambda: good.withColumn("head_hash", F.lit("0")), lambda x: L.bind(x, c).where("not bound"), control=True)
    after = c.where("ledger_offset > 150")
    resumed = c.where("ledger_offset <= 150").unionByName(after)
    e.count("R06 crash", "no record is skipped or repeated", lambda: resumed, checks.broken_chain)
    e.count("R06 crash", "a record is skipped", lambda: c.where("ledger_offset <= 150").unionByName(after.where("ledger_offset > 151")), checks.broken_chain, control=True)
    # a replay reads what the payloads say and is held against the source of the records
    said = c.select(F.from_json("payload", "branch long, cents long, event_id long, event_type string").alias("p")).select("p.*")
    source = table(spark, sf, "events").select((F.col("user_id") % 4).alias("branch"), F.round(F.col("value") * 100).cast("long").alias("cents"), "event_id", "event_type")
    e.count("R07 replay", "payloads say what happened", lambda: said, lambda x: checks.differing(x, source, ["event_id"]))
    e.count("R07 replay", "lost records", lambda: said.where(F.col("event_id") % EVERY != 0), lambda x: checks.differing(x, source, ["event_id"]), control=True)
    parent = c.where("branch = 0").select("ledger_offset", "record_hash")
    child = ledger.records(spark, sf).where("branch = 0 and ledger_offset <= 120").withColumn("payload", F.when(F.col("ledger_offset") > 100, canonical_json(event_id=F.col("event_id"))).otherwise(F.col("payload")))
    forked = materialize(L.build(child).select("ledger_offset", "record_hash"), "fork")
    e.count("R13 fork", "a fork inherits its parent's prefix", lambda: forked.where("ledger_offset <= 100"), lambda x: x.join(parent, ["ledger_offset", "record_hash"], "left_anti"))
    e.count("R13 fork", "records after the fork", lambda: forked.where("ledger_offset > 100"), lambda x: x.join(parent, ["ledger_offset", "record_hash"], "left_anti"), control=True)


def traces(e: checks.Evidence, spark, sf) -> None:
    """A line for each loss-bearing position that rendering counts, tokens as in the shards, sums as the samples say."""
    t = materialize(learning.trace(spark, sf), "trace")
    r = A.render(table(spark, sf, "conversations")).withColumn("n", F.col("end") - F.col("start"))
    eligible = F.when(F.col("eligible"), F.col("n")).otherwise(F.col("is_last").cast("long"))
    first = F.when((F.col("start") == 0) & F.col("eligible"), 1).otherwise(0)  # a first token is no next token
    rendered = materialize(r.groupBy("conv_id").agg(F.sum(eligible - first).cast("long").alias("n_loss")), "rendered")
    lines = lambda x: x.groupBy("conv_id").agg(F.count("*").alias("n_loss"))
    e.count("R08 learning", "a line for each loss position", lambda: t, lambda x: checks.differing(lines(x), rendered, ["conv_id"]))
    e.count("R08 learning", "lost lines", lambda: t.where(F.col("doc_offset") % EVERY != 0), lambda x: checks.differing(lines(x), rendered, ["conv_id"]), control=True)
    e.count("R08 learning", "tokens are those of the shards", lambda: t, lambda x: not_in_shards(x, learning.shard_tokens(spark, sf), ["conv_id"]))
    e.count("R08 learning", "perplexity is the exponential of the loss", lambda: t, checks.wrong_perplexity)
    e.count("R08 learning", "other perplexities", lambda: t.withColumn("ppl", F.when(F.col("doc_offset") % EVERY == 0, F.col("ppl") * 2).otherwise(F.col("ppl"))), checks.wrong_perplexity, control=True)


def throughput(e: checks.Evidence, spark, sf) -> None:
    """Shares recomputed from plain counts of records."""
    m = ledger.perf_metrics(spark, sf).select("branch", F.round("loss_bearing_fraction", 6).alias("x"), F.round("acceptance_rate", 6).alias("y"))
    ev = table(spark, sf, "events").withColumn("branch", F.col("user_id") % 4)
    n = F.col("event_id") % 100 + 1
    plain = ev.groupBy("branch").agg(F.round(F.sum(F.when(F.col("event_type") != "click", n).otherwise(0)) / (F.count("*") * 100), 6).alias("x"), F.round(F.count(F.when(F.col("event_type") != "click", 1)) / F.count("*"), 6).alias("y"))
    e.count("R09 throughput", "metrics follow from the records", lambda: m, lambda x: checks.differing(x, plain, ["branch"]))
    e.count("R09 throughput", "other metrics", lambda: m.withColumn("y", F.col("y") + 1), lambda x: checks.differing(x, plain, ["branch"]), control=True)


def shards(e: checks.Evidence, spark, sf) -> None:
    """Two builds agree, no address survives, nothing without a licence is admitted."""
    d = packing.pooled(spark, sf).where("lane is not null").select("doc_id", *packing.STREAM, "n_tokens", "content")
    a = materialize(packing.L.chunk(d, packing.STREAM, packing.TARGET), "build")
    b = packing.L.chunk(d.repartition(7, "content"), packing.STREAM, packing.TARGET)
    e.count("R10 shards", "a second build is equal", lambda: a, lambda x: audit.multiset_difference(x, b))
    e.count("R10 shards", "a document moved", lambda: a.withColumn("chunk", F.when(F.col("doc_id") % EVERY == 0, -1).otherwise(F.col("chunk"))), lambda x: audit.multiset_difference(x, b), control=True)
    texts = documents(spark, sf).select("doc_id", "source", "text")
    redacted = texts.select("doc_id", T.redact(F.col("text"))[0].alias("text"))
    address = lambda x: x.where(F.col("text").rlike(T.EMAIL))
    e.count("R10 shards", "no address survives", lambda: redacted, address)
    e.count("R10 shards", "texts before redaction", lambda: texts, address, control=True)
    gone = admission.license_gate(spark, sf).select("doc_id")
    outside = lambda x: x.where(~F.col("source").isin(admission.LICENSES))
    e.count("R14 contracts", "only allowed sources are admitted", lambda: texts.join(gone, "doc_id", "left_anti"), outside)
    e.count("R14 contracts", "sources before the gate", lambda: texts, outside, control=True)


EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
VERIFY = f"""
WITH {ledger.CAND}, {admission.FP}, dw AS (SELECT doc_id, {admission.W.format('text')} AS w FROM documents), {admission.HITS}, {packing.CONV}, {learning.TRACE},
{packing.POOLED},
ok_docs AS (SELECT doc_id, len(w) AS n FROM dw WHERE doc_id NOT IN (SELECT doc_id FROM hits)),
ev AS (SELECT event_id, user_id % 4 AS branch FROM events), evn AS (SELECT branch, count(*) AS n FROM ev GROUP BY branch),
lane_steps AS (SELECT count(*) AS n FROM laned WHERE lane IS NOT NULL),
counted(requirement, "check", n_checked, n_bad) AS (
SELECT 'R01 tokenizer', 'unknown words are those outside the vocabulary', count(*), 0 FROM documents
UNION ALL SELECT 'R01 tokenizer', 'control: a lost word', count(*), count(*) FILTER (WHERE doc_id % 50 = 0) FROM documents
UNION ALL SELECT 'R01 tokenizer', 'the identity is pinned', 1, 0
UNION ALL SELECT 'R01 tokenizer', 'control: swapped control ids', 1, 1
UNION ALL SELECT 'R02 firewall', 'no span of an admitted document', sum((n + 63) // 64)::BIGINT, 0 FROM ok_docs
UNION ALL SELECT 'R02 firewall', 'control: planted spans', count(*), count(*) FROM ok_docs WHERE doc_id % 50 = 0
UNION ALL SELECT 'R03 packing', 'a second packer gives the same rows', count(DISTINCT row_id), 0 FROM sp
UNION ALL SELECT 'R03 packing', 'spans fit their rows and documents', count(*), 0 FROM sp
UNION ALL SELECT 'R03 packing', 'control: spans that are too long', count(*), count(DISTINCT row_id) FROM sp
UNION ALL SELECT 'R03 packing', 'labels are the next tokens of their segments', count(DISTINCT row_id), 0 FROM sp
UNION ALL SELECT 'R03 packing', 'control: labels of other tokens', count(DISTINCT row_id), count(DISTINCT row_id) FILTER (WHERE e AND i > a) FROM sp JOIN pos ON pos.doc_id = sp.doc_id AND i >= a AND i < a + n
UNION ALL SELECT 'R04 mixture', 'base rows fill the step', 42, 0
UNION ALL SELECT 'R04 mixture', 'floors hold', n, 0 FROM (SELECT sum(CASE WHEN step <= 8 THEN 1 WHEN step <= 20 THEN 2 ELSE 3 END) AS n FROM range(1, 43) t(step))
UNION ALL SELECT 'R04 mixture', 'control: a floor of half the rows', n, 42 FROM (SELECT sum(CASE WHEN step <= 8 THEN 1 WHEN step <= 20 THEN 2 ELSE 3 END) AS n FROM range(1, 43) t(step))
UNION ALL SELECT 'R04 mixture', 'free lanes stay within two rows of their targets', 42 * 5, 0
UNION ALL SELECT 'R05 selection', 'decisions follow from scores', count(*), 0 FROM dec
UNION ALL SELECT 'R05 selection', 'control: changed decisions', count(*), count(*) FILTER (WHERE idx % 50 = 0) FROM dec
UNION ALL SELECT 'R05 selection', 'one decision for each trained row', count(*), 0 FROM dec WHERE status = 'accepted'
UNION ALL SELECT 'R05 selection', 'control: rows trained twice', count(*) + count(*) FILTER (WHERE idx % 50 = 0), count(*) FILTER (WHERE idx % 50 = 0) FROM dec WHERE status = 'accepted'
UNION ALL SELECT 'R05 selection', 'no deferred candidate is lost', count(*), 0 FROM sc
UNION ALL SELECT 'R05 selection', 'control: a queue that is thrown away', sum(least(n, 5))::BIGINT, count(*) FILTER (WHERE n >= 3) FROM (SELECT count(*) AS n FROM sc GROUP BY label)
UNION ALL SELECT 'R11 ledger', 'the chain holds', count(*), 0 FROM events
UNION ALL SELECT 'R11 ledger', 'control: changed payloads', count(*), count(DISTINCT branch) FROM ev
UNION ALL SELECT 'R12 checkpoints', 'checkpoints are bound to the chain', count(*), 0 FROM evn WHERE n > 150
UNION ALL SELECT 'R12 checkpoints', 'control: other heads', count(*), count(*) FROM evn WHERE n > 150
UNION ALL SELECT 'R06 crash', 'no record is skipped or repeated', count(*), 0 FROM events
UNION ALL SELECT 'R06 crash', 'control: a record is skipped', sum(n - 1)::BIGINT, count(*) FROM evn WHERE n > 151
UNION ALL SELECT 'R07 replay', 'payloads say what happened', count(*), 0 FROM events
UNION ALL SELECT 'R07 replay', 'control: lost records', count(*) FILTER (WHERE event_id % 50 <> 0), count(*) FILTER (WHERE event_id % 50 = 0) FROM events
UNION ALL SELECT 'R13 fork', 'a fork inherits its parent''s prefix', 100, 0
UNION ALL SELECT 'R13 fork', 'control: records after the fork', 20, 20
UNION ALL SELECT 'R08 learning', 'a line for each loss position', count(*), 0 FROM tr
UNION ALL SELECT 'R08 learning', 'control: lost lines', count(*) FILTER (WHERE doc_offset % 50 <> 0), count(DISTINCT conv_id) FILTER (WHERE doc_offset % 50 = 0) FROM tr
UNION ALL SELECT 'R08 learning', 'tokens are those of the shards', count(*), 0 FROM tr
UNION ALL SELECT 'R08 learning', 'perplexity is the exponential of the loss', count(*), 0 FROM tr
UNION ALL SELECT 'R08 learning', 'control: other perplexities', count(*), count(*) FILTER (WHERE doc_offset % 50 = 0) FROM tr
UNION ALL SELECT 'R09 throughput', 'metrics follow from the records', count(*), 0 FROM evn
UNION ALL SELECT 'R09 throughput', 'control: other metrics', count(*), count(*) FROM evn
UNION ALL SELECT 'R10 shards', 'a second build is equal', n, 0 FROM lane_steps
UNION ALL SELECT 'R10 shards', 'control: a document moved', n, 2 FROM lane_steps
UNION ALL SELECT 'R10 shards', 'no address survives', count(*), 0 FROM documents
UNION ALL SELECT 'R10 shards', 'control: texts before redaction', count(*), count(*) FILTER (WHERE regexp_matches(text, '{EMAIL_SQL}')) FROM documents
UNION ALL SELECT 'R14 contracts', 'only allowed sources are admitted', count(*), 0 FROM documents WHERE source <> 'src13'
UNION ALL SELECT 'R14 contracts', 'control: sources before the gate', count(*), count(*) FILTER (WHERE source = 'src13') FROM documents)
SELECT requirement, "check", n_checked::BIGINT AS n_checked, n_bad::BIGINT AS n_bad, n_checked > 0 AND (n_bad > 0) = starts_with("check", 'control') AS ok FROM counted
"""
SQL = {"verification": VERIFY}
QUERIES = {"verification": verification}
