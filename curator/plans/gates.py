"""Queries on the tokenizer adapter and on the gates before training."""

from __future__ import annotations

from pyspark.sql import functions as F

from curator.functions import text as T
from curator.operators import admission as A
from curator.operators import gates as G
from curator.operators import mixture as M
from curator.operators import selection as S
from curator.operators import tokens as K
from curator.plans.admission import FP, HITS, RED1, W
from curator.plans.admission import worded as words_of
from curator.plans.tables import documents, table, values

SEED, VOCABULARY, SPAN = 1234, 10_000, 64


def worded(spark, sf):
    return documents(spark, sf).select("doc_id", T.words(F.col("text")).alias("w"))


def adapter(spark, sf) -> K.Adapter:
    return K.Adapter.of(K.ranked_words(worded(spark, sf), VOCABULARY))


def encode_documents(spark, sf):
    """Ids of every document's words and the end token."""
    a = adapter(spark, sf)
    ids = F.concat("ids", F.array(F.lit(a.control_id("<eos>"))))
    unknown = F.size(F.filter("ids", lambda x: x == 0))
    return a.encode(worded(spark, sf)).select("doc_id", F.size(ids).cast("long").alias("n_tokens"), unknown.cast("long").alias("n_unk"), F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"))


def decode_documents(spark, sf):
    """The names of the ids of every document: its words, with unknown ones marked."""
    a = adapter(spark, sf)
    d = a.encode(worded(spark, sf)).withColumn("ids", F.concat("ids", F.array(F.lit(a.control_id("<eos>")))))
    return a.decode(d).select("doc_id", F.sha2("decoded", 256).alias("decoded_sha256"))


def special_tokens(spark, sf):
    """Special tokens of every conversation, and a preview of its first three tokens."""
    a = adapter(spark, sf)
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    marker = F.create_map(*[x for r in ("system", "user", "assistant", "tool_call", "tool") for x in (F.lit(r), F.lit(a.control_id(f"<{r}>")))])
    c = a.encode(c).withColumn("ids", F.concat(F.array(marker[F.col("role")]), "ids"))
    g = c.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "ids"))), lambda x: x["ids"])).alias("ids"))
    g = g.withColumn("ids", F.concat("ids", F.array(F.lit(a.control_id("<eos>")))))
    first = a.decode(g.withColumn("head", F.slice("ids", 1, 3)), "head", "preview")
    return first.select("conv_id", F.size("ids").cast("long").alias("n_tokens"), F.size(F.filter("ids", a.is_special)).cast("long").alias("n_special"), "preview")


def tokenizer_identity(spark, sf):
    a = adapter(spark, sf)
    return values(spark, [(a.vocabulary_sha256, a.base, a.control_id("<tool>"))], "vocabulary_sha256 string, base int, last_control_id int")


def pii_exemption(spark, sf):
    """Sources 0 and 7 count as public code."""
    d = G.pii_status(documents(spark, sf).select("doc_id", "source", "text"), F.col("source").isin("src0", "src7"))
    return d.select("doc_id", "pii_status", F.sha2("redacted", 256).alias("redacted_sha256"))


def top_documents_by_hash(spark, sf):
    d = documents(spark, sf).select("doc_id", "source")
    return G.top_by_hash(d, 44, F.lit(SEED), F.lit("articles"), F.col("doc_id")).select("doc_id", "source")


def contamination_drill(spark, sf):
    """Documents with a planted item, and what the contamination gate finds in them."""
    b = table(spark, sf, "benchmark")
    d = G.drills(documents(spark, sf), b, 8, SEED)
    hits = A.contamination_hits(d.select(F.col("drill").alias("doc_id"), T.words(F.col("text")).alias("w")), A.eval_fingerprints(b)).withColumnRenamed("doc_id", "of")
    return d.join(hits, F.col("drill") == F.col("of"), "left").select("drill", "doc_id", "item_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.col("hits").isNotNull().alias("refused"))


def content_gate_spans(spark, sf):
    """Spans of documents that may not be trained on."""
    return G.content_violations(G.spans_of_words(worded(spark, sf), SPAN), A.eval_fingerprints(table(spark, sf, "benchmark")))


def contaminated(spark, sf):
    """(doc_id, source) of documents with a benchmark's n-gram."""
    hits = A.contamination_hits(documents(spark, sf).select("doc_id", "text"), A.eval_fingerprints(table(spark, sf, "benchmark")), words_of).select(F.col("doc_id").alias("of"))
    return documents(spark, sf).select("doc_id", "source").join(hits, F.col("doc_id") == F.col("of")).drop("of")


def source_firewall(spark, sf):
    """Sources with a contaminated document are removed from the plan."""
    sources = documents(spark, sf).groupBy("source").agg(F.count("*").alias("n_docs"))
    return G.remove_sources(sources, contaminated(spark, sf).select("source", F.lit("benchmark_contamination").alias("reason"))).select("source", "n_docs", "action", "reason", "n_violations")


def candidate_gate(spark, sf):
    """Documents as candidates of one selector lane: contaminated ones are rejected before the others are ranked."""
    c = documents(spark, sf).select((F.col("doc_id") % 20).cast("int").alias("step"), F.lit("web").alias("lane"), F.lit("selector").alias("mode"), F.col("doc_id").alias("idx"), (F.col("doc_id") * 7919 % 1000 / 1000).alias("score"), (F.col("doc_id") % 3).cast("int").alias("deferrals"))
    clean, stopped = G.gate_candidates(c, contaminated(spark, sf).select(F.col("doc_id").alias("idx")))
    quota = clean.groupBy(F.col("step").alias("of")).agg(F.ceil(F.count("*") * 0.4).cast("int").alias("quota"))
    decided = S.decide(clean.join(F.broadcast(quota), F.col("step") == F.col("of")))  # a row for each step
    return decided.select("step", "idx", "status", "reason").unionByName(stopped.select("step", "idx", "status", "reason"))


def deferred_stage_mismatch(spark, sf):
    """Deferred candidates that come back a step later, when the lane's row length or pool may have changed."""
    p = M.default_plan()
    plan = values(spark, [(s, "web", "reserve" if p.stage(s).name == p.anneal else "main", M.base_window(p, s)) for s in range(1, p.stages[-1].end + 1)], "step int, lane string, pool string, row_len int")
    at = plan.select(F.col("step").alias("_step"), "pool", "row_len")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.lit("web").alias("lane"), (F.col("vec_id") % 41 + 1).cast("int").alias("deferred_at"))
    q = e.join(F.broadcast(at), F.col("deferred_at") == F.col("_step")).withColumn("step", F.col("deferred_at") + 1)
    return G.stage_mismatches(q.select("idx", "lane", "step", "pool", "row_len"), plan).select("idx", "step", "status", "reason")


def eval_documents_by_id(spark, sf):
    """Documents under the id of a benchmark item."""
    b = table(spark, sf, "benchmark").select("item_id", F.length("text").cast("long").alias("item_chars"))
    return documents(spark, sf).select("doc_id", "source").join(b, F.col("doc_id") == F.col("item_id")).select("item_id", "source", "item_chars")


def eval_read_log(spark, sf):
    """Reads of shards, one for each document: sources 0 to 5 hold evaluation data, 19 is not registered."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    registry = values(spark, [(f"src{i}", ("test", "test", "proxy", "proxy", "validation", "validation")[i] if i < 6 else "train") for i in range(19)], "shard_id string, split string")
    r = documents(spark, sf).where(number < 8).select("doc_id", F.col("source").alias("shard_id"), F.when(F.col("doc_id") % 2 == 0, "validation").otherwise("proxy").alias("purpose"), (F.col("doc_id") % 5 == 0).alias("grad_enabled"))
    r = r.unionByName(documents(spark, sf).where(number == 19).select("doc_id", F.col("source").alias("shard_id"), F.lit("proxy").alias("purpose"), F.lit(False).alias("grad_enabled")))
    return G.eval_reads(r, registry).select("doc_id", "shard_id", "allowed", "refused")


VOCAB_SQL = f"""
dw AS (SELECT doc_id, {W.format('text')} AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM dw),
v AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS id FROM each GROUP BY word QUALIFY row_number() OVER (ORDER BY count(*) DESC, word) <= {VOCABULARY}),
base AS (SELECT count(*) + 1 AS base FROM v)
"""
HASH = "substr(sha256('1234|{0}|' || {1}), 1, 16)"
BAD = f"{FP}, dw AS (SELECT doc_id, {W.format('text')} AS w FROM documents), {HITS}, bad AS (SELECT doc_id FROM hits)"
SQL = {
    "encode_documents": f"""WITH {VOCAB_SQL}, t AS (SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ',' ORDER BY pos) || ',' AS ids, count(*) AS n, count(*) FILTER (WHERE id IS NULL) AS u FROM each LEFT JOIN v USING (word) GROUP BY doc_id)
        SELECT dw.doc_id, coalesce(n, 0) + 1 AS n_tokens, coalesce(u, 0) AS n_unk, sha256(coalesce(ids, '') || base) AS ids_sha256 FROM dw LEFT JOIN t USING (doc_id), base""",
    "decode_documents": f"""WITH {VOCAB_SQL}, t AS (SELECT doc_id, string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE word END, ' ' ORDER BY pos) || ' ' AS s FROM each LEFT JOIN v USING (word) GROUP BY doc_id)
        SELECT dw.doc_id, sha256(coalesce(s, '') || '<eos>') AS decoded_sha256 FROM dw LEFT JOIN t USING (doc_id)""",
    "special_tokens": f"""WITH {VOCAB_SQL}, c AS (SELECT conv_id, turn, role, {W.format("coalesce(text, '')")} AS cw FROM conversations),
        n AS (SELECT conv_id, sum(len(cw) + 1)::BIGINT + 1 AS n_tokens, count(*) + 1 AS n_special FROM c GROUP BY conv_id),
        tk AS (SELECT conv_id, turn, unnest(['<' || role || '>'] || cw) AS word, unnest(range(0, len(cw) + 1)) AS pos FROM c),
        h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS k FROM tk QUALIFY k <= 3),
        p AS (SELECT conv_id, string_agg(CASE WHEN pos > 0 AND id IS NULL THEN '<unk>' ELSE h.word END, ' ' ORDER BY k) AS s, count(*) AS m FROM h LEFT JOIN v ON h.word = v.word AND pos > 0 GROUP BY conv_id)
        SELECT conv_id, n_tokens, n_special, s || CASE WHEN m < 3 THEN ' <eos>' ELSE '' END AS preview FROM n JOIN p USING (conv_id)""",
    "tokenizer_identity": f"WITH {VOCAB_SQL} SELECT sha256(string_agg(word, chr(10) ORDER BY id)) AS vocabulary_sha256, max(base)::INTEGER AS base, max(base + 6)::INTEGER AS last_control_id FROM v, base",
    "pii_exemption": f"""WITH r1 AS (SELECT doc_id, source, text, {RED1} AS r1, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS ne FROM documents),
        r2 AS (SELECT *, len(regexp_extract_all(r1, '(^|[^0-9])(?:\\+?[0-9]{{1,3}}[ -]?)?[0-9]{{5}}[ -]?[0-9]{{5}}([^0-9]|$)')) AS np, regexp_replace(r1, '(^|[^0-9])(?:\\+?[0-9]{{1,3}}[ -]?)?[0-9]{{5}}[ -]?[0-9]{{5}}([^0-9]|$)', '\\1<PHONE>\\2', 'g') AS red FROM r1)
        SELECT doc_id, CASE WHEN source IN ('src0', 'src7') THEN 'exempt_public_source_code' WHEN ne + np > 0 THEN 'redacted' ELSE 'clean' END AS pii_status, sha256(CASE WHEN source IN ('src0', 'src7') THEN text ELSE red END) AS redacted_sha256 FROM r2""",
    "top_documents_by_hash": f"SELECT doc_id, source FROM documents ORDER BY {HASH.format('articles', 'doc_id')}, doc_id LIMIT 44",
    "contamination_drill": f"""WITH ho AS (SELECT doc_id AS host, text, row_number() OVER (ORDER BY {HASH.format('host', 'doc_id')}, doc_id) AS drill FROM documents QUALIFY drill <= 8),
        it AS (SELECT item_id, text AS item, row_number() OVER (ORDER BY {HASH.format('item', 'item_id')}, item_id) AS drill FROM benchmark QUALIFY drill <= 8),
        dr AS (SELECT drill, host, item_id, left(text, 400) || chr(10) || item AS text FROM ho JOIN it USING (drill)), {FP}, dw AS (SELECT drill AS doc_id, {W.format('text')} AS w FROM dr), {HITS}
        SELECT drill::INTEGER AS drill, host AS doc_id, item_id, coalesce(hits, 0) AS hits, hits IS NOT NULL AS refused FROM dr LEFT JOIN hits ON hits.doc_id = drill""",
    "content_gate_spans": f"""WITH {FP}, ws AS (SELECT doc_id AS d, {W.format('text')} AS all_w FROM documents), sn AS (SELECT d, unnest(range(0, (len(all_w) + {SPAN - 1}) // {SPAN})) AS span_no, all_w FROM ws),
        dw AS (SELECT (d, span_no) AS doc_id, all_w[span_no * {SPAN} + 1 : (span_no + 1) * {SPAN}] AS w FROM sn), {HITS}
        SELECT doc_id[1] AS doc_id, doc_id[2]::INTEGER AS span_no, 'benchmark_contamination' AS reason, hits FROM hits
        UNION ALL SELECT doc_id[1], doc_id[2]::INTEGER, 'eval_canary', 1 FROM dw WHERE contains(array_to_string(w, ' '), 'curator eval canary 5b1d')""",
    "source_firewall": f"""WITH {BAD}, s AS (SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE doc_id IN (FROM bad)) AS nv FROM documents GROUP BY source)
        SELECT source, n_docs, CASE WHEN nv > 0 THEN 'removed' ELSE 'kept' END AS action, CASE WHEN nv > 0 THEN 'benchmark_contamination' END AS reason, nv AS n_violations FROM s""",
    "candidate_gate": f"""WITH {BAD}, c AS (SELECT (doc_id % 20)::INTEGER AS step, doc_id AS idx, doc_id * 7919 % 1000 AS score, doc_id % 3 AS deferrals, doc_id IN (FROM bad) AS stopped FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, idx) - 1 AS rk, ceil(count(*) OVER (PARTITION BY step) * 0.4) AS q FROM c WHERE NOT stopped)
        SELECT step, idx, CASE WHEN rk < q THEN 'accepted' WHEN rk < q + ceil(0.5 * q) AND deferrals < 2 THEN 'deferred' ELSE 'rejected' END AS status,
               CASE WHEN rk < q THEN 'opus_selected' WHEN rk < q + ceil(0.5 * q) THEN CASE WHEN deferrals < 2 THEN 'marginal_utility' ELSE 'defer_expired' END ELSE 'low_proxy_utility' END AS reason FROM r
        UNION ALL SELECT step, idx, 'rejected', 'eval_firewall' FROM c WHERE stopped""",
    "deferred_stage_mismatch": """WITH q AS (SELECT vec_id AS idx, (vec_id % 41 + 2)::INTEGER AS step FROM embeddings)
        SELECT idx, step, CASE WHEN step IN (19, 41) THEN 'rejected' ELSE 'taken' END AS status, CASE WHEN step IN (19, 41) THEN 'stage_mismatch' END AS reason FROM q""",
    "eval_documents_by_id": "SELECT item_id, source, length(b.text) AS item_chars FROM documents d JOIN benchmark b ON d.doc_id = b.item_id",
    "eval_read_log": """WITH r AS (SELECT doc_id, source, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS k, doc_id % 2 = 0 AS even, doc_id % 5 = 0 AS grad FROM documents)
        SELECT doc_id, source AS shard_id, refused IS NULL AS allowed, refused FROM (SELECT *, CASE WHEN k = 19 THEN 'unregistered' WHEN k < 2 THEN 'split_not_readable:test' WHEN k > 5 THEN 'split_not_readable:train'
          WHEN (k < 4) = even THEN 'purpose_not_permitted' WHEN grad THEN 'gradients_enabled' END AS refused FROM r WHERE k < 8 OR k = 19)""",
}
QUERIES = {f.__name__: f for f in (encode_documents, decode_documents, special_tokens, tokenizer_identity, pii_exemption, top_documents_by_hash, contamination_drill, content_gate_spans, source_firewall, candidate_gate, deferred_stage_mismatch, eval_documents_by_id, eval_read_log)}
