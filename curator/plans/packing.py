"""Queries on lanes, shards and packed rows. A token is a word; every document ends with one more."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.functions import text as T
from curator.operators import admission as A
from curator.operators import lanes as L
from curator.operators import packing as P
from curator.operators.sized import running_sum
from curator.plans.admission import W
from curator.plans.tables import documents, table
from curator.scratch import materialize

SEED, BASE, LONG, TARGET = 1234, 512, 4096, 60_000
#: Documents of a stream that are packed in one task.
PER_BUCKET = 100_000
FRACTIONS, NEED = {"web": 0.05, "indic": 0.1, "stem": 0.02}, {"web": 20_000, "indic": 5_000}
STREAM = ["lane", "pool", "subpool"]


def lane_docs(spark, sf) -> DataFrame:
    """Documents and conversations with lane, pool, subpool and token count. Conversations have ids from 10**12 on."""
    digits = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 4
    hint = F.when(F.col("lang") != "en", "indic").when(digits.isin(0, 1), "web").when(digits == 2, "stem").otherwise("code")
    d = documents(spark, sf)
    d = d.select("doc_id", "lang", "source", (T.n_words(F.col("text")) + 1).cast("long").alias("n_tokens"), hint.alias("lane_hint"), F.lit(0).cast("long").alias("tool_calls"), F.sha2("text", 256).alias("content"), F.contains("text", F.lit("@")).cast("int").alias("pii"))
    c = A.render(table(spark, sf, "conversations")).groupBy("conv_id").agg(F.max("end").alias("n_tokens"), F.sum(F.col("eligible").cast("long")).alias("tool_calls"))
    c = c.select((F.col("conv_id") + 10**12).alias("doc_id"), F.lit("en").alias("lang"), F.lit("chat").alias("source"), "n_tokens", F.lit("agentic").alias("lane_hint"), "tool_calls", F.sha2(F.col("conv_id").cast("string"), 256).alias("content"), F.lit(0).alias("pii"))
    # texts are read once; everything from here on works on these narrow rows
    return materialize(L.assign(d.unionByName(c), BASE, LONG), "lanes")


def pooled(spark, sf) -> DataFrame:
    return L.reserve(lane_docs(spark, sf), SEED, FRACTIONS, NEED)


def lane_assignment(spark, sf):
    return lane_docs(spark, sf).select("doc_id", "lane", "subpool", "pool", "n_tokens")


def anneal_reserve(spark, sf):
    return pooled(spark, sf).where("pool = 'reserve'").select("doc_id", "lane", "n_tokens")


def lane_pool_summary(spark, sf):
    return pooled(spark, sf).where("lane is not null").groupBy("lane", "pool", "subpool").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def epoch_shuffle(spark, sf):
    d = lane_docs(spark, sf).where("lane is not null").select("doc_id", "lane")
    return L.epoch_order(d, SEED, 2, F.col("lane")).select("lane", "epoch", "doc_id", "rank")


def chunks(spark, sf) -> DataFrame:
    d = pooled(spark, sf).where("lane is not null").select("doc_id", *STREAM, "n_tokens", "lang", "source", "content", "pii")
    return L.chunk(d, STREAM, TARGET)


def shard_chunking(spark, sf):
    return chunks(spark, sf).select("doc_id", *STREAM, "chunk")


def shard_doc_index(spark, sf):
    return chunks(spark, sf).select("doc_id", *STREAM, "chunk", "offset", "n_tokens")


def shard_content_hash(spark, sf):
    return L.shard_ids(chunks(spark, sf), STREAM, "words/1").select("shard_id", "content_hash", *STREAM, "chunk")


def shard_manifest(spark, sf):
    c = chunks(spark, sf)
    m = L.manifest(c, L.shard_ids(c, STREAM, "words/1"), STREAM)
    return m.select("shard_id", "n_documents", "token_count", F.array_join("languages", ",").alias("languages"), F.array_join("sources", ",").alias("sources"), "pii_status")


def stream(spark, sf) -> DataFrame:
    """Documents of the web lane in hash order."""
    d = pooled(spark, sf).where("lane = 'web' and pool = 'main'").select("doc_id", "lane", "n_tokens")
    return d.withColumn("h", L.order_key(F.lit(SEED), F.col("lane"), F.lit(0), F.col("doc_id")))


def chopped(spark, sf) -> DataFrame:
    return P.concat_chop(stream(spark, sf), ["lane"], [F.col("h"), F.col("doc_id")], L.hash_bucket(F.col("h")), BASE)


def pack_concat_chop_spans(spark, sf):
    return chopped(spark, sf).select("lane", "row", "doc_id", "start", "end").withColumnsRenamed({"row": "row_no", "start": "start_tok", "end": "end_tok"})


def pack_concat_chop_rows(spark, sf):
    return chopped(spark, sf).groupBy("lane", F.col("row").alias("row_no")).agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("n_real"))


def lane_stream(spark, sf, lane: str) -> DataFrame:
    """All documents of a lane with their order in the stream."""
    d = pooled(spark, sf).where(F.col("lane") == lane).select("doc_id", *STREAM, "n_tokens")
    return d.withColumn("h", L.order_key(F.lit(SEED), F.col("lane"), F.lit(0), F.col("doc_id")))


def stream_bucket(docs: DataFrame):
    """Buckets along the order of hashes, of about ``PER_BUCKET`` documents; None if one holds all."""
    digits = math.ceil(math.log(max(docs.count() / PER_BUCKET, 1), 16))
    return F.substring("h", 1, digits) if digits else None


def pack_next_fit(spark, sf):
    """Whole documents in rows of BASE tokens; row_no is null for those that no row holds."""
    d = lane_stream(spark, sf, "indic")
    return P.next_fit(d, STREAM, "h", BASE, stream_bucket(d)).select(*STREAM, "doc_id", F.col("row").alias("row_no"))


def pack_best_fit(spark, sf):
    """The look-ahead packer on the code lane; row_no and ord are null for documents that no row holds."""
    return P.best_fit(lane_stream(spark, sf, "code"), STREAM, "h", BASE, 8).select(*STREAM, "doc_id", F.col("row").alias("row_no"), "ord")


def counterfactual_rows(spark, sf):
    d = lane_stream(spark, sf, "web").select("lane", "h", "n_tokens")
    return P.counterfactual(d, ["lane"], "h", BASE, stream_bucket(d))


def conversation_docs(spark, sf) -> DataFrame:
    """Conversations with their tokens, token i of a conversation being number i, and which are eligible for loss."""
    r = A.render(table(spark, sf, "conversations"))
    e = r.withColumn("n", F.col("end") - F.col("start"))
    elig = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "n", "eligible", "is_last"))), lambda t: F.when(t["is_last"], F.concat(F.array_repeat(t["eligible"].cast("int"), (t["n"] - 1).cast("int")), F.array(F.lit(1)))).otherwise(F.array_repeat(t["eligible"].cast("int"), t["n"].cast("int")))))
    docs = e.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sum("n").alias("n_tokens"), elig.alias("elig"))
    return docs.withColumn("tokens", F.sequence(F.lit(0), (F.col("n_tokens") - 1).cast("int")))


def spans_of(docs: DataFrame) -> DataFrame:
    """Rows of two spans in order of ids; a conversation over LONG tokens is cut into spans of LONG."""
    d = docs.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n_tokens") - 1).cast("long"), F.lit(LONG).cast("long"))).alias("start"))
    d = running_sum(d.withColumn("k", F.lit(1)), ["k"], [F.col("doc_id"), F.col("start")], F.lit(1), F.floor(F.col("doc_id") / 4096), "i")
    return d.select((F.col("i") / 2).cast("long").alias("row_id"), (F.col("i") % 2).alias("ord"), "doc_id", "start", F.least(F.col("start") + LONG, F.col("n_tokens")).alias("end"))


def packed(spark, sf) -> DataFrame:
    docs = conversation_docs(spark, sf)
    return P.materialize_rows(spans_of(docs), docs, 2 * LONG, -1)


def row_loss_mask(spark, sf):
    masked = F.aggregate(F.zip_with("labels", "loss_mask", lambda x, m: F.when(m == 1, x).otherwise(F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return packed(spark, sf).select("row_id", F.col("n_real").cast("long").alias("n_real"), F.col("n_loss").cast("long").alias("n_loss"), masked.alias("label_sum"))


def row_positions(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return packed(spark, sf).select("row_id", total("position_ids").alias("position_sum"), total("segment_ids").alias("segment_sum"), F.size("tokens").cast("long").alias("length"))


def attention_pairs(spark, sf):
    return P.attention_pairs(spans_of(conversation_docs(spark, sf)), 2 * LONG)


def microbatches(spark, sf):
    d = documents(spark, sf).select("doc_id", (F.col("doc_id") % 10).alias("step"), F.when(F.col("lang") == "en", 128).otherwise(256).alias("L"))
    return P.microbatches(d, "step", ["doc_id"], 1024).select("step", "L", "doc_id", "microbatch")


HEX = lambda parts: f"substr(sha256({parts}), 1, 16)"
LANED = f"""
raw AS (
  SELECT doc_id, lang, source, len({W.format('text')}) + 1 AS n, CASE WHEN lang <> 'en' THEN 'indic' ELSE CASE CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'web' WHEN 2 THEN 'stem' ELSE 'code' END END AS hint,
         0 AS tc, sha256(text) AS content, contains(text, '@')::INT AS pii FROM documents
  UNION ALL
  SELECT conv_id + 1000000000000, 'en', 'chat', sum(len({W.format("coalesce(text, '')")}) + 1) + 1, 'agentic', count(*) FILTER (WHERE role IN ('assistant', 'tool_call')), sha256(conv_id::VARCHAR), 0 FROM conversations GROUP BY conv_id),
l1 AS (SELECT *, CASE WHEN hint = 'code' THEN CASE WHEN n <= 512 THEN 'code' WHEN n <= 4096 THEN 'long_context' END WHEN hint = 'agentic' THEN CASE WHEN n <= 4096 THEN hint END ELSE hint END AS lane FROM raw),
laned AS (SELECT doc_id, lang, source, n::BIGINT AS n_tokens, content, pii, lane, CASE WHEN lane = 'indic' THEN CASE WHEN n <= 200 THEN 'B0_B1' WHEN n <= 450 THEN 'B2_B3' ELSE 'B4_B5' END WHEN lane IS NOT NULL THEN 'all' END AS subpool,
          CASE WHEN lane = 'agentic' AND tc < 2 THEN 'reserve' WHEN lane IS NOT NULL THEN 'main' END AS pool FROM l1)
"""
POOLED = f"""{LANED},
o AS (SELECT *, {HEX("'1234|reserve|' || lane || '|' || doc_id")} AS h FROM laned WHERE pool = 'main'),
r AS (SELECT *, row_number() OVER w - 1 AS bd, sum(n_tokens) OVER w - n_tokens AS bt, count(*) OVER (PARTITION BY lane) AS nd FROM o WINDOW w AS (PARTITION BY lane ORDER BY h, doc_id)),
pooled AS (SELECT doc_id, lang, source, n_tokens, content, pii, lane, subpool,
             CASE WHEN lane IN ('web', 'indic', 'stem') AND (bd < greatest(1, ceil(CASE lane WHEN 'web' THEN 0.05 WHEN 'indic' THEN 0.1 ELSE 0.02 END * nd - 1e-6)) OR bt < CASE lane WHEN 'web' THEN 20000 WHEN 'indic' THEN 5000 ELSE 0 END) THEN 'reserve' ELSE 'main' END AS pool FROM r
           UNION ALL SELECT doc_id, lang, source, n_tokens, content, pii, lane, subpool, pool FROM laned WHERE pool IS DISTINCT FROM 'main')
"""
CHUNKS = f"""{POOLED},
q2 AS (SELECT *, row_number() OVER (PARTITION BY lane, pool, subpool ORDER BY doc_id) AS i FROM pooled WHERE lane IS NOT NULL),
c AS (SELECT doc_id, lane, pool, subpool, n_tokens, i, 0 AS chunk, 0::BIGINT AS off, n_tokens AS used FROM q2 WHERE i = 1
      UNION ALL
      SELECT q2.doc_id, q2.lane, q2.pool, q2.subpool, q2.n_tokens, q2.i, CASE WHEN c.used + q2.n_tokens > 60000 THEN c.chunk + 1 ELSE c.chunk END,
             CASE WHEN c.used + q2.n_tokens > 60000 THEN 0 ELSE c.used END, CASE WHEN c.used + q2.n_tokens > 60000 THEN q2.n_tokens ELSE c.used + q2.n_tokens END
      FROM c JOIN q2 ON q2.i = c.i + 1 AND q2.lane = c.lane AND q2.pool = c.pool AND q2.subpool = c.subpool)
"""
SHARDS = f"""{CHUNKS},
g AS (SELECT c.lane, c.pool, c.subpool, c.chunk, count(*) AS n_documents, sum(c.n_tokens)::BIGINT AS token_count, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
        CASE WHEN sum(pii) > 0 THEN 'redacted' ELSE 'clean' END AS pii_status,
        sha256('words/1|' || c.lane || '|' || c.pool || '|' || c.subpool || '|' || string_agg(c.doc_id || ':' || c.off || ':' || c.n_tokens || ':' || content, ',' ORDER BY c.doc_id)) AS content_hash
      FROM c JOIN q2 ON c.doc_id = q2.doc_id GROUP BY c.lane, c.pool, c.subpool, c.chunk),
shards AS (SELECT *, 'shd-' || lane || '-' || substr(content_hash, 1, 12) AS shard_id FROM g)
"""
CHOP = f"""{POOLED},
s AS (SELECT doc_id, lane, n_tokens, sum(n_tokens) OVER (ORDER BY {HEX("'1234|web|0|' || doc_id")}, doc_id) - n_tokens AS p0 FROM pooled WHERE lane = 'web' AND pool = 'main'),
x AS (SELECT *, unnest(range((p0 // 512)::BIGINT, ((p0 + n_tokens - 1) // 512 + 1)::BIGINT)) AS row_no FROM s),
spans AS (SELECT lane, row_no::BIGINT AS row_no, doc_id, greatest(0, row_no * 512 - p0)::BIGINT AS start_tok, least(n_tokens, (row_no + 1) * 512 - p0)::BIGINT AS end_tok FROM x)
"""


def policies(key: str, lane: str) -> str:
    """Rows under four policies of each ``key`` of a lane: next-fit and best-fit decreasing one document after the other."""
    return f"""
d AS (SELECT {key}, n_tokens AS n, row_number() OVER (PARTITION BY {key} ORDER BY {HEX(f"'1234|{lane}|0|' || doc_id")}) AS i, row_number() OVER (PARTITION BY {key} ORDER BY n_tokens DESC, doc_id) AS j FROM pooled WHERE lane = '{lane}' AND n_tokens <= 512),
di AS (SELECT {key}, n, row_number() OVER (PARTITION BY {key} ORDER BY i) AS i FROM d), dj AS (SELECT {key}, n, row_number() OVER (PARTITION BY {key} ORDER BY j) AS j FROM d),
nf AS (SELECT {key}, 1::BIGINT AS i, 1::BIGINT AS r, 512 - n AS free FROM di WHERE i = 1
       UNION ALL SELECT {key}, x.i, CASE WHEN x.n > nf.free THEN r + 1 ELSE r END, CASE WHEN x.n > nf.free THEN 512 ELSE nf.free END - x.n FROM nf JOIN di x USING ({key}) WHERE x.i = nf.i + 1),
bf AS (SELECT {key}, 1::BIGINT AS j, [512 - n] AS open FROM dj WHERE j = 1
       UNION ALL SELECT {key}, j, CASE WHEN m IS NULL THEN open || [512 - n] ELSE open[1 : list_position(open, m) - 1] || open[list_position(open, m) + 1 :] || [m - n] END
       FROM (SELECT {key}, x.j, x.n, open, list_min(list_filter(open, lambda f: f >= x.n)) AS m FROM bf JOIN dj x USING ({key}) WHERE x.j = bf.j + 1)),
whole AS (SELECT {key}, sum(ceil(n_tokens / 512))::BIGINT AS pad_only, ceil(sum(n_tokens) / 512)::BIGINT AS concat_chop, coalesce(sum(ceil(n_tokens / 512)) FILTER (WHERE n_tokens > 512), 0)::BIGINT AS own FROM pooled WHERE lane = '{lane}' GROUP BY {key}),
policies AS (SELECT w.*, coalesce((SELECT max(r) FROM nf WHERE nf.{key} = w.{key}), 0) AS next_fit, coalesce((SELECT max(len(open)) FROM bf WHERE bf.{key} = w.{key}), 0) AS best_fit FROM whole w)
"""


CONV = f"""
t AS (SELECT conv_id, turn, role IN ('assistant', 'tool_call') AS e, len({W.format("coalesce(text, '')")}) + 1 AS n FROM conversations),
t2 AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS s FROM t),
docs AS (SELECT conv_id AS doc_id, (sum(n) + 1)::BIGINT AS n_tokens FROM t GROUP BY conv_id),
cut AS (SELECT doc_id, n_tokens, unnest(range(0, n_tokens, 4096)) AS a FROM docs),
sp AS (SELECT doc_id, a, least(a + 4096, n_tokens) - a AS n, (row_number() OVER (ORDER BY doc_id, a) - 1) // 2 AS row_id, (row_number() OVER (ORDER BY doc_id, a) - 1) % 2 AS ord FROM cut),
pos AS (SELECT conv_id AS doc_id, unnest(range(s::BIGINT, (s + n)::BIGINT)) AS i, e FROM t2 UNION ALL SELECT doc_id, n_tokens - 1, true FROM docs)
"""

SQL = {
    "lane_assignment": f"WITH {LANED} SELECT doc_id, lane, subpool, pool, n_tokens FROM laned",
    "anneal_reserve": f"WITH {POOLED} SELECT doc_id, lane, n_tokens FROM pooled WHERE pool = 'reserve'",
    "lane_pool_summary": f"WITH {POOLED} SELECT lane, pool, subpool, count(*) AS n_docs, sum(n_tokens)::BIGINT AS n_tokens FROM pooled WHERE lane IS NOT NULL GROUP BY ALL",
    "epoch_shuffle": f"WITH {LANED} SELECT lane, epoch::INTEGER AS epoch, doc_id, (row_number() OVER (PARTITION BY lane, epoch ORDER BY {HEX(chr(39) + '1234|' + chr(39) + ' || lane || ' + chr(39) + '|' + chr(39) + ' || epoch || ' + chr(39) + '|' + chr(39) + ' || doc_id')}, doc_id) - 1)::BIGINT AS rank FROM laned, range(2) e(epoch) WHERE lane IS NOT NULL",
    "shard_chunking": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, lane, pool, subpool, chunk::INTEGER AS chunk FROM c",
    "shard_doc_index": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, lane, pool, subpool, chunk::INTEGER AS chunk, off::BIGINT AS \"offset\", n_tokens FROM c",
    "shard_content_hash": f"WITH RECURSIVE {SHARDS} SELECT shard_id, content_hash, lane, pool, subpool, chunk::INTEGER AS chunk FROM shards",
    "shard_manifest": f"WITH RECURSIVE {SHARDS} SELECT shard_id, n_documents, token_count, languages, sources, pii_status FROM shards",
    "pack_concat_chop_spans": f"WITH {CHOP} SELECT * FROM spans",
    "pack_concat_chop_rows": f"WITH {CHOP} SELECT lane, row_no, count(*) AS n_spans, sum(end_tok - start_tok)::BIGINT AS n_real FROM spans GROUP BY ALL",
    "pack_next_fit": f"""WITH RECURSIVE {POOLED},
        s AS (SELECT doc_id, lane, pool, subpool, n_tokens, row_number() OVER (PARTITION BY lane, pool, subpool ORDER BY {HEX("'1234|indic|0|' || doc_id")}) AS i FROM pooled WHERE lane = 'indic' AND n_tokens <= 512),
        f AS (SELECT *, 0 AS row_no, 512 - n_tokens AS free FROM s WHERE i = 1 UNION ALL
              SELECT s.*, CASE WHEN s.n_tokens > f.free THEN f.row_no + 1 ELSE f.row_no END, CASE WHEN s.n_tokens > f.free THEN 512 ELSE f.free END - s.n_tokens FROM f JOIN s ON s.i = f.i + 1 AND s.lane = f.lane AND s.pool = f.pool AND s.subpool = f.subpool)
        SELECT lane, pool, subpool, doc_id, row_no::BIGINT AS row_no FROM f UNION ALL SELECT lane, pool, subpool, doc_id, NULL FROM pooled WHERE lane = 'indic' AND n_tokens > 512""",
    # the buffer is a list of (place, length); a step takes its longest that fits, or opens a row and fills the buffer
    "pack_best_fit": f"""WITH RECURSIVE {POOLED},
        g AS (SELECT lane, pool, subpool, list({{'d': doc_id, 'n': n_tokens}} ORDER BY {HEX("'1234|code|0|' || doc_id")}) AS ds FROM pooled WHERE lane = 'code' AND n_tokens <= 512 GROUP BY ALL),
        b AS (SELECT lane, pool, subpool, []::STRUCT(i BIGINT, n BIGINT)[] AS buf, 1::BIGINT AS nxt, -1::BIGINT AS r, 0 AS o, 0::BIGINT AS free, NULL::BIGINT AS taken FROM g
              UNION ALL
              SELECT lane, pool, subpool, CASE WHEN i IS NULL THEN buf || list_transform(range(nxt, least(nxt + 8 - len(buf), len(ds) + 1)), lambda k: {{'i': k, 'n': ds[k].n}}) ELSE list_filter(buf, lambda x: x.i <> i) END,
                     CASE WHEN i IS NULL THEN least(nxt + 8 - len(buf), len(ds) + 1) ELSE nxt END, CASE WHEN i IS NULL THEN r + 1 ELSE r END, CASE WHEN i IS NULL THEN 0 ELSE o + 1 END, CASE WHEN i IS NULL THEN 512 ELSE free - ds[i].n END, i
              FROM (SELECT b.*, ds, list_min(list_transform(list_filter(buf, lambda x: x.n = list_max(list_transform(list_filter(buf, lambda y: y.n <= free), lambda y: y.n))), lambda x: x.i)) AS i FROM b JOIN g USING (lane, pool, subpool))
              WHERE i IS NOT NULL OR len(buf) > 0 OR nxt <= len(ds))
        SELECT lane, pool, subpool, ds[taken].d AS doc_id, r AS row_no, (o - 1)::INTEGER AS ord FROM b JOIN g USING (lane, pool, subpool) WHERE taken IS NOT NULL
        UNION ALL SELECT lane, pool, subpool, doc_id, NULL, NULL FROM pooled WHERE lane = 'code' AND n_tokens > 512""",
    "counterfactual_rows": f"WITH RECURSIVE {POOLED}, {policies('lane', 'web')} SELECT lane, pad_only, concat_chop, own + next_fit AS next_fit, own + best_fit AS best_fit_decreasing FROM policies",
    "row_loss_mask": f"WITH {CONV} SELECT row_id, count(*) AS n_real, count(*) FILTER (WHERE e AND i > a) AS n_loss, coalesce(sum(i) FILTER (WHERE e AND i > a), 0)::BIGINT AS label_sum FROM sp JOIN pos ON pos.doc_id = sp.doc_id AND i >= a AND i < a + n GROUP BY row_id",
    "row_positions": f"WITH {CONV} SELECT row_id, sum(n * (n - 1) // 2)::BIGINT AS position_sum, sum(n * (ord + 1))::BIGINT AS segment_sum, 8192::BIGINT AS length FROM sp GROUP BY row_id",
    "attention_pairs": f"WITH {CONV} SELECT row_id, (sum(n * (n + 1) // 2) + 8192 - sum(n))::BIGINT AS allowed FROM sp GROUP BY row_id",
    "microbatches": """WITH d AS (SELECT doc_id, doc_id % 10 AS step, CASE WHEN lang = 'en' THEN 128 ELSE 256 END AS L FROM documents)
        SELECT step, L, doc_id, ((row_number() OVER (PARTITION BY step, L ORDER BY doc_id) - 1) // (1024 // L))::INTEGER AS microbatch FROM d""",
}
QUERIES = {f.__name__: f for f in (lane_assignment, anneal_reserve, lane_pool_summary, epoch_shuffle, shard_chunking, shard_doc_index, shard_manifest, shard_content_hash, pack_concat_chop_spans, pack_concat_chop_rows, pack_next_fit, pack_best_fit, counterfactual_rows, row_loss_mask, row_positions, attention_pairs, microbatches)}
