"""Queries that write tables in every format of the engine, read them back and say what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curator.functions.hashing import sha256_arrays
from curator.operators import admission as A
from curator.operators import ledger as L
from curator.operators import mixture as M
from curator.plans import learning, ledger, packing, streams
from curator.plans.admission import FP
from curator.plans.mixture import MIX
from curator.plans.tables import documents, table
from curator.scratch import materialize, shared_root
from curator.sources import readers, writers


def place(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def json_lines_round_trip(spark, sf):
    """Documents as JSON lines."""
    path = place(spark, "jsonl")
    writers.write_json_lines(documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").alias("language")), path)
    return readers.corpora(spark, {"web": path}).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "language", F.sha2(readers.message_text(), 256).alias("text_sha256"))


def messages_round_trip(spark, sf):
    """Conversations as documents with messages."""
    path = place(spark, "messages")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    writers.write_json_lines(c.select(F.col("conv_id").cast("string").alias("doc_id"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")), path)
    d = readers.corpora(spark, {"chat": path})
    return d.select(F.col("doc_id").cast("long").alias("conv_id"), F.size("messages").cast("long").alias("n_messages"), F.sha2(readers.message_text(), 256).alias("text_sha256"))


def trace_round_trip(spark, sf):
    """The learning trace as CSV, with the hashes that were returned when it was written."""
    path = place(spark, "trace")
    t = learning.trace(spark, sf).select("step", "conv_id", "doc_offset", "token")
    hashes = materialize(writers.append_trace(t, path, "step", F.concat_ws(",", "conv_id", "doc_offset", "token"), ["conv_id", "doc_offset"]), "trace-hashes")
    n = readers.csv_trace(spark, path, "step int, conv_id long, doc_offset int, token string").groupBy("step").agg(F.count("*").alias("n_read"))
    return hashes.join(n, "step").select("step", "n_lines", "n_read", "trace_sha256")


def torn_ledger_scan(spark, sf):
    """A ledger file whose last record was being written when the writer stopped: what is committed and what is torn."""
    path = place(spark, "torn")
    c = L.build(ledger.records(spark, sf).where("branch = 1")).select("ledger_offset", "branch", "payload", "prev_record_hash", "record_hash")
    lines = c.select("ledger_offset", F.to_json(F.struct(*c.columns)).alias("value"))
    lines = materialize(lines, "ledger-text")  # dealing out by range reads twice what is chained once
    lines.repartitionByRange(4, "ledger_offset").sortWithinPartitions("ledger_offset").select("value").write.text(path)
    writers.write_bytes(spark, f"{path}/tail", b'{"ledger_offset":')
    records, torn = readers.ledger_file(spark, f"{path}/*")
    bytes_ = torn.agg(F.coalesce(F.sum("torn_bytes"), F.lit(0)).cast("long").alias("torn_bytes"))
    return L.verify(records).crossJoin(F.broadcast(bytes_)).select("branch", "n_records", "n_valid", "torn_bytes")  # one row each


def shard_scan(spark, sf):
    """Shards written by partition and read by predicate: the web lane's documents."""
    path = place(spark, "shards")
    c = packing.chunks(spark, sf).withColumns({"split": F.lit("train"), "shard_id": F.concat_ws("-", *packing.STREAM, "chunk")})
    writers.write_shards(c.select("split", *packing.STREAM, "shard_id", "doc_id", "n_tokens"), path)
    got = readers.shards_where(spark.read.parquet(path), lane="web", pool="main")
    return got.groupBy("shard_id").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").cast("long").alias("n_tokens"))


def shard_store(spark, sf):
    """Shards appended twice to a store that never changes, registered, and opened by the registry's hash."""
    path = place(spark, "store")
    m = materialize(packing.L.shard_ids(packing.chunks(spark, sf), packing.STREAM, "words/1").select("shard_id", "content_hash", "lane"), "manifests")
    first, again = writers.store_once(m, path), writers.store_once(m, path)
    r = writers.registry(spark.read.parquet(path).select("shard_id", F.lit("train").alias("split"), "content_hash", F.lit(1).alias("token_count"), F.lit(1).alias("n_documents")))
    opened = readers.open_registry(r, writers.registry_hash(r), writers.registry_hash)
    return opened.agg(F.count("*").alias("n_shards"), F.sum(F.col("train").cast("long")).alias("n_trainable")).select("n_shards", "n_trainable", F.lit(first["written"]).cast("long").alias("written"), F.lit(again["identical_existing"]).cast("long").alias("found_again"))


def checkpoint_scan(spark, sf):
    """Checkpoints written one after the other; the latest of each branch."""
    path = place(spark, "checkpoints")
    heads = ledger.chain(spark, sf).where("ledger_offset in (50, 150)").select("branch", F.col("ledger_offset").alias("step"), "record_hash").orderBy("step", "branch").collect()  # two a branch
    for h in heads:
        writers.save_checkpoint({"branch": h.branch, "step": h.step, "head_hash": h.record_hash}, path, spark)
    return readers.latest_checkpoint(readers.checkpoint_table(spark, path)).select("branch", "step", "head_hash")


def binary_shard_scan(spark, sf):
    """Token arrays as little-endian files, and their digests after reading."""
    path = place(spark, "binary")
    d = packing.conversation_docs(spark, sf).where("doc_id % 10 = 0").select(F.concat(F.lit("c"), F.col("doc_id")).alias("shard_id"), "tokens", "elig")
    writers.write_binary_shards(d, path)
    got = readers.binary_shards(spark, path).withColumn("arrays", sha256_arrays((F.col("tokens"), "u2"), (F.col("elig"), "u1")))
    same = d.select(F.col("shard_id").alias("s"), sha256_arrays((F.col("tokens"), "u2"), (F.col("elig"), "u1")).alias("was"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return got.join(same, F.col("shard_id") == F.col("s")).select("shard_id", F.size("tokens").cast("long").alias("n_tokens"), total("elig").alias("n_eligible"), (F.col("arrays") == F.col("was")).alias("same"))


def committed_batches(spark, sf):
    """Records committed in batches, one of them twice: the chain is the one that is built at once."""
    path = place(spark, "commit")
    r = materialize(ledger.records(spark, sf).select("branch", F.col("ledger_offset").alias("ord"), "payload", "event_id"), "records")
    for batch, low in ((0, 0), (1, 400), (1, 400), (2, 900)):
        part = r.where((F.col("ord") > low) & (F.col("ord") <= {0: 400, 400: 900}.get(low, 10**12)))
        writers.commit_batch(part.drop("event_id"), {"decisions": part.select("branch", "event_id")}, path, batch)
    return spark.read.parquet(f"{path}/ledger").select("branch", "ledger_offset", "record_hash")


def eval_registry(spark, sf):
    """The evaluation registry: fingerprints by size, and documents by shard."""
    b = table(spark, sf, "benchmark")
    r = writers.eval_registry(A.eval_fingerprints(b), [A.CANARY], b.select((F.concat(F.lit("eval-"), F.col("item_id") % 4)).alias("shard_id"), F.col("item_id").alias("doc_id")))
    rows = [("fingerprints", k, len(v)) for k, v in r["fingerprints"].items()] + [("documents", k, len(v)) for k, v in r["shards"].items()] + [("canaries", "all", len(r["canaries"]))]
    return spark.createDataFrame(rows, "kind string, key string, n long")


def manifest_validation(spark, sf):
    """Every shard's name made again from its documents, in a plain loop, and its numbers held against the manifest."""
    c = materialize(packing.chunks(spark, sf), "chunks")
    m = packing.L.manifest(c, packing.L.shard_ids(c, packing.STREAM, "words/1"), packing.STREAM)
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "offset", "n_tokens", "content")))
    again = c.groupBy(*packing.STREAM, "segment", "chunk").agg(parts.alias("p")).select(*[F.col(k).alias(f"_{k}") for k in (*packing.STREAM, "segment", "chunk")], "p")
    body = F.aggregate("p", F.lit(""), lambda a, x: F.concat(a, F.when(a == "", "").otherwise(","), x["doc_id"], F.lit(":"), x["offset"], F.lit(":"), x["n_tokens"], F.lit(":"), x["content"]))
    j = m.join(again, [F.col(k) == F.col(f"_{k}") for k in (*packing.STREAM, "segment", "chunk")])
    hashed = F.sha2(F.concat(F.lit("words/1|"), "lane", F.lit("|"), "pool", F.lit("|"), "subpool", F.lit("|"), body), 256)
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"])
    return j.select("shard_id", (hashed == F.col("content_hash")).alias("hash_holds"), (tokens == F.col("token_count")).alias("tokens_hold"), (F.size("p") == F.col("n_documents")).alias("documents_hold"))


def contract_reconciliation(spark, sf):
    """What the documents table promises for each language, what the lanes hold, and how a difference is resolved."""
    declared = documents(spark, sf).groupBy("lang").agg(F.count("*").alias("declared"))
    built = packing.lane_docs(spark, sf).where("lane is not null and source <> 'chat'").groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("built"))
    j = declared.join(built, F.col("lang") == F.col("of"), "left").withColumn("built", F.coalesce("built", F.lit(0)))
    return j.select("lang", "declared", "built", (F.col("declared") - F.col("built")).alias("discrepancy"), F.when(F.col("declared") > F.col("built"), "code beyond the long row is in no lane").alias("resolution"))


def policy_documents(spark, sf):
    """Different documents that each lane's rows drew, with their tokens and the rows' use of their positions."""
    r = streams.endless_rows(spark, sf)
    d = r.select("lane", "pass_no", "doc_id").distinct().groupBy("lane").agg(F.count("*").alias("n_documents"))
    u = r.groupBy("lane").agg(F.count_distinct("row_no").alias("n_rows"), F.sum(F.col("end_tok") - F.col("start_tok")).cast("long").alias("n_real"))
    return u.join(d, "lane").select("lane", "n_rows", "n_documents", "n_real", F.round(F.col("n_real") / (F.col("n_rows") * packing.BASE), 6).alias("utilization"))


def duplicate_keys(spark, sf):
    """Normalised texts that more than one document has."""
    return documents(spark, sf).groupBy(A.dedup_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def set_differences(spark, sf):
    """Sources by where they occur: in labelled documents, in others, or in both."""
    d = documents(spark, sf).select("doc_id", "source")
    marked = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("source").distinct()
    every = d.select("source").distinct()
    only = every.exceptAll(marked).select("source", F.lit("unlabelled_only").alias("side"))
    return only.unionByName(marked.exceptAll(every).select("source", F.lit("labelled_only").alias("side"))).unionByName(every.intersect(marked).select("source", F.lit("both").alias("side")))


def document_slices(spark, sf):
    """The second quarter of every conversation, by its shard and id."""
    d = packing.conversation_docs(spark, sf).withColumn("shard_id", F.concat(F.lit("s"), F.col("doc_id") % 4))
    spans = d.select("shard_id", "doc_id", F.floor(F.col("n_tokens") / 4).cast("int").alias("start"), F.floor(F.col("n_tokens") / 2).cast("int").alias("end"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return readers.document_slices(spans, d).select("doc_id", F.size("tokens").cast("long").alias("n"), total("tokens").alias("token_sum"), total("elig").alias("n_eligible"))


def contract_scan(spark, sf):
    """A mixture contract in YAML, row lengths given as text."""
    text = "stages:\n" + "".join(f"  {s.name}: {{span: {s.end - s.start + 1}, seq_len: '{s.window} base; longer rows apart'}}\n" for s in M.default_plan().stages)
    c = readers.contract(text)
    return spark.createDataFrame([(k, v["span"], v["seq_len"]) for k, v in c["stages"].items()], "stage string, span int, seq_len int")


SQL = {
    "document_slices": f"WITH {packing.CONV}, n AS (SELECT doc_id, n_tokens // 4 AS a, n_tokens // 2 AS b FROM docs) SELECT n.doc_id, max(b - a) AS n, coalesce(sum(i) FILTER (WHERE i >= a AND i < b), 0)::BIGINT AS token_sum, count(*) FILTER (WHERE e AND i >= a AND i < b) AS n_eligible FROM n JOIN pos USING (doc_id) GROUP BY n.doc_id",
    "contract_scan": f"WITH {MIX} SELECT stage, hi - lo + 1 AS span, win AS seq_len FROM stages",
    "json_lines_round_trip": "SELECT doc_id, 'web' AS source, lang AS language, sha256(text) AS text_sha256 FROM documents",
    "messages_round_trip": "SELECT conv_id, count(*) AS n_messages, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id",
    "trace_round_trip": f"WITH {learning.TRACE} SELECT step, count(*) AS n_lines, count(*) AS n_read, sha256(string_agg(conv_id || ',' || doc_offset || ',' || token, chr(10) ORDER BY conv_id, doc_offset)) AS trace_sha256 FROM tr GROUP BY step",
    "torn_ledger_scan": "SELECT 1::BIGINT AS branch, count(*) AS n_records, count(*) AS n_valid, 17::BIGINT AS torn_bytes FROM events WHERE user_id % 4 = 1",
    "shard_scan": f"WITH RECURSIVE {packing.CHUNKS} SELECT lane || '-' || pool || '-' || subpool || '-' || chunk AS shard_id, count(*) AS n_documents, sum(n_tokens)::BIGINT AS n_tokens FROM c WHERE lane = 'web' AND pool = 'main' GROUP BY ALL",
    "shard_store": f"WITH RECURSIVE {packing.SHARDS} SELECT count(*) AS n_shards, count(*) AS n_trainable, count(*) AS written, count(*) AS found_again FROM shards",
    "checkpoint_scan": f"WITH RECURSIVE {ledger.CHAIN} SELECT branch, o AS step, h AS head_hash FROM ch WHERE o = 150",
    "binary_shard_scan": f"WITH {packing.CONV} SELECT 'c' || doc_id AS shard_id, count(*) AS n_tokens, count(*) FILTER (WHERE e) AS n_eligible, true AS same FROM pos WHERE doc_id % 10 = 0 GROUP BY doc_id",
    "committed_batches": f"WITH RECURSIVE {ledger.CHAIN} SELECT branch, o AS ledger_offset, h AS record_hash FROM ch",
    "eval_registry": f"WITH {FP} SELECT 'fingerprints' AS kind, k::VARCHAR AS key, count(*) AS n FROM fp GROUP BY k UNION ALL SELECT 'documents', 'eval-' || item_id % 4, count(*) FROM benchmark GROUP BY ALL UNION ALL SELECT 'canaries', 'all', 1",
    "manifest_validation": f"WITH RECURSIVE {packing.SHARDS} SELECT shard_id, true AS hash_holds, true AS tokens_hold, true AS documents_hold FROM shards",
    "contract_reconciliation": f"""WITH {packing.LANED}, b AS (SELECT lang, count(*) AS declared, count(lane) AS built FROM laned WHERE source <> 'chat' GROUP BY lang)
        SELECT lang, declared, built, declared - built AS discrepancy, CASE WHEN declared > built THEN 'code beyond the long row is in no lane' END AS resolution FROM b""",
    "policy_documents": f"WITH {streams.ENDLESS} SELECT lane, count(DISTINCT row_no) AS n_rows, count(DISTINCT (pass_no, doc_id)) AS n_documents, sum(end_tok - start_tok)::BIGINT AS n_real, round(sum(end_tok - start_tok) / (count(DISTINCT row_no) * 512), 6) AS utilization FROM endless GROUP BY lane",
    "duplicate_keys": r"SELECT sha256(any_value(regexp_replace(nfc_normalize(text), '[ \t\n\v\f\r]+', ' ', 'g'))) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY regexp_replace(nfc_normalize(text), '[ \t\n\v\f\r]+', ' ', 'g') HAVING count(*) > 1",
    "set_differences": "WITH s AS (SELECT source, max((doc_id IN (SELECT doc_id FROM labels))::INT) AS m FROM documents GROUP BY source) SELECT source, CASE WHEN m = 1 THEN 'both' ELSE 'unlabelled_only' END AS side FROM s",
}
QUERIES = {f.__name__: f for f in (json_lines_round_trip, messages_round_trip, trace_round_trip, torn_ledger_scan, shard_scan, shard_store, checkpoint_scan, binary_shard_scan, committed_batches, eval_registry, manifest_validation, contract_reconciliation, policy_documents, duplicate_keys, set_differences, document_slices, contract_scan)}
