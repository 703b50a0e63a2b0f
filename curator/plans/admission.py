"""Queries on admission: redaction, scripts, duplicates, contamination, gates, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.functions import text as T
from curator.operators import admission as A
from curator.plans.tables import documents, table, values

LICENSES = [f"src{i}" for i in range(20) if i != 13]
TOKENIZER = "words/1"
SHARDS = [
    ("s1", "words/1", ["clean/1"], ["mit"], "train", "clean", "none"),
    ("s2", None, ["clean/1"], ["mit"], "train", "clean", "none"),
    ("s3", "words/2", [], ["mit", "gpl", "bsd"], "train", "clean", "none"),
    ("s4", "words/1", ["clean/9"], [], "test", "contaminated", "exact"),
    ("s5", "words/1", ["clean/1"], ["cc0-1.0"], "validation", "clean", "none"),
]
SHARD_SCHEMA = "shard_id string, tokenizer_id string, cleaning_lineage array<string>, licenses array<string>, split string, contamination_status string, eval_overlap_status string"


def admission_decisions(spark, sf):
    return A.admit(documents(spark, sf), table(spark, sf, "benchmark"), keep_text=False).drop("reasons")


def admission_summary(spark, sf):
    d = admission_decisions(spark, sf)
    return d.groupBy("decision", F.coalesce("first_reason", F.lit("none")).alias("first_reason")).agg(F.count("*").alias("n"))


def admission_all_gates(spark, sf):
    """Admission with the licence list and the tokenizer's coverage switched on: all reasons against each document."""
    unk = A.unk_rates(worded(documents(spark, sf)), A.vocabulary(worded(documents(spark, sf)), 10_000))
    out = A.admit(documents(spark, sf), table(spark, sf, "benchmark"), LICENSES, "source", unk, keep_text=False)
    return out.select("doc_id", "decision", F.array_join("reasons", ";").alias("reasons"), "dup_of")


def coverage_rejections(spark, sf):
    """Languages and scripts of the documents that the tokenizer covers too badly."""
    d = documents(spark, sf)
    unk = A.unk_rates(worded(d), A.vocabulary(worded(d), 10_000)).where(F.col("unk_rate") > A.MAX_UNK_RATE).select(F.col("doc_id").alias("of"))
    return d.select("doc_id", "lang", T.script_of(F.col("text")).alias("script")).join(unk, F.col("doc_id") == F.col("of"), "left_semi").groupBy("lang", "script").agg(F.count("*").alias("n"))


def license_gate(spark, sf):
    d = documents(spark, sf).select("doc_id", "source")
    return d.where(~F.col("source").isin(LICENSES)).select("doc_id", F.concat(F.lit("license_not_allowed:"), F.col("source")).alias("reason"))


def redact_pii(spark, sf):
    text, emails, phones = T.redact(F.col("text"))
    d = documents(spark, sf).select("doc_id", text.alias("redacted"), emails.cast("long").alias("n_email"), phones.cast("long").alias("n_phone"))
    return d.where("n_email + n_phone > 0").select("doc_id", "n_email", "n_phone", F.sha2("redacted", 256).alias("redacted_sha256"))


def script_profile(spark, sf):
    return documents(spark, sf).groupBy(T.script_of(F.col("text")).alias("script"), "lang").agg(F.count("*").alias("n"))


def normalized_key(spark, sf):
    return documents(spark, sf).select("doc_id", A.dedup_key(F.col("text")).alias("key"))


def exact_dedup_first_wins(spark, sf):
    d = documents(spark, sf).select("doc_id", A.dedup_key(F.col("text")).alias("key"))
    return A.first_wins(d).where("dup_of is not null").select("doc_id", "dup_of")


def eval_fingerprints(spark, sf):
    return A.eval_fingerprints(table(spark, sf, "benchmark")).select("k", "h")


def worded(docs):
    return docs.select("doc_id", T.words(F.col("text")).alias("w"))


def contamination_hits(spark, sf):
    return A.contamination_hits(documents(spark, sf).select("doc_id", "text"), A.eval_fingerprints(table(spark, sf, "benchmark")), worded)


def unk_rate_vocab(spark, sf):
    d = documents(spark, sf).select("doc_id", T.words(F.col("text")).alias("w"))
    return A.unk_rates(d, A.vocabulary(d, 10_000))


def shard_admission_gate(spark, sf):
    s = values(spark, SHARDS, SHARD_SCHEMA)
    out = A.shard_gate(s, TOKENIZER, ["clean/1", "clean/2"], ["mit", "cc0-1.0"])
    return out.select("shard_id", F.array_join("violations", ";").alias("violations"), (F.size("violations") == 0).alias("admitted"))


def eval_permission_gate(spark, sf):
    registry = values(spark, [("web-0", "train", True), ("web-1", "train", False), ("test-0", "test", False), ("proxy-0", "proxy", False)], "shard_id string, split string, train boolean")
    used = documents(spark, sf).select(F.when(F.col("source") == "src0", "test-0").when(F.col("source") == "src1", "unknown").when(F.col("lang") != "en", "web-1").otherwise("web-0").alias("shard_id"))
    return A.registry_gate(used, registry)


def render_conversations(spark, sf):
    r = A.render(table(spark, sf, "conversations"))
    return r.select("conv_id", "turn", "role", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "eligible")


def context_only_fraction(spark, sf):
    r = A.render(table(spark, sf, "conversations")).withColumn("n", F.col("end") - F.col("start"))
    # the end marker counts for loss even after a turn that does not
    loss = F.when(F.col("eligible"), F.col("n")).otherwise(F.col("is_last").cast("long"))
    return r.groupBy("conv_id").agg(F.sum("n").alias("n_tokens"), F.sum(loss).alias("n_loss")).withColumn("context_only", F.round(1 - F.col("n_loss") / F.col("n_tokens"), 6))


def documents_by_source_and_lang(spark, sf):
    """The scan with column pruning and a grouped count."""
    d = documents(spark, sf).select("source", "lang", "n_chars").where("n_chars >= 100")
    return d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def first_per_source(spark, sf):
    """First documents of each source in a stable hash order: a quota by key."""
    d = documents(spark, sf).select("doc_id", "source", F.substring(F.sha2(F.concat_ws("|", F.lit("1234"), F.lit("take"), F.col("doc_id").cast("string")), 256), 1, 16).alias("h"))
    w = Window.partitionBy("source").orderBy("h", "doc_id")
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("source", "doc_id", "rank")


W = r"regexp_extract_all(lower(nfc_normalize({0})), '[\p{{L}}\p{{M}}\p{{N}}]+')"
RED1 = r"regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g')"
# RE2 has no look-around: the borders are matched and put back
PHONE_SQL = r"(^|[^0-9])(?:\+?[0-9]{1,3}[ -]?)?[0-9]{5}[ -]?[0-9]{5}([^0-9]|$)"
REDACTED = f"""
red1 AS (SELECT doc_id, source, text, {RED1} AS r1,
           len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS n_email FROM documents),
red AS (SELECT doc_id, source, n_email, len(regexp_extract_all(r1, '{PHONE_SQL}')) AS n_phone,
           regexp_replace(r1, '{PHONE_SQL}', '\\1<PHONE>\\2', 'g') AS redacted FROM red1)
"""
FP = f"""
items AS (SELECT item_id, {W.format('text')} AS w FROM benchmark),
item_grams AS (SELECT w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
fp AS (SELECT DISTINCT k, substr(sha256(array_to_string(w[i : i + k - 1], ' ')), 1, 16) AS h FROM item_grams)
"""
HITS = """
ks AS (SELECT DISTINCT k FROM fp),
doc_grams AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
hits AS (SELECT doc_id, count(DISTINCT (g.k, g.h)) AS hits
         FROM (SELECT doc_id, k, substr(sha256(array_to_string(w[i : i + k - 1], ' ')), 1, 16) AS h FROM doc_grams) g
         JOIN fp ON g.k = fp.k AND g.h = fp.h GROUP BY doc_id)
"""
ADMIT = f"""
WITH {REDACTED}, {FP},
dw AS (SELECT doc_id, {W.format('redacted')} AS w FROM red), {HITS},
j AS (SELECT r.doc_id, n_email + n_phone AS pii, len(dw.w) AS n_words, coalesce(hits, 0) AS hits,
             sha256(regexp_replace(nfc_normalize(redacted), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS key
      FROM red r JOIN dw USING (doc_id) LEFT JOIN hits USING (doc_id)),
f AS (SELECT *, min(doc_id) FILTER (WHERE hits = 0) OVER (PARTITION BY key) AS first_id FROM j),
a AS (SELECT doc_id, pii::BIGINT AS pii_redactions, n_words::BIGINT AS n_words, CASE WHEN doc_id > first_id THEN first_id END AS dup_of, hits::BIGINT AS contamination_hits
      FROM f)
SELECT *, CASE WHEN dup_of IS NULL AND contamination_hits = 0 THEN 'admitted' ELSE 'dropped' END AS decision,
       CASE WHEN dup_of IS NOT NULL THEN 'exact_duplicate' WHEN contamination_hits > 0 THEN 'benchmark_contamination' END AS first_reason
FROM a
"""
UNK = f"""
uw AS (SELECT doc_id, {W.format('text')} AS w FROM documents), ue AS (SELECT doc_id, unnest(w) AS word FROM uw),
uv AS (SELECT word FROM ue GROUP BY word ORDER BY count(*) DESC, word LIMIT 10000),
unk AS (SELECT doc_id, round(count(*) FILTER (WHERE uv.word IS NULL) / count(*), 6) > 0.01 AS bad FROM ue LEFT JOIN uv ON ue.word = uv.word GROUP BY doc_id)
"""
SCRIPT = "CASE WHEN m = 0 THEN 'Zyyy' " + " ".join(f"WHEN c{i} = m THEN '{n}'" for i, n in enumerate(T.SCRIPTS)) + " END"
COUNTED = "c AS (SELECT doc_id, lang, " + ", ".join(f"len(regexp_extract_all(text, '[{chars}]')) AS c{i}" for i, chars in enumerate(T.SCRIPTS.values())) + " FROM documents), b AS (SELECT *, greatest(" + ", ".join(f"c{i}" for i in range(len(T.SCRIPTS))) + ") AS m FROM c)"
SQL = {
    "admission_all_gates": f"""WITH {REDACTED}, {FP}, dw AS (SELECT doc_id, {W.format('redacted')} AS w FROM red), {HITS}, {UNK},
        j AS (SELECT r.doc_id, CASE WHEN source = 'src13' THEN 'license_not_allowed:src13' END AS a, CASE WHEN unk.bad THEN 'tokenizer_coverage' END AS b, CASE WHEN hits > 0 THEN 'benchmark_contamination' END AS c,
                     sha256(regexp_replace(nfc_normalize(redacted), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS key FROM red r LEFT JOIN hits USING (doc_id) LEFT JOIN unk USING (doc_id)),
        f AS (SELECT *, min(doc_id) FILTER (WHERE coalesce(a, b, c) IS NULL) OVER (PARTITION BY key) AS first_id FROM j),
        g AS (SELECT doc_id, array_to_string(list_filter([a, b, CASE WHEN doc_id > first_id THEN 'exact_duplicate' END, c], lambda x: x IS NOT NULL), ';') AS reasons, CASE WHEN doc_id > first_id THEN first_id END AS dup_of FROM f)
        SELECT doc_id, CASE WHEN reasons = '' THEN 'admitted' ELSE 'dropped' END AS decision, reasons, dup_of FROM g""",
    "coverage_rejections": f"WITH {UNK}, {COUNTED} SELECT lang, {SCRIPT} AS script, count(*) AS n FROM b JOIN unk USING (doc_id) WHERE bad GROUP BY ALL",
    "admission_decisions": ADMIT,
    "admission_summary": f"SELECT decision, coalesce(first_reason, 'none') AS first_reason, count(*) AS n FROM ({ADMIT}) GROUP BY ALL",
    "license_gate": "SELECT doc_id, 'license_not_allowed:' || source AS reason FROM documents WHERE source = 'src13'",
    "redact_pii": f"WITH {REDACTED} SELECT doc_id, n_email::BIGINT AS n_email, n_phone::BIGINT AS n_phone, sha256(redacted) AS redacted_sha256 FROM red WHERE n_email + n_phone > 0",
    "script_profile": f"WITH {COUNTED} SELECT {SCRIPT} AS script, lang, count(*) AS n FROM b GROUP BY ALL",
    "normalized_key": r"SELECT doc_id, sha256(regexp_replace(nfc_normalize(text), '[ \t\n\v\f\r]+', ' ', 'g')) AS key FROM documents",
    "exact_dedup_first_wins": r"WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(nfc_normalize(text), '[ \t\n\v\f\r]+', ' ', 'g')) AS dup_of FROM documents) SELECT doc_id, dup_of FROM k WHERE doc_id > dup_of",
    "eval_fingerprints": f"WITH {FP} SELECT k::INTEGER AS k, h FROM fp",
    "contamination_hits": f"WITH {FP}, dw AS (SELECT doc_id, {W.format('text')} AS w FROM documents), {HITS} SELECT doc_id, hits FROM hits",
    "unk_rate_vocab": f"""WITH dw AS (SELECT doc_id, {W.format('text')} AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS word FROM dw),
        v AS (SELECT word FROM e GROUP BY word ORDER BY count(*) DESC, word LIMIT 10000),
        c AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE v.word IS NULL) AS n_unk FROM e LEFT JOIN v ON e.word = v.word GROUP BY doc_id)
        SELECT dw.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_unk, 0) AS n_unk, round(coalesce(n_unk, 0) / greatest(1, coalesce(n_words, 0)), 6) AS unk_rate FROM dw LEFT JOIN c USING (doc_id)""",
    "shard_admission_gate": """SELECT * FROM (VALUES ('s1', '', true), ('s2', 'missing_tokenizer_hash', false), ('s3', 'tokenizer_hash_mismatch;unknown_cleaning_lineage;unsafe_license:bsd,gpl', false),
        ('s4', 'unknown_cleaning_lineage;split_not_trainable:test;contamination_status:contaminated;eval_overlap:exact', false), ('s5', 'split_not_trainable:validation', false)) t(shard_id, violations, admitted)""",
    "eval_permission_gate": """WITH u AS (SELECT DISTINCT CASE WHEN source = 'src0' THEN 'test-0' WHEN source = 'src1' THEN 'unknown' WHEN lang <> 'en' THEN 'web-1' ELSE 'web-0' END AS shard_id FROM documents)
        SELECT shard_id, CASE shard_id WHEN 'unknown' THEN 'unregistered' WHEN 'test-0' THEN 'registered_test_only' ELSE 'no_train_permission' END AS violation FROM u WHERE shard_id <> 'web-0'""",
    "render_conversations": f"""WITH c AS (SELECT conv_id, turn, role, len({W.format("coalesce(text, '')")}) + 1 AS n FROM conversations),
        s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last FROM c)
        SELECT conv_id, turn, role, (e - n)::BIGINT AS start_pos, (e + last::INT)::BIGINT AS end_pos, role IN ('assistant', 'tool_call') AS eligible FROM s""",
    "context_only_fraction": f"""WITH c AS (SELECT conv_id, turn, role, len({W.format("coalesce(text, '')")}) + 1 AS n FROM conversations),
        s AS (SELECT conv_id, (sum(n) + 1)::BIGINT AS n_tokens, (sum(CASE WHEN role IN ('assistant', 'tool_call') THEN n ELSE 0 END) + 1)::BIGINT AS n_loss FROM c GROUP BY conv_id)
        SELECT conv_id, n_tokens, n_loss, round(1 - n_loss / n_tokens, 6) AS context_only FROM s""",
    "documents_by_source_and_lang": "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE n_chars >= 100 GROUP BY ALL",
    "first_per_source": "WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY substr(sha256('1234|take|' || doc_id), 1, 16), doc_id)::INTEGER AS rank FROM documents) SELECT * FROM d WHERE rank <= 3",
}
QUERIES = {f.__name__: f for f in (admission_decisions, admission_all_gates, coverage_rejections, admission_summary, license_gate, redact_pii, script_profile, normalized_key, exact_dedup_first_wins, eval_fingerprints, contamination_hits, unk_rate_vocab, shard_admission_gate, eval_permission_gate, render_conversations, context_only_fraction, documents_by_source_and_lang, first_per_source)}
