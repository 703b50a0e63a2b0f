"""Gates that keep evaluation data, unlicensed sources and stale candidates out, each returning what it stops and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.functions import text as T
from curator.functions.hashing import order_key
from curator.operators.admission import CANARY, contamination_hits
from curator.operators.sized import small

#: Characters of a host document in a contamination drill.
HOST_CHARS = 400


def pii_status(documents: DataFrame, exempt: Column) -> DataFrame:
    """``documents`` with redacted text and pii_status; sources under ``exempt`` are public code and stay as they are."""
    redacted, emails, phones = T.redact(F.col("text"))
    spared = F.coalesce(exempt, F.lit(False))
    status = F.when(spared, "exempt_public_source_code").when(emails + phones > 0, "redacted").otherwise("clean")
    return documents.withColumns({"pii_status": status, "redacted": F.when(spared, F.col("text")).otherwise(redacted)})


def top_by_hash(df: DataFrame, k: int, *parts: Column) -> DataFrame:
    """The ``k`` rows with the least stable hashes: the same ones on any machine and in any order of the input."""
    return df.withColumn("order_key", order_key(*parts)).orderBy("order_key", *[c for c in df.columns if c.endswith("_id")]).limit(k)


def drills(documents: DataFrame, benchmark: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` documents that an admission must refuse: the beginning of a document, a line feed and a benchmark item."""
    rank = lambda d, c: d.withColumn("drill", F.row_number().over(Window.orderBy("order_key", c)))  # noqa: E731  n rows
    hosts = rank(top_by_hash(documents.select("doc_id", "text"), n, F.lit(seed), F.lit("host"), F.col("doc_id")), "doc_id").select("drill", "doc_id", F.substring("text", 1, HOST_CHARS).alias("host"))
    items = rank(top_by_hash(benchmark.select("item_id", "text"), n, F.lit(seed), F.lit("item"), F.col("item_id")), "item_id").select("drill", "item_id", F.col("text").alias("item"))
    return hosts.join(items, "drill").select("drill", "doc_id", "item_id", F.concat_ws("\n", "host", "item").alias("text"))


def spans_of_words(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, span_no, w): the words of ``docs`` (doc_id, w) in spans of ``length``."""
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / length).cast("int") - 1, F.lit(0)))
    each = docs.select("doc_id", "w", F.explode(numbers).alias("span_no"))
    return each.select("doc_id", "span_no", F.slice("w", F.col("span_no") * length + 1, length).alias("w")).where(F.size("w") > 0)


def content_violations(spans: DataFrame, fingerprints: DataFrame, canary: str = CANARY) -> DataFrame:
    """(doc_id, span_no, reason, hits) of spans with a benchmark's n-gram or the canary. An n-gram that a span's border cuts is in neither span."""
    keyed = spans.select(F.struct("doc_id", "span_no").alias("doc_id"), "w")
    hits = contamination_hits(keyed, fingerprints).select("doc_id.doc_id", "doc_id.span_no", F.lit("benchmark_contamination").alias("reason"), "hits")
    mark = F.array_join(F.regexp_extract_all(F.lower(F.lit(canary)), F.lit(T.WORD), 0), " ")
    canaries = spans.where(F.contains(F.array_join("w", " "), mark)).select("doc_id", "span_no", F.lit("eval_canary").alias("reason"), F.lit(1).cast("long").alias("hits"))
    return hits.unionByName(canaries)


def remove_sources(sources: DataFrame, violations: DataFrame) -> DataFrame:
    """``sources`` (source, …) with action and reason: a source with any violation (source, reason) is removed from the plan, which is an event."""
    first = violations.groupBy("source").agg(F.min("reason").alias("reason"), F.count("*").alias("n_violations")).withColumnRenamed("source", "of")
    j = sources.join(small(first), F.col("source") == F.col("of"), "left").drop("of")
    return j.withColumns({"action": F.when(F.col("reason").isNull(), "kept").otherwise("removed"), "n_violations": F.coalesce("n_violations", F.lit(0)).cast("long")})


def gate_candidates(candidates: DataFrame, violations: DataFrame, key: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(candidates without violation, decisions against the others): those are rejected before anything is scored or ranked."""
    bad = violations.select(F.col(key).alias("_bad")).distinct()
    clean = candidates.join(bad, F.col(key) == F.col("_bad"), "left_anti")
    stopped = candidates.join(bad, F.col(key) == F.col("_bad"), "left_semi").withColumns({"status": F.lit("rejected"), "reason": F.lit("eval_firewall")})
    return clean, stopped


def stage_mismatches(queue: DataFrame, schedule: DataFrame) -> DataFrame:
    """``queue`` (idx, lane, step, pool, row_len; step is where it comes back) with status: rejected if that step plans another pool or row length for the lane."""
    s = schedule.select(F.col("lane").alias("_lane"), F.col("step").alias("_step"), F.col("pool").alias("_pool"), F.col("row_len").alias("_len"))
    j = queue.join(F.broadcast(s), (F.col("lane") == F.col("_lane")) & (F.col("step") == F.col("_step")), "left")  # a row for each lane and step
    same = F.coalesce((F.col("pool") == F.col("_pool")) & (F.col("row_len") == F.col("_len")), F.lit(False))
    return j.select(*queue.columns, F.when(same, "taken").otherwise("rejected").alias("status"), F.when(~same, "stage_mismatch").alias("reason"))


def eval_reads(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """The access log of ``requests`` (…, shard_id, purpose, grad_enabled): allowed, or why not. Only the split's own purpose may read, and never with gradients on."""
    r = small(registry.select(F.col("shard_id").alias("_id"), "split"))
    j = requests.join(r, F.col("shard_id") == F.col("_id"), "left")
    refused = F.when(F.col("_id").isNull(), "unregistered").when(F.col("split").isin("train", "test"), F.concat(F.lit("split_not_readable:"), F.col("split"))).when(F.col("split") != F.col("purpose"), "purpose_not_permitted").when(F.col("grad_enabled"), "gradients_enabled")
    return j.select(*requests.columns, refused.isNull().alias("allowed"), refused.alias("refused"))
