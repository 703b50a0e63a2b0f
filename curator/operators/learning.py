"""Learning traces: losses of tokens, the spans they sum to, and what they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator.functions.hashing import sha


def span_id(doc: Column, start: Column, end: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit("["), start.cast("string"), F.lit(":"), end.cast("string"), F.lit(")"))


def sample_id(doc: Column, start: Column, end: Column, epoch: Column) -> Column:
    """Name of a trained span: it follows from what was trained on, not from when."""
    return F.concat(F.lit("smp-"), F.substring(sha(doc, start, end, epoch), 1, 16))


def candidate_id(doc: Column, start: Column, end: Column, epoch: Column) -> Column:
    return F.concat(F.lit("cand-"), F.substring(sha(doc, start, end, epoch), 1, 16))


def decision_id(branch: str, step: Column, number: Column) -> Column:
    return F.format_string(f"sel-{branch}-s%05d-%03d", step.cast("int"), number.cast("int"))


def checkpoint_id(branch: Column, step: Column) -> Column:
    return F.format_string("%s@s%05d", branch.cast("string"), step.cast("int"))


def build_trace(tokens: DataFrame, losses: DataFrame, keys: list[str]) -> DataFrame:
    """The loss-bearing ``tokens`` (keys, doc_offset, token, …) with their ``losses`` (keys, doc_offset, loss) and perplexity."""
    on = [*keys, "doc_offset"]
    return tokens.join(losses, on).withColumn("ppl", F.exp("loss"))


def trace_hash(trace: DataFrame, step: str, line: Column, order: list[str]) -> DataFrame:
    """(step, n_lines, trace_sha256) of a step's lines in order; a step is one batch."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    g = trace.groupBy(step).agg(F.count("*").alias("n_lines"), lines.alias("lines"))
    return g.select(step, "n_lines", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("trace_sha256"))


def not_in_shards(trace: DataFrame, shards: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of ``trace`` (keys, doc_offset, token) whose token is not the one that ``shards`` (keys, tokens) has at that offset."""
    j = trace.join(shards.select(*keys, "tokens"), keys, "left")
    at = F.try_element_at("tokens", (F.col("doc_offset") + 1).cast("int"))
    return j.where(~F.coalesce(at.eqNullSafe(F.col("token")), F.lit(False))).drop("tokens")


def samples(trace: DataFrame, by: list[str]) -> DataFrame:
    """Sums of a trace by span."""
    return trace.groupBy(*by).agg(F.count("*").alias("n_loss"), F.sum("loss").alias("loss_sum"))


def mean_loss(sums: DataFrame, *by: Column) -> DataFrame:
    """Mean loss a token of samples (n_loss, loss_sum) by any keys."""
    return sums.groupBy(*by).agg(F.sum("n_loss").cast("long").alias("n_loss"), F.round(F.sum("loss_sum") / F.greatest(F.lit(1), F.sum("n_loss")), 6).alias("mean_loss"))


def scoring_models(decisions: DataFrame, batches: DataFrame) -> DataFrame:
    """``decisions`` (step) with the hash of the batch after which their scoring model stood: the one of the step before; null for the first."""
    b = batches.select((F.col("step") + 1).alias("_step"), F.col("batch_hash").alias("scoring_model"))
    return decisions.join(b, F.col("step") == F.col("_step"), "left").drop("_step")
