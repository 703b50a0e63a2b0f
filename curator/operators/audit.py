"""Questions asked of a ledger, its decisions and its learning traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def influence(spans: DataFrame, within: Column) -> DataFrame:
    """(shard, tokens, loss_tokens, docs) of the spans (shard, doc_id, n_tokens, n_loss) that satisfy ``within``."""
    return spans.where(within).groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_loss").alias("loss_tokens"), F.count_distinct("doc_id").alias("docs"))


def behind_checkpoints(spans: DataFrame, checkpoints: DataFrame, branch: str, step: str) -> DataFrame:
    """(branch, checkpoint, tokens, loss_tokens, docs) of everything up to each checkpoint.

    Spans are summed by step and documents counted at their first step; checkpoints lie between the steps of one running sum, so no span meets more than one of them.
    """
    sums = spans.groupBy(branch, step).agg(F.sum("n_tokens").alias("t"), F.sum("n_loss").alias("l"))
    first = spans.where("doc_id is not null").groupBy(branch, "doc_id").agg(F.min(step).alias(step)).groupBy(branch, step).agg(F.count("*").alias("d"))
    c = checkpoints.select(branch, F.col("checkpoint").alias(step), F.lit(True).alias("c"))
    rows = sums.unionByName(first, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).where(F.col(branch).isNotNull())
    w = Window.partitionBy(branch).orderBy(step)  # a step's rows are peers, all of which count
    total = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0)).cast("long")
    return rows.select(branch, F.col(step).alias("checkpoint"), total("t").alias("tokens"), total("l").alias("loss_tokens"), total("d").alias("docs"), "c").where("c").drop("c")


def following_checkpoint(steps: DataFrame, checkpoints: DataFrame, branch: str, step: str) -> DataFrame:
    """``steps`` with the first checkpoint at or after each, null if none follows: the last one met from the end on."""
    c = checkpoints.select(branch, F.col("checkpoint").alias(step), F.col("checkpoint").alias("_next"))
    rows = steps.withColumn("_is_step", F.lit(True)).unionByName(c, allowMissingColumns=True)
    near = F.min("_next").over(Window.partitionBy(branch).orderBy(F.desc(step)))  # checkpoints of the same step are peers
    return rows.withColumn("checkpoint", F.when(F.col(branch).isNotNull(), near)).where("_is_step").drop("_next", "_is_step")


def token_window(steps: DataFrame, branch: str, step: str, n: str, low: Column, high: Column) -> DataFrame:
    """Steps of each branch whose tokens touch [low, high) of the branch's running count. A step is one row here."""
    w = Window.partitionBy(branch).orderBy(step)
    s = steps.withColumn("_end", F.sum(n).over(w))
    return s.where((F.col("_end") > low) & (F.col("_end") - F.col(n) < high)).drop("_end")


def largest_jump(steps: DataFrame, branch: str, step: str, loss: str) -> DataFrame:
    """(branch, step, jump): where the loss rose most over the step before; of equals the earliest."""
    w = Window.partitionBy(branch).orderBy(step)
    s = steps.withColumn("jump", F.col(loss) - F.lag(loss).over(w)).where("jump is not null")
    best = F.max(F.struct("jump", (-F.col(step)).alias("s"))).alias("best")
    return s.groupBy(branch).agg(best).select(branch, (-F.col("best.s")).alias(step), F.col("best.jump").alias("jump"))


def before_jump(jumps: DataFrame, decisions: DataFrame, branch: str, step: str, back: int = 2) -> DataFrame:
    """Accepted decisions in the steps up to each jump. Keys are spread to the few steps, so the range is an equi-join."""
    j = jumps.select(branch, F.col(step).alias("spike"), F.explode(F.sequence(F.col(step) - back, F.col(step))).alias(step))
    return decisions.where("status = 'accepted'").join(j, [branch, step])


def review(decisions: DataFrame) -> DataFrame:
    """(lane, considered, trained, never_trained, deferred_then_accepted) by candidate."""
    seen = lambda s: F.max(F.when(F.col("status") == s, 1).otherwise(0))
    c = decisions.groupBy("lane", "idx").agg(seen("accepted").alias("a"), seen("deferred").alias("d"))
    return c.groupBy("lane").agg(F.count("*").alias("considered"), F.sum("a").alias("trained"), F.sum(1 - F.col("a")).alias("never_trained"), F.sum(F.col("a") * F.col("d")).alias("deferred_then_accepted"))


def overrides(rows: DataFrame) -> DataFrame:
    """(overridden, n_rows, mean_loss): mean loss a token of rows (reason, loss_sum, n_loss) that a floor rescued and of the rest."""
    g = rows.groupBy((F.col("reason") == "protected_floor_override").alias("overridden"))
    return g.agg(F.count("*").alias("n_rows"), F.round(F.sum("loss_sum") / F.greatest(F.lit(1), F.sum("n_loss")), 6).alias("mean_loss"))


def learning_class(delta: Column, n: Column) -> Column:
    return F.when(n == 0, "no_signal").when(delta < -0.05, "useful").when(delta > 0.05, "harmful").otherwise("neutral")


def report_card(samples: DataFrame) -> DataFrame:
    """One row a shard from samples (shard, n_loss, loss, loss_after, pass): sums, means by pass, counts of learning classes."""
    mean = lambda x: x / F.greatest(F.lit(1), F.sum("n_loss"))
    s = samples.withColumn("class", learning_class((F.col("loss_after") - F.col("loss")) / F.greatest(F.lit(1), F.col("n_loss")), F.col("n_loss")))
    count = lambda c: F.count(F.when(F.col("class") == c, 1)).alias(c)
    first = F.col("pass") == 0
    return s.groupBy("shard").agg(
        F.sum("n_loss").alias("n_loss"),
        F.round(mean(F.sum("loss")), 6).alias("mean_loss"),
        F.round(mean(F.sum("loss_after")), 6).alias("mean_loss_after"),
        F.round(F.sum(F.when(first, F.col("loss"))) / F.greatest(F.lit(1), F.sum(F.when(first, F.col("n_loss")))), 6).alias("first_pass_loss"),
        *map(count, ("useful", "harmful", "neutral", "no_signal")),
    )


def performance(steps: DataFrame, by: str) -> DataFrame:
    """Throughput and shares of each branch by the published formulas."""
    ratio = lambda a, b: F.round(a / b, 6)
    s = {c: F.sum(c) for c in ("token_positions", "real_tokens", "loss_tokens", "accepted_rows", "candidates_scored", "t_plan_s", "t_total_s")}
    return steps.groupBy(by).agg(
        F.count("*").alias("steps"),
        ratio(s["real_tokens"], s["token_positions"]).alias("packing_utilization"),
        ratio(s["loss_tokens"], s["token_positions"]).alias("loss_bearing_fraction"),
        F.round(1 - s["real_tokens"] / s["token_positions"], 6).alias("padding_fraction"),
        ratio(s["real_tokens"] - s["loss_tokens"], s["token_positions"]).alias("context_only_fraction"),
        ratio(s["token_positions"], s["t_total_s"]).alias("raw_token_positions_per_s"),
        ratio(s["loss_tokens"], s["t_total_s"]).alias("useful_tokens_per_s"),
        ratio(s["t_plan_s"], s["t_total_s"]).alias("loader_time_fraction"),
        ratio(s["accepted_rows"], s["candidates_scored"]).alias("acceptance_rate"),
    )


def lost_work(steps: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Steps of crashed attempts that no live attempt replaces under the same keys."""
    return steps.join(live.select(*keys), keys, "left_anti")


def latency(times: DataFrame, value: str) -> DataFrame:
    """(n, mean, p50, max); p50 is the upper median, the element n div 2 of the sorted values."""
    w = Window.orderBy(value)
    total = times.agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"))
    counts = times.groupBy(value).count().withColumn("upto", F.sum("count").over(w))  # distinct values only
    half = counts.crossJoin(F.broadcast(total.select(F.col("n").alias("_n")))).where(F.col("upto") > F.floor(F.col("_n") / 2)).agg(F.min(value).alias("p50"))
    return total.crossJoin(half).select("n", "mean", "p50", "max")


def top_tokens(tokens: DataFrame, keys: list[str], loss: str, position: str, k: int = 3) -> DataFrame:
    """The k tokens of most loss of each span, earlier positions first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(loss), position)
    return tokens.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows of either multiset that the other lacks; empty if they are equal."""
    x = a.exceptAll(b).select(F.lit("first").alias("side"))
    return x.unionByName(b.exceptAll(a).select(F.lit("second").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))
