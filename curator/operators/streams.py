"""Lane streams without an end: documents in hash order, pass after pass, cut into rows that are always full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.functions.hashing import order_key, sha
from curator.operators.sized import running_sum


def passes(docs: DataFrame, seed: int, n: int, digits: int = 3) -> DataFrame:
    """``docs`` (lane, doc_id, n_tokens) in each of ``n`` passes, with the order of the pass and buckets along it."""
    p = docs.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    p = p.withColumn("h", order_key(F.lit(seed), F.col("lane"), F.col("pass"), F.col("doc_id")))
    return p.withColumn("bucket", F.concat_ws("-", F.lpad(F.col("pass").cast("string"), 6, "0"), F.substring("h", 1, digits)))


def endless_rows(docs: DataFrame, seed: int, length: int, rows: DataFrame) -> DataFrame:
    """Spans (lane, row, pass, doc_id, start, end, pos) of the first rows of each lane: ``rows`` (lane, n_rows) says how many.

    A row that begins in one pass may end in the next. The passes needed are as many as the lane's tokens go into what is asked for.
    """
    totals = docs.groupBy("lane").agg(F.sum("n_tokens").alias("total"))
    asked = totals.join(rows, "lane").select("lane", (F.col("n_rows") * length).alias("wanted"), F.ceil(F.col("n_rows") * length / F.col("total")).cast("int").alias("n_passes")).where("n_passes > 0")
    most = asked.agg(F.max("n_passes")).first()[0] or 1
    p = passes(docs, seed, most).join(F.broadcast(asked), "lane").where(F.col("pass") < F.col("n_passes"))  # a row for each lane
    d = running_sum(p, ["lane"], [F.col("pass"), F.col("h"), F.col("doc_id")], F.col("n_tokens"), F.col("bucket"), "at").where("n_tokens > 0 and at < wanted")
    end = F.least(F.col("at") + F.col("n_tokens"), F.col("wanted"))
    d = d.withColumn("row", F.explode(F.sequence(F.floor(F.col("at") / length), F.floor((end - 1) / length))))
    start, stop = F.greatest(F.lit(0), F.col("row") * length - F.col("at")), F.least(end, (F.col("row") + 1) * length) - F.col("at")
    return d.select("lane", "row", "pass", "doc_id", start.cast("long").alias("start"), stop.cast("long").alias("end"), (F.col("at") + start - F.col("row") * length).cast("long").alias("pos"))


def cursors(docs: DataFrame, seed: int, length: int, rows: DataFrame) -> DataFrame:
    """(lane, row, pass, idx, doc_id, tok_off): where a lane's stream stands before each row; idx is the document's place in the pass."""
    p = passes(docs, seed, 1 + (endless_rows(docs, seed, length, rows).agg(F.max("pass")).first()[0] or 0))
    places = running_sum(p, ["lane", "pass"], [F.col("h"), F.col("doc_id")], F.lit(1), F.col("bucket"), "idx").select(F.col("lane").alias("_lane"), F.col("pass").alias("_pass"), F.col("doc_id").alias("_id"), "idx")
    s = endless_rows(docs, seed, length, rows).where("pos = 0")
    return s.join(places, (s["lane"] == places["_lane"]) & (s["pass"] == places["_pass"]) & (s["doc_id"] == places["_id"])).select("lane", "row", "pass", "idx", "doc_id", F.col("start").alias("tok_off"))


def pool_for(stage: Column, has_reserve: Column, anneal: str = "anneal") -> Column:
    """The annealing stage reads the reserve of a lane that has one; all else reads main."""
    return F.when((stage == anneal) & has_reserve, "reserve").otherwise("main")


def row_order(rows: DataFrame, lanes: list[str], base: Column, step: str = "step") -> DataFrame:
    """``rows`` (lane, row_len, rank_in_lane) with their place in the step: rows of the base length first, in order of lanes, then long ones."""
    number = F.create_map(*[x for i, lane in enumerate(lanes) for x in (F.lit(lane), F.lit(i))])
    w = Window.partitionBy(step).orderBy((F.col("row_len") > base).cast("int"), number[F.col("lane")], "rank_in_lane")  # a step's rows are few
    return rows.withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def padded_rows(docs: DataFrame, length: int) -> DataFrame:
    """One row for each document, cut off behind ``length`` tokens and padded to it: proxy and validation rows, which are read and not trained on."""
    real = F.least(F.col("n_tokens"), F.lit(length))
    return docs.withColumns({"n_real": real.cast("long"), "n_pad": (length - real).cast("long"), "cut": F.col("n_tokens") > length})


def row_hashes(rows: DataFrame) -> DataFrame:
    """Digests of each row's arrays, and of what each position may attend to, as the first position of its segment (a pad's is its own).

    The extents say the same as the square mask, which is never built.
    """
    n = F.size("segment_ids")
    places = F.sequence(F.lit(0), n - 1)
    extent = F.zip_with(places, F.arrays_zip("segment_ids", "position_ids"), lambda i, x: F.when(x["segment_ids"] == 0, i).otherwise(i - x["position_ids"]))
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return rows.select("row_id", digest(F.col("tokens")).alias("tokens_sha256"), digest(F.col("labels")).alias("labels_sha256"), digest(F.col("loss_mask")).alias("mask_sha256"), digest(F.col("segment_ids")).alias("segments_sha256"), digest(extent).alias("attention_sha256"))


def schedule_hash(schedule: DataFrame, order: list[str], leave_out: tuple[str, ...] = ("blocked_sources",)) -> str:
    """A hash of a schedule's rows in order, without the columns that do not belong to the plan. A schedule has a row for each step and lane."""
    columns = sorted(c for c in schedule.columns if c not in leave_out)
    rows = schedule.select(F.struct(*order).alias("o"), sha(*[F.col(c) for c in columns]).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ","), 256)).first()[0]
