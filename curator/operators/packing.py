"""Packing of documents into rows of fixed length, and what a row's masks and positions are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from curator.operators.sized import running_sum


def concat_chop(docs: DataFrame, keys: list[str], order: list[Column], bucket: Column, length: int) -> DataFrame:
    """Spans (keys, doc_id, row, start, end) of an endless stream cut every ``length`` tokens; the last row may be short.

    Positions are running sums in two levels, so a stream is not one task's work. ``bucket`` must not decrease along ``order``.
    """
    d = running_sum(docs, keys, order, F.col("n_tokens"), bucket, "at")
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n_tokens") - 1) / length)
    d = d.where("n_tokens > 0").withColumn("row", F.explode(F.sequence(first, last)))
    start = F.greatest(F.lit(0), F.col("row") * length - F.col("at"))
    end = F.least(F.col("n_tokens"), (F.col("row") + 1) * length - F.col("at"))
    return d.select(*keys, "doc_id", "row", start.cast("long").alias("start"), end.cast("long").alias("end"), (F.col("at") + start - F.col("row") * length).cast("long").alias("pos"))


class PackingError(Exception):
    """A document is longer than the rows it must fit."""


def _row_after_row(lengths: list[int], row: int, free: int, length: int) -> tuple[list[int], int, int]:
    """Rows of documents from a row that has ``free`` tokens left, and the last row with what is left of it."""
    out = []
    for n in lengths:
        if n > free:
            row, free = row + 1, length
        free -= n
        out.append(row)
    return out, row, free


def _transitions(lengths: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every number of free tokens at the start: rows opened and tokens free at the end."""
    free, opened, of = np.arange(length + 1), np.zeros(length + 1, np.int64), np.arange(length + 1)
    for i, n in enumerate(lengths):
        over = n > free
        opened = opened + over
        free = np.where(over, length, free) - n
        if i % 16 == 15 and len(free) > 1:  # starts soon agree, but for the rows opened
            pairs, back = np.unique(np.stack([opened, free]), axis=1, return_inverse=True)
            (opened, free), of = pairs, back.ravel()[of]
    return opened[of], free[of]


def next_fit(docs: DataFrame, keys: list[str], order: str, length: int, bucket: Column | None = None) -> DataFrame:
    """``docs`` with ``row``: whole documents in stream order, a row is closed at the first that does not fit.

    Documents longer than a row are in none: their row is null. With ``bucket``, which must not decrease along ``order``, a stream is
    not one task's work: each bucket is first run from every state a row can be in, these few numbers are chained along the
    stream, and each bucket is then run from the state it really starts in.
    """
    fits = docs.where(F.col("n_tokens") <= length)
    schema = StructType([*docs.schema.fields, StructField("row", LongType())])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.assign(row=_row_after_row(rows["n_tokens"].tolist(), 0, length, length)[0])

    if bucket is None:
        packed = fits.groupBy(*keys).applyInPandas(whole, schema)
    else:
        dealt = fits.withColumn("_bucket", bucket)
        head = StructType([*(dealt.schema[k] for k in [*keys, "_bucket"])])

        def tabulate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            opened, free = _transitions(rows.sort_values(order)["n_tokens"].tolist(), length)
            return pd.DataFrame([[*key, opened.tolist(), free.tolist()]], columns=[*keys, "_bucket", "opened", "free"])

        def chained(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_bucket")
            row, free, rows_, frees = 0, length, [], []
            for opened, left in zip(rows["opened"], rows["free"]):
                rows_.append(row)
                frees.append(free)
                row, free = row + int(opened[free]), int(left[free])
            return rows[[*keys, "_bucket"]].assign(_row=rows_, _free=frees)

        def resume(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(order)
            out, *_ = _row_after_row(rows["n_tokens"].tolist(), int(rows["_row"].iloc[0]), int(rows["_free"].iloc[0]), length)
            return rows.drop(columns=["_bucket", "_row", "_free"]).assign(row=out)

        table = StructType([*head.fields, StructField("opened", ArrayType(LongType())), StructField("free", ArrayType(LongType()))])
        starts = dealt.groupBy(*keys, "_bucket").applyInPandas(tabulate, table)
        starts = starts.groupBy(*keys).applyInPandas(chained, StructType([*head.fields, StructField("_row", LongType()), StructField("_free", LongType())]))
        packed = dealt.join(starts, [*keys, "_bucket"]).select(*docs.columns, "_bucket", "_row", "_free").groupBy(*keys, "_bucket").applyInPandas(resume, schema)
    return packed.unionByName(docs.where(F.col("n_tokens") > length).withColumn("row", F.lit(None).cast("long")))


def look_ahead_rows(lengths: list[int], length: int, window: int) -> list[list[int]]:
    """Rows of document numbers: a buffer of ``window`` documents, filled at a row's start only, gives its longest
    that fits, the earliest of equals, until none does."""
    rows, buffer, nxt = [], [], 0
    while nxt < len(lengths) or buffer:
        while len(buffer) < window and nxt < len(lengths):
            if lengths[nxt] > length:
                raise PackingError(f"{lengths[nxt]} tokens in rows of {length}")
            buffer.append(nxt)
            nxt += 1
        free, row = length, []
        while fits := [d for d in buffer if lengths[d] <= free]:
            best = max(fits, key=lambda d: (lengths[d], -buffer.index(d)))
            buffer.remove(best)
            row.append(best)
            free -= lengths[best]
        rows.append(row)
    return rows


def best_fit(docs: DataFrame, keys: list[str], order: str, length: int, window: int) -> DataFrame:
    """``docs`` with ``row`` and ``ord`` of the look-ahead packer, one pass over each stream. Documents longer than a row are in none: both are null."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order).reset_index(drop=True)
        row, place = [0] * len(part), [0] * len(part)
        for r, members in enumerate(look_ahead_rows(part["n_tokens"].tolist(), length, window)):
            for k, d in enumerate(members):
                row[d], place[d] = r, k
        return part.assign(row=row, ord=place)

    packed = docs.where(F.col("n_tokens") <= length).groupBy(*keys).applyInPandas(fold, StructType([*docs.schema.fields, StructField("row", LongType()), StructField("ord", IntegerType())]))
    return packed.unionByName(docs.where(F.col("n_tokens") > length).withColumns({"row": F.lit(None).cast("long"), "ord": F.lit(None).cast("int")}))


def best_fit_decreasing(counts: dict[int, int], length: int) -> int:
    """Rows that best-fit decreasing needs for ``counts`` documents of each length up to ``length``.

    Documents of one length are placed together: an open row takes as many as fit before the next fullest one is asked.
    """
    rows, open_ = 0, [0] * (length + 1)  # rows by their free tokens
    for n in sorted(counts, reverse=True):
        left = counts[n]
        for free in range(n, length + 1):
            while left and open_[free]:
                each = min(free // n, left)
                many = min(open_[free], left // each)
                open_[free] -= many
                open_[free - each * n] += many
                left -= many * each
        full, part = divmod(left, length // n)
        rows += full + (part > 0)
        open_[length - length // n * n] += full
        if part:
            open_[length - part * n] += 1
    return rows


def counterfactual(docs: DataFrame, keys: list[str], order: str, length: int, bucket: Column | None = None) -> DataFrame:
    """Rows of the same documents under four policies, for each stream; documents over ``length`` take whole rows of their own.

    Two are sums, next-fit is ``next_fit``, and best-fit decreasing needs the number of documents of each length only.
    """
    own = F.when(F.col("n_tokens") > length, F.ceil(F.col("n_tokens") / length)).otherwise(F.lit(0))
    sums = docs.groupBy(*keys).agg(F.sum(F.ceil(F.col("n_tokens") / length)).alias("pad_only"), F.ceil(F.sum("n_tokens") / length).alias("concat_chop"), F.sum(own).alias("_own"))
    fitted = next_fit(docs, keys, order, length, bucket).groupBy(*keys).agg((F.coalesce(F.max("row"), F.lit(-1)) + 1).alias("_rows"))
    histogram = docs.where(F.col("n_tokens").between(1, length)).groupBy(*keys, "n_tokens").count()

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, best_fit_decreasing(dict(zip(rows["n_tokens"].tolist(), rows["count"].tolist())), length)]], columns=[*keys, "_best"])

    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    best = histogram.groupBy(*keys).applyInPandas(fold, f"{schema}, _best long")
    j = sums.join(fitted, keys, "left").join(best, keys, "left")
    rows = lambda c: (F.coalesce(F.col(c), F.lit(0)) + F.col("_own")).cast("long")
    return j.select(*keys, F.col("pad_only").cast("long").alias("pad_only"), F.col("concat_chop").cast("long").alias("concat_chop"), rows("_rows").alias("next_fit"), rows("_best").alias("best_fit_decreasing"))


def materialize_rows(spans: DataFrame, docs: DataFrame, length: int, pad: int) -> DataFrame:
    """Rows of tokens, labels, loss mask, segment and position ids from spans (row_id, ord, doc_id, start, end) and
    documents (doc_id, tokens, elig).

    A label is the next token of the same segment if that is eligible for loss; the mask says where labels are.
    """
    j = spans.join(docs.select("doc_id", "tokens", "elig"), "doc_id")
    bad = (F.col("start") < 0) | (F.col("end") > F.size("tokens")) | (F.col("end") <= F.col("start"))
    j = j.withColumn("ok", F.when(bad, F.raise_error(F.lit("span out of range"))).otherwise(F.lit(1)))
    n = (F.col("end") - F.col("start")).cast("int")
    t, e = F.slice("tokens", (F.col("start") + 1).cast("int"), n), F.slice("elig", (F.col("start") + 1).cast("int"), n)
    has = F.concat(F.slice(e, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(0).cast(j.schema["elig"].dataType.elementType)))
    label = F.concat(F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(-100)))
    part = F.struct("ord", t.alias("t"), F.transform(F.sequence(F.lit(0), n - 1), lambda i: i).alias("pos"), F.zip_with(label, has, lambda x, h: F.when(h == 1, x).otherwise(F.lit(-100))).alias("label"), has.alias("has"), "ok")
    g = j.groupBy("row_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    join = lambda field: F.flatten(F.transform("parts", lambda p: p[field]))
    segment = F.flatten(F.transform("parts", lambda p, i: F.array_repeat(i + 1, F.size(p["t"]))))
    g = g.select("row_id", join("t").alias("t"), join("label").alias("l"), join("has").alias("m"), segment.alias("s"), join("pos").alias("p"))
    g = g.withColumn("left", F.when(F.size("t") > length, F.raise_error(F.lit("row overflows"))).otherwise(F.lit(length) - F.size("t")).cast("int"))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v).cast(g.schema[c].dataType.elementType), F.col("left")))
    return g.select("row_id", fill("t", pad).alias("tokens"), fill("l", -100).alias("labels"), fill("m", 0).alias("loss_mask"), fill("s", 0).alias("segment_ids"), fill("p", 0).alias("position_ids"), F.size("t").alias("n_real"), F.aggregate("m", F.lit(0), lambda a, x: a + x.cast("int")).alias("n_loss"))


def attention_pairs(spans: DataFrame, length: int) -> DataFrame:
    """(row_id, allowed): pairs that attention allows, each segment causally and each pad with itself; no mask is built."""
    n = F.col("end") - F.col("start")
    g = spans.groupBy("row_id").agg(F.sum(n * (n + 1) / 2).alias("inner"), F.sum(n).alias("real"))
    return g.select("row_id", (F.col("inner") + length - F.col("real")).cast("long").alias("allowed"))


def microbatches(rows: DataFrame, step: str, order: list[str], positions: int) -> DataFrame:
    """``rows`` (with length L) with ``microbatch``: consecutive rows of one length, at most ``positions`` in all."""
    w = Window.partitionBy(step, "L").orderBy(*order)
    inside = F.floor((F.row_number().over(w) - 1) / F.greatest(F.lit(1), F.floor(F.lit(positions) / F.col("L"))))
    return rows.withColumn("microbatch", inside.cast("int"))

