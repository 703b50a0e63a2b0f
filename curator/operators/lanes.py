"""Routing of admitted documents to lanes, pools and shards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from curator.functions.hashing import order_key
from curator.operators.sized import running_sum

#: Upper token counts of the bands; the last band has none.
DIFFICULTY = [("B0_B1", 200), ("B2_B3", 450), ("B4_B5", None)]
REASONING = [("low", 63), ("medium", 511), ("high", 4095), ("ultra", 32767)]


def band(n: Column, bands: list[tuple[str, int | None]]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, most in bands:
        out = out.when(F.lit(True) if most is None else n <= most, F.lit(name))
    return out


def assign(docs: DataFrame, base_window: int, long_row: int, bands: list[tuple[str, int | None]] = DIFFICULTY) -> DataFrame:
    """``docs`` (lane_hint, n_tokens, tool_calls) with lane, subpool and pool; rows that fit no lane have lane null.

    Code up to the base window is code, up to the long row long_context, else dropped. Agentic needs the long row and
    is main with two tool calls, else reserve. The multilingual lane and reasoning have bands. Web and stem take any length.
    """
    n, hint = F.col("n_tokens"), F.col("lane_hint")
    lane = (
        F.when(hint == "code", F.when(n <= base_window, "code").when(n <= long_row, "long_context"))
        .when(hint.isin("agentic", "long_context"), F.when(n <= long_row, hint))
        .when(hint == "reasoning", F.when((n <= base_window) & (n <= REASONING[-1][1] + 1), hint))
        .otherwise(hint)
    )
    subpool = F.when(F.col("lane") == "indic", band(n, bands)).when(F.col("lane") == "reasoning", band(n - 1, REASONING)).otherwise("all")
    pool = F.when((F.col("lane") == "agentic") & (F.col("tool_calls") < 2), "reserve").otherwise("main")
    return docs.withColumn("lane", lane).withColumn("subpool", F.when(F.col("lane").isNotNull(), subpool)).withColumn("pool", F.when(F.col("lane").isNotNull(), pool))


def hash_bucket(key: Column) -> Column:
    """Bucket of a hexadecimal order key: its first three digits, which deal rows evenly."""
    return F.substring(key, 1, 3)


def reserve(laned: DataFrame, seed: int, fractions: dict[str, float], need: dict[str, int]) -> DataFrame:
    """``laned`` with the annealing reserve marked: of each lane a prefix in hash order, until both a share of the
    documents and a number of tokens are reached."""
    main = laned.where("pool = 'main'").withColumn("h", order_key(F.lit(seed), F.lit("reserve"), F.col("lane"), F.col("doc_id")))
    order = [F.col("h"), F.col("doc_id")]
    ranked = running_sum(main, ["lane"], order, F.lit(1), hash_bucket(F.col("h")), "before_docs")
    ranked = running_sum(ranked, ["lane"], order, F.col("n_tokens"), hash_bucket(F.col("h")), "before_tokens")
    counts = main.groupBy("lane").agg(F.count("*").alias("lane_docs"))
    pick = lambda d, default: F.coalesce(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[F.col("lane")], F.lit(default))
    share = F.greatest(F.lit(1), F.ceil(pick(fractions, 0.0) * F.col("lane_docs") - F.lit(1e-6)))
    wanted = (F.col("before_docs") < share) | (F.col("before_tokens") < pick(need, 0))
    out = ranked.join(F.broadcast(counts), "lane").withColumn("pool", F.when(wanted & (pick(fractions, 0.0) > 0), "reserve").otherwise("main"))  # one row for each lane
    return out.drop("h", "before_docs", "before_tokens", "lane_docs").unionByName(laned.where("pool <> 'main' or pool is null"))


def epoch_order(docs: DataFrame, seed: int, epochs: int, key: Column) -> DataFrame:
    """Rank of each document in each epoch's shuffle: a sort by hash, the same on any number of machines. Needs lane and doc_id."""
    e = docs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.withColumn("h", order_key(F.lit(seed), key, F.col("epoch"), F.col("doc_id")))
    out = running_sum(e, ["lane", "epoch"], [F.col("h"), F.col("doc_id")], F.lit(1), hash_bucket(F.col("h")), "rank")
    return out.drop("h")


def chunk(docs: DataFrame, keys: list[str], target: int, segment: int = 1 << 20) -> DataFrame:
    """``docs`` with greedy chunks of at most ``target`` tokens in doc_id order: chunk number and the offset inside it.

    A document starts a new chunk if the current one is not empty and would overflow. The fold is sequential, so it runs on
    stretches of ``segment`` ids, each of which starts a chunk of its own; stretches are independent tasks.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        number, used, chunks, offsets = 0, 0, [], []
        for n in rows["n_tokens"].tolist():
            if used and used + n > target:
                number, used = number + 1, 0
            chunks.append(number)
            offsets.append(used)
            used += n
        return rows.assign(chunk=chunks, offset=offsets)

    d = docs.withColumn("segment", F.floor(F.col("doc_id") / segment).cast("long"))
    schema = StructType([*d.schema.fields, StructField("chunk", IntegerType()), StructField("offset", LongType())])
    return d.groupBy(*keys, "segment").applyInPandas(fold, schema)


def shard_ids(chunks: DataFrame, keys: list[str], tokenizer: str) -> DataFrame:
    """(keys, segment, chunk, shard_id, content_hash): a shard's name follows from its documents in order."""
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "offset", "n_tokens", "content")))
    g = chunks.groupBy(*keys, "segment", "chunk").agg(parts.alias("parts"))  # at most target tokens each
    body = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["doc_id"], p["offset"], p["n_tokens"], p["content"])), ",")
    g = g.withColumn("content_hash", F.sha2(F.concat_ws("|", F.lit(tokenizer), *keys, body), 256)).drop("parts")
    return g.withColumn("shard_id", F.concat(F.lit("shd-"), F.col("lane"), F.lit("-"), F.substring("content_hash", 1, 12)))


def manifest(chunks: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each shard: counts, distinct languages and sources, status of personal data."""
    by = [*keys, "segment", "chunk"]
    pii = F.when(F.sum("pii") > 0, "redacted").otherwise("clean")
    g = chunks.groupBy(*by).agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("token_count"), F.array_sort(F.collect_set("lang")).alias("languages"), F.array_sort(F.collect_set("source")).alias("sources"), pii.alias("pii_status"))
    return ids.join(g, by)


