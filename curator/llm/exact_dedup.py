"""Exact duplicates: a 128-bit content hash groups texts, bytes inside a group are compared.

Texts are equal when they are equal without white space (x20, x09-x0D). Of equal texts the row with the most
code points in the original text stays, then the smallest ``doc_id``.

Plan. One scan gives narrow keys (``doc_id``, 128-bit hash, length), written once. Hashes are counted with map-side
combination. Texts that may share their hash, picked by a bounded bit map, are read again and grouped by
(hash, text): the grouping compares whole byte strings, copies collapse before the shuffle, and a hash with two
different texts shows itself. Only the rows of such a hash are told apart by a second hash of the text; the
result is exact as long as SHA-256 has no collision inside a colliding MD5 group.

Cases. Null text counts as empty, and all empty texts form a group. A null ``doc_id`` comes last among equal
lengths; if it alone is in its group, ``keep_id`` is null. Of rows that agree in ``doc_id`` and length, the row
kept is the one with the smallest original text; rows equal in that too are one row in all but number, of which
one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm.spread import among, drop_rows
from curator.scratch import materialize

WHITE = r"[\x20\x09-\x0D]+"


def normalized(text: str = "text"):
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def content_keys(documents: DataFrame) -> DataFrame:
    """doc_id, 128-bit hash and SHA-256 of the normalised text, code points and a tie-breaking hash of the text."""
    d = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), normalized().alias("norm"))
    return d.select(
        "doc_id",
        F.unhex(F.md5("norm")).alias("h"),
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.length("text").alias("n"),
        F.xxhash64("text").alias("tie"),
    )


def collided(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The hashes ``h`` whose rows do not all have the same normalised bytes."""
    shared = keys.groupBy("h").count().where("count > 1").select(F.col("h").alias("member"))
    texts = documents.select(normalized().alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
    texts = among(texts, F.col("h"), shared, keys.count() // 2).where("maybe_member").select("h", "norm")
    return texts.groupBy("h", "norm").agg(F.lit(1).alias("one")).groupBy("h").count().where("count > 1").select("h")


def exact_dedup(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and ``tie``, a hash of the original text."""
    keys = materialize(content_keys(documents), "exact-keys")
    clash = materialize(collided(documents, keys), "exact-collisions")
    if clash.limit(1).count():
        keys = keys.join(clash.withColumn("clash", F.lit(True)), "h", "left").withColumn("sub", F.when(F.col("clash"), F.col("sha"))).drop("clash")
    else:
        keys = keys.withColumn("sub", F.lit(None).cast("binary"))
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    groups = keys.groupBy("h", "sub").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    per_row = keys.groupBy("h", "sub", "sha", "doc_id", "n", "tie").agg(F.count("*").alias("times"))
    groups = materialize(groups, "exact-groups")  # a side of its own, so that adaptive execution can split a hot hash
    g = groups.select(F.col("h").alias("gh"), F.col("sub").alias("gsub"), "first", "group_size")
    rows = per_row.join(g, (F.col("h") == F.col("gh")) & F.col("sub").eqNullSafe(F.col("gsub")))
    mine = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (mine.eqNullSafe(F.col("first")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "tie",
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with their own columns."""
    rows = exact_dedup(documents).groupBy("doc_id", "tie").agg(F.max("kept").alias("keep_one"), F.count("*").alias("times"))
    return drop_rows(documents, rows.where("not keep_one or times > 1").select("doc_id", "tie", "keep_one"))
