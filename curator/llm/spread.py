"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator.scratch import materialize


#: Rows and bytes of an Arrow batch. Texts are long, and both the JVM and the Python worker hold a batch or two.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000}

#: Binary logarithms of the least and the largest size of a bit map: 8 kB and 32 MB.
MAP_BITS = 16, 28


def release() -> None:
    """Give free memory back to the system: a worker is kept for later stages, which need it themselves."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch.

    Spark reads the limits of a batch from the session when the plan runs, so they are lowered there to ``BATCH`` where they are higher, and stay so.
    """
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)
        release()

    return df.mapInArrow(run, schema)


def among(df: DataFrame, key: Column, members: DataFrame, at_most: int | None = None) -> DataFrame:
    """``df`` with a column ``maybe_member``: false only if ``key`` is certainly not in ``members.member``.

    Keys are hashed to a bit map of sixteen bits for each of the ``at_most`` members (as many as there are, if not given), but
    ``MAP_BITS`` at most, so that its size is bounded however large the data and it can be broadcast. It saves moving texts that need no second look; where
    it fills up, all rows are kept and results do not change. Null keys count as possible members.
    """
    at_most = members.count() if at_most is None else at_most
    bits = min(max(MAP_BITS[0], (16 * at_most).bit_length()), MAP_BITS[1])
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)) + 1
    m = members.select(spot(F.col("member")).alias("_spot"))
    maps = m.groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(1 + bitmap_bit_position(_at) div 8 as int), 1)), 16, 10) as int)"
    hit = F.coalesce(F.expr(f"{byte} & shiftleft(1, cast(bitmap_bit_position(_at) % 8 as int))") != 0, F.lit(False))
    out = df.withColumn("_at", spot(key)).withColumn("_key_null", key.isNull())
    joined = out.join(F.broadcast(maps), F.bitmap_bucket_number(F.col("_at")) == F.col("_bucket"), "left")
    return joined.withColumn("maybe_member", hit | F.col("_key_null")).drop("_at", "_key_null", "_bucket", "_bits")


def drop_rows(documents: DataFrame, dropped: DataFrame) -> DataFrame:
    """``documents`` without the rows that ``dropped`` names by doc_id and ``tie`` (xxhash64 of the text).

    Where ``keep_one`` is true, one of the rows that agree in both stays. Only rows that may be named are moved;
    the texts of all others stay where they are.
    """
    dropped = materialize(dropped, "dropped")
    # rows are packed, so that no column of theirs can clash with those of this function
    packed = documents.select(F.struct(*documents.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tie"))
    d = among(packed, F.xxhash64("_id", "_tie"), dropped.select(F.xxhash64("doc_id", "tie").alias("member")), dropped.count())
    gone = dropped.select(F.col("doc_id").alias("_gone_id"), F.col("tie").alias("_gone_tie"), F.col("keep_one").alias("_keep_one"))
    sure = d.where("not maybe_member").select("_row")
    named = d.where("maybe_member").join(gone, d["_id"].eqNullSafe(gone["_gone_id"]) & (d["_tie"] == gone["_gone_tie"]), "left")
    others = named.where("_gone_tie is null").select("_row")
    one = named.where("_keep_one").dropDuplicates(["_gone_id", "_gone_tie"]).select("_row")
    return sure.unionByName(others).unionByName(one).select("_row.*")


def hash_bound(rows: int, most: int) -> int:
    """A signed 64-bit hash up to which about four times ``most`` of ``rows`` rows lie, or all of them where they are not so many.

    The ``most`` rows with the least hashes are among these, so that they can be ranked without moving more.
    """
    return (1 << 63) - 1 if rows <= 4 * most else -(1 << 63) + (1 << 66) * most // rows
