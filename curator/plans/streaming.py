"""Streaming queries over the ``events`` and ``embeddings`` tables, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curator.functions.hashing import canonical_json
from curator.plans.ledger import RECORDS
from curator.scratch import shared_root
from curator.streaming import ledgers as S


def _places(spark, name: str) -> tuple[str, str]:
    root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def _stream(spark, sf: str, table: str):
    """A stream of one table's files. The source reads folders: a table that is one file is its folder's one match."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque*")


def streaming_ledger(spark, sf):
    """The chained ledger of every branch, by a stream with the head as its state; equal to the batch chain."""
    e = _stream(spark, sf, "events").withColumns({"branch": F.col("user_id") % 4, "cents": F.round(F.col("value") * 100).cast("long")})
    e = e.select("branch", F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("order"), "event_id", canonical_json(branch=F.col("branch"), cents=F.col("cents"), event_id=F.col("event_id"), event_type=F.col("event_type")).alias("payload"))
    return S.run_available(S.ledger_stream(e), *_places(spark, "ledger")).select("branch", "ledger_offset", "event_id", "record_hash")


def streaming_deferral_queue(spark, sf):
    """Deferral of streamed candidates by label, the queue being the state."""
    e = _stream(spark, sf, "embeddings").select(F.concat(F.lit("lane"), F.col("label").cast("string")).alias("lane"), F.col("vec_id").alias("idx"), (F.col("vec_id") % 17).cast("double").alias("score"))
    return S.run_available(S.deferral_stream(e), *_places(spark, "deferral"))


SQL = {
    "streaming_ledger": f"""WITH RECURSIVE {RECORDS}, ch AS (SELECT branch, o, event_id, sha256(repeat('0', 64) || '|' || payload) AS h FROM rec WHERE o = 1
        UNION ALL SELECT r.branch, r.o, r.event_id, sha256(ch.h || '|' || r.payload) FROM ch JOIN rec r ON r.branch = ch.branch AND r.o = ch.o + 1)
        SELECT branch, o AS ledger_offset, event_id, h AS record_hash FROM ch""",
    # one file is one batch, so nobody waits yet
    "streaming_deferral_queue": """WITH r AS (SELECT 'lane' || label AS lane, vec_id AS idx, row_number() OVER (PARTITION BY label ORDER BY vec_id % 17 DESC, vec_id) AS k FROM embeddings)
        SELECT lane, idx, 0 AS deferrals, CASE WHEN k <= 4 THEN 'accepted' WHEN k <= 10 THEN 'deferred' ELSE 'defer_queue_full' END AS status FROM r""",
}
QUERIES = {f.__name__: f for f in (streaming_ledger, streaming_deferral_queue)}
