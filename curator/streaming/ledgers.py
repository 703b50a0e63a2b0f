"""Streams: a chained ledger, whose heads are read from what is committed, and a deferral queue as a state per key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curator.sources.writers import commit_batch

CHAINED = "branch long, ledger_offset long, event_id long, prev_record_hash string, record_hash string"


@dataclass(frozen=True)
class LedgerStream:
    """A stream of records (branch, order, event_id, payload) that are chained where they are committed; the ledger's heads are the state."""

    records: DataFrame

    @property
    def sparkSession(self) -> SparkSession:
        return self.records.sparkSession

    def writer(self, out: str) -> DataStreamWriter:
        """Each batch is a batch of the ledger: its rows are sorted on disk and chained in order, which a function of a group's state would have to do in memory."""
        return self.records.withColumnRenamed("order", "ord").writeStream.foreachBatch(lambda batch, number: commit_batch(batch, {}, out, number))

    def read(self, out: str) -> DataFrame:
        return self.sparkSession.read.schema(f"{CHAINED}, batch_id int").parquet(f"{out}/ledger").drop("batch_id")


def ledger_stream(records: DataFrame) -> LedgerStream:
    """A streaming ledger of ``records`` (branch, order, event_id, payload); records come in order, batch by batch."""
    return LedgerStream(records.select("branch", "order", "event_id", "payload"))


QUEUED = "lane string, idx long, deferrals int, status string"


def defer(cap: int, most: int, accept: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Waiting candidates first, then new ones; ``accept`` are taken, the next wait, at most ``cap`` of them."""
        ids, counts = state.get if state.exists else ([], [])
        new = pd.concat(list(batches)).sort_values(["score", "idx"], ascending=[False, True])
        pool = list(zip(ids, counts)) + [(i, 0) for i in new["idx"].tolist()]
        out, wait = [], []
        for k, (i, n) in enumerate(pool):
            if k < accept:
                out.append((key[0], i, n, "accepted"))
            elif n >= most:
                out.append((key[0], i, n, "defer_expired"))
            elif len(wait) >= cap:
                out.append((key[0], i, n, "defer_queue_full"))
            else:
                wait.append((i, n + 1))
                out.append((key[0], i, n, "deferred"))
        state.update(([i for i, _ in wait], [n for _, n in wait]))
        yield pd.DataFrame(out, columns=["lane", "idx", "deferrals", "status"])

    return run


def deferral_stream(candidates: DataFrame, cap: int = 6, most: int = 2, accept: int = 4) -> DataFrame:
    """Statuses of streamed candidates (lane, idx, score), with a queue kept per lane."""
    return candidates.groupBy("lane").applyInPandasWithState(defer(cap, most, accept), QUEUED, "ids array<long>, counts array<int>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame | LedgerStream, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now and read the result; running it again goes on where it stopped."""
    chained = isinstance(stream, LedgerStream)
    writer = stream.writer(out) if chained else stream.writeStream.format("parquet").outputMode("append").option("path", out)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.read(out) if chained else stream.sparkSession.read.schema(stream.schema).parquet(out)
