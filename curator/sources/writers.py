"""Writers: shards by partition, write-once stores, registries, ledgers, checkpoints, reports."""

from __future__ import annotations

import datetime
import json
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TextIO

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from curator.functions.hashing import GENESIS, canonical_json
from curator.operators import ledger
from curator.operators.learning import trace_hash
from curator.operators.sized import small
from curator.operators.words import limit_batches

#: Files that the driver writes at a time.
WRITERS = 16


class ImmutableError(Exception):
    """A name that is taken by other content was written again."""


def write_shards(docs: DataFrame, path: str) -> None:
    """Shard documents partitioned by split, lane, pool and subpool, so that scans of a lane read that lane only."""
    docs.repartition("split", "lane", "pool", "subpool", "shard_id").sortWithinPartitions("shard_id", "doc_id").write.mode("errorifexists").partitionBy("split", "lane", "pool", "subpool").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def store_once(shards: DataFrame, path: str) -> dict[str, int]:
    """Append shards (shard_id, content_hash, …) to a store that never changes; counts of written and identical ones.

    A shard_id that is there with the same content is left alone; one with other content raises and nothing is written.
    """
    spark = shards.sparkSession
    if not _exists(spark, path):
        shards.write.parquet(path)
        return {"written": shards.count(), "identical_existing": 0}
    have = spark.read.parquet(path).select(F.col("shard_id").alias("s"), F.col("content_hash").alias("h"))
    j = shards.join(have, F.col("shard_id") == F.col("s"), "left")
    clash = j.where("s is not null and h <> content_hash").select("shard_id").limit(1).collect()
    if clash:
        raise ImmutableError(clash[0].shard_id)
    new = j.where("s is null").drop("s", "h")
    counts = j.agg(F.count(F.when(F.col("s").isNull(), 1)).alias("written"), F.count("s").alias("identical_existing")).first().asDict()
    if counts["written"]:
        new.write.mode("append").parquet(path)
    return counts


def registry(manifests: DataFrame) -> DataFrame:
    """Registry entries with permissions by split, and each entry's hash."""
    r = manifests.select("shard_id", "split", "content_hash", "token_count", "n_documents", (F.col("split") == "train").alias("train"), F.col("split").isin("test", "validation").alias("eval_read"), (F.col("split") == "proxy").alias("proxy_read"))
    return r.withColumn("entry_hash", F.sha2(canonical_json(**{c: F.col(c) for c in r.columns}), 256))


def registry_hash(entries: DataFrame) -> str:
    """The registry's own hash: a hash of its entries' hashes in order, of which there is one a shard."""
    return entries.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard_id", "entry_hash"))), lambda x: x["entry_hash"]), ","), 256)).first()[0]


def append_records(records: DataFrame, path: str, batch_id: int, branch: str = "branch") -> None:
    """Append a batch to a ledger so that writing it again changes nothing: batches are partitions that are overwritten."""
    records.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def save_checkpoint(meta: dict, path: str, spark: SparkSession) -> None:
    """A checkpoint's row, written last; a checkpoint of the same branch and step is never written twice."""
    row = spark.createDataFrame([meta])
    if _exists(spark, path):
        have = spark.read.parquet(path).where((F.col("branch") == meta["branch"]) & (F.col("step") == meta["step"]))
        if have.limit(1).count():
            raise ImmutableError(f"{meta['branch']}@s{meta['step']:05d}")
    row.write.mode("append").parquet(path)


def report(values: dict) -> str:
    """A report as JSON with sorted keys."""
    return json.dumps(values, sort_keys=True, indent=1, allow_nan=False)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_binary_shards(shards: DataFrame, path: str) -> None:
    """Two files a shard (shard_id, tokens, elig): ids of 16 bits, and eligibility bytes. Executors make the bytes; the driver opens ``WRITERS`` files at a time
    and holds the bytes of no more than two partitions and twice as many files."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, tokens, elig in zip(b["shard_id"], b["tokens"], b["elig"]):
                yield pd.DataFrame({"name": [f"{shard}.tokens", f"{shard}.elig"], "content": [np.asarray(tokens, "<u2").tobytes(), np.asarray(elig, "<u1").tobytes()]})

    limit_batches(shards.sparkSession)
    packed = shards.select("shard_id", "tokens", "elig").mapInPandas(pack, "name string, content binary")
    write = _file_writer(shards.sparkSession, path)
    with ThreadPoolExecutor(WRITERS) as pool:
        waiting: deque = deque()
        for row in packed.toLocalIterator():
            waiting.append(pool.submit(write, f"{path}/{row.name}", row.content))
            if len(waiting) > 2 * WRITERS:
                waiting.popleft().result()
        for done in waiting:
            done.result()


def _file_writer(spark: SparkSession, path: str) -> Callable[[str, bytes], None]:
    """A function that writes files below ``path`` which are not there yet. The file system is asked for once and refuses what exists."""
    fs, hadoop = _file_system(spark, path)
    place = hadoop.fs.Path

    def write(name: str, content: bytes) -> None:
        try:
            out = fs.create(place(name), False)
        except Py4JJavaError as e:
            if fs.exists(place(name)):
                raise ImmutableError(name) from e
            raise
        try:
            out.write(content)
        finally:
            out.close()

    return write


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file that is not there yet."""
    _file_writer(spark, path)(path, content)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    return hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def eval_registry(fingerprints: DataFrame, canaries: list[str], documents: DataFrame) -> dict:
    """The evaluation registry: documents by shard, sorted fingerprints of each size, canaries. The benchmark is small, so this is a driver's object."""
    by_k: dict[str, list[str]] = {}
    for r in fingerprints.select("k", "h").distinct().orderBy("k", "h").collect():
        by_k.setdefault(str(r.k), []).append(r.h)
    shards: dict[str, list] = {}
    for r in documents.select("shard_id", "doc_id").orderBy("shard_id", "doc_id").collect():
        shards.setdefault(r.shard_id, []).append(r.doc_id)
    return {"canaries": sorted(canaries), "fingerprints": by_k, "shards": shards}


def commit_batch(records: DataFrame, side: dict[str, DataFrame], path: str, batch_id: int, branch: str = "branch", offset: str = "ledger_offset") -> DataFrame:
    """Commit a batch: side tables first, the ledger last. What the ledger lacks did not happen, whatever the side tables hold.

    ``records`` (branch, event order ``ord``, payload, …) are chained to the branch's head, a task's rows in order and an Arrow batch at a time; committing a batch
    again changes nothing. Returns the batch as it is in the ledger.
    """
    spark = records.sparkSession
    target = f"{path}/ledger"
    for name, rows in side.items():
        append_records(rows, f"{path}/{name}", batch_id)
    before = spark.read.parquet(target).where(F.col("batch_id") < batch_id) if _exists(spark, target) else None
    heads = before.groupBy(branch).agg(F.max(F.struct(offset, "record_hash")).alias("head")).select(F.col(branch).alias("_b"), "head") if before is not None else None
    d = records.join(small(heads), records[branch] == heads["_b"], "left").drop("_b") if heads is not None else records.withColumn("head", F.lit(None).cast(f"struct<{offset}: bigint, record_hash: string>"))
    d = d.withColumns({"_at": F.coalesce(F.col(f"head.{offset}"), F.lit(0)).cast("long"), "_head": F.coalesce("head.record_hash", F.lit(GENESIS))}).drop("head")

    def chain(state: tuple[int, str] | None, rows: pd.DataFrame) -> tuple[tuple[int, str], pd.DataFrame]:
        at, head = state or (int(rows["_at"].iloc[0]), rows["_head"].iloc[0])
        before, own = [], []
        for payload in rows["payload"]:
            before.append(head)
            head = ledger.link_text(head, payload)
            own.append(head)
        out = rows.drop(columns=["ord", "_at", "_head"])
        out.insert(1, offset, range(at + 1, at + 1 + len(rows)))
        return (at + len(rows), head), out.assign(prev_record_hash=before, record_hash=own)

    kept = [f for f in records.schema.fields if f.name not in (branch, "ord")]
    schema = StructType([records.schema[branch], StructField(offset, LongType()), *kept, StructField("prev_record_hash", StringType()), StructField("record_hash", StringType())])
    chained = ledger.in_order(d.select(branch, *[f.name for f in kept], "ord", "_at", "_head"), branch, "ord", lambda: None, chain, schema)
    append_records(chained, target, batch_id)
    return spark.read.parquet(target).where(F.col("batch_id") == batch_id)


def append_trace(trace: DataFrame, path: str, step: str, line: Column, order: list[str]) -> DataFrame:
    """Append a trace as CSV with a header and return each step's hash, which its ledger record carries."""
    trace.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return trace_hash(trace, step, line, order)


def forensic_copy(spark: SparkSession, path: str, folder: str) -> str:
    """A byte copy of a file or folder under the next free number; copies are never overwritten."""
    fs, hadoop = _file_system(spark, path)
    name, number = path.rstrip("/").rsplit("/", 1)[-1], 1
    while fs.exists(hadoop.fs.Path(f"{folder}/{name}.{number:03d}")):
        number += 1
    target = f"{folder}/{name}.{number:03d}"
    hadoop.fs.FileUtil.copy(fs, hadoop.fs.Path(path), fs, hadoop.fs.Path(target), False, spark.sparkContext._jsc.hadoopConfiguration())
    return target


class RunLog:
    """A log of lines with their time, written through at once; checks are PASS or FAIL lines."""

    def __init__(self, out: TextIO) -> None:
        self.out = out

    def log(self, text: str) -> None:
        self.out.write(f"{datetime.datetime.now(datetime.UTC).isoformat(timespec='milliseconds')} {text}\n")
        self.out.flush()

    def check(self, name: str, ok: bool) -> bool:
        self.log(f"{'PASS' if ok else 'FAIL'} {name}")
        return ok


def markdown(evidence: DataFrame) -> str:
    """The verifier's rows as a table for people; a requirement passes if all of its checks do."""
    rows = evidence.orderBy("requirement", "check").collect()
    out = ["| Requirement | Check | Checked | Violations | Result |", "|---|---|---|---|---|"]
    out += [f"| {r.requirement} | {r.check} | {r.n_checked} | {r.n_bad} | {'PASS' if r.ok else 'FAIL'} |" for r in rows]
    failed = sorted({r.requirement for r in rows if not r.ok})
    return "\n".join([*out, "", "All requirements pass." if rows and not failed else f"Failed: {', '.join(failed) or 'nothing was checked'}.", ""])
