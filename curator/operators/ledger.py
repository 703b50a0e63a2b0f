"""Append-only, hash-chained ledgers: building, verification, recovery, replay, forks, checkpoints.

A ledger has one record for each step of a branch. Building a chain is sequential within a branch; checking one is not:
every record is compared with its neighbour, and the first that fails ends the valid prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from curator.functions.hashing import GENESIS
from curator.operators.sized import small


class LedgerError(Exception):
    """A chain is broken, or a checkpoint does not belong to it."""


def link(prev: Column, payload: Column) -> Column:
    """Hash of a record from its predecessor's hash and its own canonical payload."""
    return F.sha2(F.concat_ws("|", prev, payload), 256)


def link_text(prev: str, payload: str) -> str:
    """``link`` of texts at hand."""
    return hashlib.sha256(f"{prev}|{payload}".encode()).hexdigest()


def in_order(df: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]], schema: StructType) -> DataFrame:
    """A fold over each ``key`` in ``order``: a task reads its keys' rows sorted, a batch at a time, and holds the state and one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, start()
        for batch in batches:
            for value, part in batch.groupby(key, sort=False):
                if at is None or value != at:
                    at, state = value, start()
                state, out = step(state, part)
                if len(out):
                    yield out

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def build(records: DataFrame, branch: str = "branch", offset: str = "ledger_offset", genesis: str = GENESIS) -> DataFrame:
    """``records`` (branch, offset, payload) with prev_record_hash and record_hash; a branch is chained in one pass."""

    def chain(head: str, rows: pd.DataFrame) -> tuple[str, pd.DataFrame]:
        before, own = [], []
        for payload in rows["payload"]:
            before.append(head)
            head = link_text(head, payload)
            own.append(head)
        return head, rows.assign(prev_record_hash=before, record_hash=own)

    schema = StructType([*records.schema.fields, StructField("prev_record_hash", StringType()), StructField("record_hash", StringType())])
    return in_order(records, branch, offset, lambda: genesis, chain, schema)


def checked(ledger: DataFrame, branch: str = "branch", offset: str = "ledger_offset", genesis: str = GENESIS, first: int = 1) -> DataFrame:
    """``ledger`` with ``bad``: wrong predecessor, wrong own hash, a gap before it, or an offset that occurs twice.

    A record meets its predecessor by its offset, so a branch is checked by as many tasks as there are.
    """
    each = ledger.groupBy(F.col(branch).alias("_b"), F.col(offset).alias("_o")).agg(F.min("record_hash").alias("_hash"), F.count("*").alias("_n"))
    before = each.select(F.col("_b").alias("_pb"), (F.col("_o") + 1).alias("_po"), F.col("_hash").alias("_before"))
    near = each.join(before, (F.col("_b") == F.col("_pb")) & (F.col("_o") == F.col("_po")), "left").select("_b", "_o", "_n", "_before")
    j = ledger.join(near, (F.col(branch) == F.col("_b")) & (F.col(offset) == F.col("_o")), "left")
    due = F.when(F.col(offset) == first, F.lit(genesis)).otherwise(F.col("_before"))
    bad = (F.col("prev_record_hash") != due) | (F.col("record_hash") != link(F.col("prev_record_hash"), F.col("payload"))) | (F.col("_n") > 1) | (F.col(offset) < first)
    return j.select(*ledger.columns, F.coalesce(bad, F.lit(True)).alias("bad"))


def verify(ledger: DataFrame, branch: str = "branch", offset: str = "ledger_offset", **more) -> DataFrame:
    """(branch, n_records, first_bad, n_valid): records from the first bad one on are not trusted."""
    c = checked(ledger, branch, offset, **more)
    ends = small(c.groupBy(F.col(branch).alias("_b")).agg(F.min(F.when(F.col("bad"), F.col(offset))).alias("first_bad")))  # a row for each branch
    valid = F.count(F.when(F.col("first_bad").isNull() | (F.col(offset) < F.col("first_bad")), 1))
    g = ledger.join(ends, F.col(branch).eqNullSafe(F.col("_b"))).groupBy(branch, "first_bad").agg(F.count("*").alias("n_records"), valid.alias("n_valid"))
    return g.select(branch, "n_records", "first_bad", "n_valid")


def valid_prefix(ledger: DataFrame, branch: str = "branch", offset: str = "ledger_offset", **more) -> DataFrame:
    v = verify(ledger, branch, offset, **more).select(F.col(branch).alias("_b"), "first_bad")
    return ledger.join(v, ledger[branch] == v["_b"]).where(f"first_bad is null or {offset} < first_bad").drop("_b", "first_bad")


def recover(ledger: DataFrame, checkpoints: DataFrame, branch: str = "branch", offset: str = "ledger_offset", **more) -> DataFrame:
    """(branch, checkpoint_offset, kept, orphans, refused): what recovery to each branch's checkpoint (branch, offset, head hash) would do.

    Refused if the chain is broken, the offset lies beyond it, or the head differs. Offsets are values, so forked ledgers work as well.
    """
    v = verify(ledger, branch, offset, **more)
    c = checkpoints.select(F.col(branch).alias("_b"), F.col(offset).alias("k"), F.col("head_hash"))
    j = ledger.join(c, ledger[branch] == c["_b"])
    at = F.max(F.when(F.col(offset) == F.col("k"), F.col("record_hash")))
    g = j.groupBy(branch, "k", "head_hash").agg(F.count(F.when(F.col(offset) <= F.col("k"), 1)).alias("kept"), F.count(F.when(F.col(offset) > F.col("k"), 1)).alias("orphans"), at.alias("at"))
    g = g.join(v.select(branch, "first_bad"), branch)
    refused = F.when(F.col("first_bad").isNotNull(), "chain_broken").when(F.col("at").isNull(), "offset_beyond_ledger").when(F.col("at") != F.col("head_hash"), "head_differs")
    return g.select(branch, F.col("k").alias("checkpoint_offset"), "kept", "orphans", refused.alias("refused"))


def orphans(ledger: DataFrame, checkpoints: DataFrame, branch: str = "branch", offset: str = "ledger_offset") -> DataFrame:
    """Records after the branch's checkpoint."""
    c = checkpoints.select(F.col(branch).alias("_b"), F.col(offset).alias("_k"))
    return ledger.join(c, (ledger[branch] == c["_b"]) & (ledger[offset] > c["_k"])).drop("_b", "_k")


def resume(ledger: DataFrame, checkpoints: DataFrame, side: DataFrame, declared: DataFrame, again: DataFrame, attempt: int = 1, branch: str = "branch", offset: str = "ledger_offset", **more) -> DataFrame:
    """One row for each branch: what recovery to its checkpoint keeps and drops of the ledger and of a ``side`` ledger, the new attempt, and
    whether the first record ``again`` after it is the ``declared`` one (branch, declared hash) and the one from before the crash."""
    r = recover(ledger, checkpoints, branch, offset, **more)
    at = checkpoints.select(F.col(branch).alias("_b"), F.col(offset).alias("_k"))
    dropped = side.join(at, (side[branch] == at["_b"]) & (side[offset] > at["_k"])).groupBy("_b").agg(F.count("*").alias("side_dropped"))
    first = lambda d, name: d.join(at, (d[branch] == at["_b"]) & (d[offset] == at["_k"] + 1)).select("_b", F.col("record_hash").alias(name))
    out = r.join(dropped.withColumnRenamed("_b", branch), branch, "left").join(declared.select(branch, "declared"), branch, "left")
    out = out.join(first(ledger, "before").withColumnRenamed("_b", branch), branch, "left").join(first(again, "now").withColumnRenamed("_b", branch), branch, "left")
    same = lambda c: F.coalesce(F.col("now") == F.col(c), F.lit(False))
    return out.select(branch, "checkpoint_offset", "kept", "orphans", F.coalesce("side_dropped", F.lit(0)).cast("long").alias("side_dropped"), F.lit(attempt + 1).alias("attempt"), "refused", same("declared").alias("as_declared"), same("before").alias("as_before"))


def truncate(side: DataFrame, step: str, most: int) -> DataFrame:
    """A side ledger up to a step."""
    return side.where(F.col(step) <= most)


def stream_fingerprint(batches: DataFrame, branch: str, order: str, genesis: str = GENESIS) -> DataFrame:
    """(branch, fingerprint): fold of (batch id, batch hash) in order. The fold after each batch is the running fingerprint; the last is the branch's."""

    def fold(state: str, rows: pd.DataFrame) -> tuple[str, pd.DataFrame]:
        for batch, h in zip(rows[order], rows["batch_hash"]):
            state = link_text(state, f"{batch}:{h}")
        return state, pd.DataFrame({branch: [rows[branch].iloc[0]], "at": [rows[order].iloc[-1]], "fingerprint": [state]})

    schema = StructType([batches.schema[branch], StructField("at", batches.schema[order].dataType), StructField("fingerprint", StringType())])
    running = in_order(batches.select(branch, order, "batch_hash"), branch, order, lambda: genesis, fold, schema)
    return running.groupBy(branch).agg(F.max_by("fingerprint", "at").alias("fingerprint"))


def batch_hashes(ledger: DataFrame, branch: str, batch: Column, offset: str = "ledger_offset") -> DataFrame:
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(offset, "record_hash"))), lambda x: x["record_hash"]), ",")
    return ledger.groupBy(branch, batch.alias("batch")).agg(F.sha2(parts, 256).alias("batch_hash"), F.count("*").alias("n_records"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Records of two runs that differ: key, what is missing or which fields differ."""
    x = a.select(*keys, F.struct(*fields).alias("x"), F.lit(True).alias("in_a"))
    y = b.select(*keys, F.struct(*fields).alias("y"), F.lit(True).alias("in_b"))
    j = x.join(y, keys, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.lit(f)) for f in fields]))
    why = F.when(F.col("in_b").isNull(), "only_first").when(F.col("in_a").isNull(), "only_second").when(F.size(differ) > 0, F.array_join(differ, ","))
    return j.select(*keys, why.alias("difference")).where("difference is not null")


def bind(checkpoints: DataFrame, ledger: DataFrame, branch: str = "branch", offset: str = "ledger_offset") -> DataFrame:
    """``checkpoints`` (branch, offset, head_hash) with whether the head is the ledger's and the hash of the next record."""
    w = Window.partitionBy(branch).orderBy(offset)
    near = ledger.select(F.col(branch).alias("_b"), F.col(offset).alias("_o"), "record_hash", F.lead("record_hash").over(w).alias("next_hash"))
    j = checkpoints.join(near, (checkpoints[branch] == near["_b"]) & (checkpoints[offset] == near["_o"]), "left")
    return j.select(branch, offset, F.coalesce(F.col("record_hash") == F.col("head_hash"), F.lit(False)).alias("bound"), "next_hash")


def torn_tail(content: Column) -> Column:
    """Bytes after the last line feed of a ledger file: a record that was not committed."""
    return F.length(content) - F.length(F.regexp_replace(content, r"(?s)[^\n]*\z", ""))
