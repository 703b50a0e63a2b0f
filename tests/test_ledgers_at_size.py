import hashlib
import json

from pyspark.sql import functions as F

from curator.operators import audit
from curator.operators import ledger as L
from curator.sources import readers, writers
from curator.streaming import ledgers

LINE = {"branch": 0, "prev_record_hash": "0", "record_hash": "1"}


def text(n, pad=40):
    return "".join(json.dumps(LINE | {"ledger_offset": i, "payload": "é" * pad}, ensure_ascii=False) + "\n" for i in range(1, n + 1)).encode()


def test_ledger_files_are_read_by_blocks(spark, tmp_path):
    """a file of several blocks is several tasks' work; the last line alone is torn, though it equals a whole one or ends inside a character."""
    a, b, c = text(3000), text(1), text(2)
    (tmp_path / "a").write_bytes(a + b[:-1])
    (tmp_path / "b").write_bytes(b + c[: c.index("é".encode()) + 1])
    (tmp_path / "c").write_bytes(c)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        records, torn = readers.ledger_file(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 4
        assert records.count() == 3003 and records.where("ledger_offset is null").count() == 0
        assert sorted(r.torn_bytes for r in torn.collect()) == sorted([len(b) - 1, c.index("é".encode()) + 1])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_batch_is_committed_in_arrow_batches(spark, tmp_path, monkeypatch):
    """no function sees all of a branch's rows at once."""
    seen, fold = [], L.in_order
    monkeypatch.setattr(L, "in_order", lambda *a, **b: (seen.append(a[1:3]), fold(*a, **b))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = lambda low, high: spark.range(low, high).select((F.col("id") % 2).alias("branch"), F.col("id").alias("ord"), F.concat(F.lit("p"), "id").alias("payload"), F.col("id").alias("event_id")).repartition(5)
        for batch, low, high in ((0, 0, 50), (1, 50, 100), (1, 50, 100)):
            writers.commit_batch(rows(low, high), {}, str(tmp_path), batch)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.parquet(f"{tmp_path}/ledger")
    assert seen == [("branch", "ord")] * 3
    assert [(r.branch, r.n_records, r.n_valid) for r in L.verify(got).orderBy("branch").collect()] == [(0, 50, 50), (1, 50, 50)]
    assert got.where("payload <> concat('p', event_id) or event_id <> (ledger_offset - 1) * 2 + branch").count() == 0


def test_a_stream_is_chained_in_arrow_batches(spark, tmp_path, monkeypatch):
    """a stream's batch is sorted by Spark, not by a function that holds a branch."""
    seen, fold = [], L.in_order
    monkeypatch.setattr(L, "in_order", lambda *a, **b: (seen.append(a[1:3]), fold(*a, **b))[1])
    schema = "branch long, order string, event_id long, payload string"
    spark.createDataFrame([(0, f"{i:05d}", i, f"p{i}") for i in range(40)], schema).repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows = ledgers.run_available(ledgers.ledger_stream(s), str(tmp_path / "out"), str(tmp_path / "check")).orderBy("ledger_offset").collect()
    h = "0" * 64
    for i, r in enumerate(rows):
        h, before = hashlib.sha256(f"{h}|p{i}".encode()).hexdigest(), h
        assert (r.ledger_offset, r.event_id, r.prev_record_hash, r.record_hash) == (i + 1, i, before, h)
    assert seen == [("branch", "ord")] and len(rows) == 40


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_span_meets_all_checkpoints(spark):
    """neither question carries an array of a branch's checkpoints."""
    spans = spark.range(400).select((F.col("id") % 2).alias("branch"), F.floor(F.col("id") / 10).alias("step"), (F.col("id") % 7).alias("doc_id"), F.lit(3).alias("n_tokens"), F.lit(1).alias("n_loss"))
    spans = spans.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("branch"), F.lit(5).cast("long").alias("step"), F.lit(None).cast("long").alias("doc_id"), F.lit(100).alias("n_tokens"), F.lit(0).alias("n_loss")))
    marks = spark.createDataFrame([(b, c) for b in (0, 1) for c in (0, 5, 17, 99)], "branch long, checkpoint long")
    got = audit.behind_checkpoints(spans, marks, "branch", "step")
    want = {(b, c): (len(x) * 3 + 100 * (b == 0 and c >= 5), len(x), len({i % 7 for i in x})) for b in (0, 1) for c in (0, 5, 17, 99) for x in [[i for i in range(400) if i % 2 == b and i // 10 <= c]]}
    assert {(r.branch, r.checkpoint): (r.tokens, r.loss_tokens, r.docs) for r in got.collect()} == want
    steps = spark.createDataFrame([(0, s) for s in (0, 1, 5, 6, 99, 100)] + [(1, 3), (2, 1), (None, 1)], "branch long, step long")
    next_ = audit.following_checkpoint(steps, marks, "branch", "step")
    assert {(r.branch, r.step): r.checkpoint for r in next_.collect()} == {(0, 0): 0, (0, 1): 5, (0, 5): 5, (0, 6): 17, (0, 99): 99, (0, 100): None, (1, 3): 5, (2, 1): None, (None, 1): None}
    assert "filter(" not in plan(got) + plan(next_)
