import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from curator.sources import readers, writers
from curator.streaming import ledgers


def test_corpora_and_message_text(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "1", "text": "a b"}\n\n{"doc_id": "2", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "tool_call": "{}"}]}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"doc_id": "3", "text": "c", "license": "mit"}\n')
    d = readers.corpora(spark, {"a": str(tmp_path / "a.jsonl"), "b": str(tmp_path / "b.jsonl.gz")})
    got = {r.doc_id: (r.source, r.t) for r in d.withColumn("t", readers.message_text()).collect()}
    assert got == {"1": ("a", "a b"), "2": ("a", "hi\n{}"), "3": ("b", "c")}


def test_contract():
    assert readers.contract("stages:\n  s: {seq_len: '8192 base; more'}\n  t: {seq_len: 4096}\n")["stages"] == {"s": {"seq_len": 8192}, "t": {"seq_len": 4096}}


def test_torn_tail(spark, tmp_path):
    line = json.dumps({"ledger_offset": 1, "branch": 0, "payload": "p", "prev_record_hash": "0", "record_hash": "1"})
    (tmp_path / "l.jsonl").write_text(f"{line}\n{line[:20]}")
    records, torn = readers.ledger_file(spark, str(tmp_path / "l.jsonl"))
    assert [r.ledger_offset for r in records.collect()] == [1]
    assert [r.torn_bytes for r in torn.collect()] == [20]


def test_hashes(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\r\nb")
    f = readers.hashed_files(spark, str(tmp_path / "x.txt"))
    row = f.first()
    assert (row.sha256, row.text_sha256) == (hashlib.sha256(b"a\r\nb").hexdigest(), hashlib.sha256(b"a\nb").hexdigest())
    readers.require_hashes(f, spark.createDataFrame([("x.txt", row.sha256)], "path string, sha256 string"))
    with pytest.raises(readers.IntegrityError):
        readers.require_hashes(f, spark.createDataFrame([("x.txt", "0")], "path string, sha256 string"))


def test_csv_and_slices(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x ""y"", z"\n')
    assert [tuple(r) for r in readers.csv_trace(spark, str(tmp_path / "t.csv"), "a int, b string").collect()] == [(1, 'x "y", z')]
    docs = spark.createDataFrame([("s", "d", [1, 2, 3], [0, 1, 1])], "shard_id string, doc_id string, tokens array<int>, elig array<int>")
    got = readers.document_slices(spark.createDataFrame([("s", "d", 1, 3)], "shard_id string, doc_id string, start int, end int"), docs).first()
    assert (got.tokens, got.elig) == ([2, 3], [1, 1])


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), "shard_id string, content_hash string")
    assert writers.store_once(rows(("a", "1")), path) == {"written": 1, "identical_existing": 0}
    assert writers.store_once(rows(("a", "1"), ("b", "2")), path) == {"written": 1, "identical_existing": 1}
    with pytest.raises(writers.ImmutableError):
        writers.store_once(rows(("a", "9")), path)
    assert spark.read.parquet(path).count() == 2


def test_partitions_prune(spark, tmp_path):
    path = str(tmp_path / "shards")
    d = spark.range(20).select("id", F.lit("train").alias("split"), F.when(F.col("id") < 10, "web").otherwise("code").alias("lane"), F.lit("main").alias("pool"), F.lit("all").alias("subpool"), F.lit("s").alias("shard_id"), F.col("id").alias("doc_id"))
    writers.write_shards(d, path)
    web = readers.shards_where(spark.read.parquet(path), lane="web")
    assert web.count() == 10
    assert "PartitionFilters: [isnotnull(lane" in web._jdf.queryExecution().executedPlan().toString()


def test_idempotent_append_and_checkpoints(spark, tmp_path):
    path = str(tmp_path / "ledger")
    r = spark.createDataFrame([(1, "a")], "offset long, payload string")
    for batch in (1, 1, 2):
        writers.append_records(r, path, batch)
    assert spark.read.parquet(path).count() == 2
    meta = {"branch": "main", "step": 7, "head_hash": "h"}
    writers.save_checkpoint(meta, str(tmp_path / "c"), spark)
    writers.save_checkpoint(meta | {"step": 14}, str(tmp_path / "c"), spark)
    with pytest.raises(writers.ImmutableError):
        writers.save_checkpoint(meta, str(tmp_path / "c"), spark)
    assert readers.latest_checkpoint(readers.checkpoint_table(spark, str(tmp_path / "c"))).first().step == 14


def test_registry(spark):
    m = spark.createDataFrame([("a", "train", "1", 5, 1), ("b", "test", "2", 6, 1)], "shard_id string, split string, content_hash string, token_count long, n_documents long")
    r = writers.registry(m)
    assert {x.shard_id: (x.train, x.eval_read) for x in r.collect()} == {"a": (True, False), "b": (False, True)}
    assert writers.registry_hash(r) != writers.registry_hash(r.where("shard_id = 'a'"))


def test_ledger_stream_goes_on_after_a_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "branch long, order string, event_id long, payload string"

    def add(ids):
        spark.createDataFrame([(i % 2, f"{i:05d}", i, f"p{i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        s = spark.readStream.schema(schema).parquet(str(src))
        return ledgers.run_available(ledgers.ledger_stream(s), str(tmp_path / "out"), str(tmp_path / "check"))

    add(range(10))
    assert run().count() == 10
    add(range(10, 20))
    rows = run().collect()
    assert len(rows) == 20
    h = "0" * 64
    for r in sorted((r for r in rows if r.branch == 0), key=lambda r: r.ledger_offset):
        h = hashlib.sha256(f"{h}|p{r.event_id}".encode()).hexdigest()
        assert r.record_hash == h
