import io
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curator.functions import hashing
from curator.operators import ledger, selection
from curator.operators import mixture as M
from curator.operators import streams as S
from curator.plans.mixture import schedule
from curator.sources import readers, writers


def test_settings_and_schedules(spark, tmp_path):
    want = {"steps": int, "seed": int}
    assert readers.config('{"steps": 3, "seed": 1}', want) == {"steps": 3, "seed": 1}
    for bad in ('{"steps": 3}', '{"steps": 3, "seed": "1"}', '{"steps": 3, "seed": 1, "x": 0}'):
        with pytest.raises(ValueError):
            readers.config(bad, want)
    path = str(tmp_path / "schedule")
    writers.write_json_lines(schedule(spark).select("step", "stage", "lane", "base_window", "row_len", "quota"), path)
    got = readers.schedule_table(spark, path)
    assert got.count() == 42 * 7 and got.agg(F.sum("quota")).first()[0] == sum(q.quota for q in M.compile_quotas(M.default_plan()))


def test_schedule_hash_leaves_blocked_sources_out(spark):
    s = schedule(spark)
    h = lambda x: S.schedule_hash(x, ["step", "lane"])
    assert h(s) == h(s.repartition(5).withColumn("blocked_sources", F.lit("src3"))) != h(s.withColumn("quota", F.col("quota") + 1))


def test_names_that_follow_from_content(spark):
    assert hashing.transform_id({"a": 1, "b": 2}, "1", "code") == hashing.transform_id({"b": 2, "a": 1}, "1", "code") != hashing.transform_id({"a": 1, "b": 2}, "1", "code ")
    assert hashing.array_bytes([1, 256], "u2") == b'{"dtype":"u2","shape":[2]}\x01\x00\x00\x01'
    d = spark.createDataFrame([("8192 base", [1, 2], [1]), ("none", [1], [2, 1]), (None, [], [])], "t string, a array<int>, b array<int>")
    got = d.select(hashing.leading_integer(F.col("t")).alias("n"), hashing.sha256_arrays((F.col("a"), "u2"), (F.col("b"), "u2")).alias("h")).collect()
    assert [r.n for r in got] == [8192, None, None] and len({r.h for r in got}) == 3


def test_functions_of_modules(spark):
    d = spark.createDataFrame([("m", "x = 1\ndef f(a):\n    return a\n\nclass C:\n    def g(self): ...\n"), ("broken", "def ("), ("none", None)], "module string, text string")
    assert [(r.module, r.function, r.text) for r in readers.functions_of(d).collect()] == [("m", "f", "def f(a):\n    return a")]


def test_binary_shards_and_independent_hashes(spark, tmp_path):
    d = spark.createDataFrame([("s1", [1, 65535, 3], [0, 1, 1]), ("s2", [7], [1])], "shard_id string, tokens array<int>, elig array<int>")
    path = str(tmp_path / "b")
    writers.write_binary_shards(d, path)
    got = {r.shard_id: r for r in readers.binary_shards(spark, path).collect()}
    assert (got["s1"].tokens, got["s1"].elig, got["s2"].tokens) == ([1, 65535, 3], [0, 1, 1], [7])
    with pytest.raises(writers.ImmutableError):
        writers.write_binary_shards(d, path)
    files = spark.read.format("binaryFile").load(path)
    own = {r.path: r.sha256 for r in readers.plain_hashes(files).collect()}
    assert own == {r.path: r.sha256 for r in readers.hashed_files(spark, path).collect()} and len(own) == 4


def test_manifests_and_registry(spark):
    files = spark.createDataFrame([("a", "1", "t"), ("b", "2", "t"), ("c", "3", "other"), ("d", "4", "t")], "shard_id string, sha256 string, tokenizer_id string")
    registry = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("e", "5")], "shard_id string, manifest_sha256 string")
    assert {r.shard_id: r.problem for r in readers.manifests(files, registry, "t").collect()} == {"b": "manifest_changed", "c": "other_tokenizer", "d": "not_registered", "e": "manifest_missing"}
    with pytest.raises(readers.IntegrityError):
        readers.open_registry(registry, "0", lambda r: str(r.count()))
    assert readers.open_registry(registry, "4", lambda r: str(r.count())) is registry


def test_a_crash_before_the_ledger_leaves_no_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    rows = lambda *r: spark.createDataFrame(list(r), "branch long, ord long, payload string")
    side = spark.createDataFrame([(0, 1)], "branch long, event_id long")
    writers.commit_batch(rows((0, 1, "a"), (0, 2, "b")), {"decisions": side}, path, 0)
    write = writers.append_records

    def crash(records, target, batch_id, branch="branch"):
        if target.endswith("/ledger"):
            raise RuntimeError("stopped")
        write(records, target, batch_id, branch)

    monkeypatch.setattr(writers, "append_records", crash)
    with pytest.raises(RuntimeError):
        writers.commit_batch(rows((0, 3, "c")), {"decisions": side}, path, 1)
    monkeypatch.setattr(writers, "append_records", write)
    assert spark.read.parquet(f"{path}/ledger").count() == 2 and spark.read.parquet(f"{path}/decisions").count() == 2
    for _ in range(2):  # again, and once more: the batch is there once
        writers.commit_batch(rows((0, 3, "c"), (1, 1, "z")), {"decisions": side}, path, 1)
    got = spark.read.parquet(f"{path}/ledger")
    assert [(r.branch, r.n_valid, r.first_bad) for r in ledger.verify(got).orderBy("branch").collect()] == [(0, 3, None), (1, 1, None)]
    assert spark.read.parquet(f"{path}/decisions").count() == 2


def test_a_crash_within_a_record(spark, tmp_path):
    r = ledger.build(spark.createDataFrame([(0, i, f"p{i}") for i in range(1, 6)], "branch long, ledger_offset long, payload string"))
    lines = [json.dumps(x.asDict()) for x in r.orderBy("ledger_offset").collect()]
    (tmp_path / "l").write_text("\n".join([*lines[:4], lines[4][: len(lines[4]) // 2]]))
    records, torn = readers.ledger_file(spark, str(tmp_path / "l"))
    assert [x.torn_bytes for x in torn.collect()] == [len(lines[4]) // 2]
    v = ledger.verify(records).first()
    assert (v.n_records, v.n_valid, v.first_bad) == (4, 4, None)


def test_copies_logs_and_reports(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("1\n")
    first = writers.forensic_copy(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "copies"))
    (tmp_path / "x.jsonl").write_text("2\n")
    second = writers.forensic_copy(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "copies"))
    assert (first[-4:], second[-4:]) == (".001", ".002") and open(first).read() == "1\n"
    out = io.StringIO()
    log = writers.RunLog(out)
    log.log("begun")
    assert log.check("one", True) and not log.check("two", False)
    assert [x.split(" ", 1)[1] for x in out.getvalue().splitlines()] == ["begun", "PASS one", "FAIL two"]
    e = spark.createDataFrame([("R1", "a", 3, 0, True), ("R2", "b", 3, 1, False)], "requirement string, check string, n_checked long, n_bad long, ok boolean")
    text = writers.markdown(e)
    assert "| R1 | a | 3 | 0 | PASS |" in text and "Failed: R2." in text
    assert "All requirements pass." in writers.markdown(e.where("ok")) and "nothing was checked" in writers.markdown(e.where("false"))


def test_planning_with_gates_and_previews():
    rows = pd.DataFrame({"idx": range(12), "score": [1 - i / 100 for i in range(12)]})
    steps = [(s, 1, 3) for s in range(1, 5)]
    got = selection.plan_lane(rows, steps, blocked=frozenset([1, 4]), kinds={1: ("main", 128), 2: ("main", 128), 3: ("main", 256), 4: ("main", 256)})
    reasons = got.groupby("idx").reason.agg(list).to_dict()
    assert reasons[1] == reasons[4] == ["eval_firewall"]
    # 2 is deferred at step 1 and accepted at step 2; 5 is deferred at step 2 and comes back to longer rows
    assert reasons[2] == ["marginal_utility", "opus_selected"] and reasons[5] == ["marginal_utility", "stage_mismatch"]
    for s in range(1, 5):
        ahead = selection.preview(rows, steps, s)
        whole = selection.plan_lane(rows, steps)
        assert ahead.equals(whole[whole["step"] == s].reset_index(drop=True))
