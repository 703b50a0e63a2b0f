"""Readers with declared schemas: JSON lines, corpora, contracts, ledgers, CSV traces, hashed files, checkpoints."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curator.scratch import materialize

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("tool_call", T.StringType())])
DOCUMENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("doc_id", "source", "source_id", "license", "language", "lane_hint", "title", "text")]
    + [T.StructField("a4_admitted", T.BooleanType()), T.StructField("tool_calls", T.IntegerType()), T.StructField("messages", T.ArrayType(MESSAGE))]
)
EVAL_ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "split", "benchmark_id", "item_id", "version", "text", "language", "license", "source_id")])


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line, lines end at a line feed only; gzip files are read as well. Lines that do not parse raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def corpora(spark: SparkSession, sources: dict[str, str], schema: T.StructType = DOCUMENT) -> DataFrame:
    """Documents of several sources with the source's name; fields a source lacks are null."""
    parts = [json_lines(spark, path, schema).withColumn("source", F.lit(name)) for name, path in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def message_text(messages: str = "messages", text: str = "text"):
    """A document's text: its own, or its turns' contents (or tool calls, as JSON) joined by line feeds."""
    turns = F.transform(messages, lambda m: F.coalesce(m["tool_call"], m["content"], F.lit("")))
    return F.coalesce(F.col(text), F.array_join(turns, "\n"))


def contract(text: str) -> dict[str, Any]:
    """A mixture contract from YAML; row lengths given as text keep their leading number."""
    c = yaml.safe_load(text)
    for stage in c.get("stages", {}).values():
        digits = str(stage["seq_len"]).split()[0]
        stage["seq_len"] = int("".join(x for x in digits if x.isdigit()))
    return c


def csv_trace(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A trace with a header and quoted fields."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files; CRLF counts as LF in ``text_sha256``."""
    f = spark.read.format("binaryFile").load(path)
    unix = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), F.sha2(F.encode(unix, "ISO-8859-1"), 256).alias("text_sha256"))


class IntegrityError(Exception):
    """A file's content is not what was recorded of it."""


def require_hashes(files: DataFrame, recorded: DataFrame) -> None:
    """Raise unless every recorded (path, sha256) is there with the same hash."""
    r = recorded.select(F.col("path").alias("p"), F.col("sha256").alias("want"))
    bad = r.join(files, F.endswith(files["path"], r["p"]), "left").where("sha256 is null or sha256 <> want").limit(1).collect()
    if bad:
        raise IntegrityError(str(bad[0].asDict()))


LEDGER_LINE = T.StructType([T.StructField("ledger_offset", T.LongType()), T.StructField("branch", T.LongType()), T.StructField("payload", T.StringType()), T.StructField("prev_record_hash", T.StringType()), T.StructField("record_hash", T.StringType())])


def ledger_file(spark: SparkSession, path: str, schema: T.StructType = LEDGER_LINE) -> tuple[DataFrame, DataFrame]:
    """(records, torn): committed records, and (path, torn_bytes) of files that end inside a record.

    Whole lines are committed; what follows the last line feed was being written when the writer stopped. Lines are read by blocks, no file is
    held as a whole: a file ends inside a record if its lines, with a line feed each, have one byte more than the file. The lines of such
    files are written once with their places, so that the last one is the same line for records and torn bytes.
    """
    file = lambda c: F.col(f"_metadata.{c}").alias(c)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), file("file_size"), file("file_block_start"), F.col("value").alias("line"))
    over = F.sum(F.octet_length("line") + 1) - F.col("file_size")
    cut = [r.path for r in lines.groupBy("path", "file_size").agg(over.alias("over")).where("over in (1, -2)").select("path").collect()]  # -2: a byte order mark was skipped

    def parse(d: DataFrame, ok: Column) -> DataFrame:
        whole = F.when(ok & (F.col("line") != ""), F.col("line"))  # also where a filter is asked later than the parser
        return d.where(ok & (F.col("line") != "")).select(F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")

    if not cut:
        return parse(lines, F.lit(True)), spark.createDataFrame([], "path string, torn_bytes int")
    placed = materialize(lines.where(F.col("path").isin(cut)).select("path", F.struct("file_block_start", F.monotonically_increasing_id().alias("at")).alias("place"), "line"), "ledger-lines")
    last = F.broadcast(placed.groupBy(F.col("path").alias("of")).agg(F.max("place").alias("last")))  # a row for each file
    ended = placed.join(last, F.col("path") == F.col("of"))
    records = parse(lines, ~F.col("path").isin(cut)).unionByName(parse(ended, F.col("place") < F.col("last")))
    return records, ended.where("place = last").select("path", F.octet_length("line").alias("torn_bytes"))


def checkpoint_table(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints' metadata; a checkpoint exists once its row does."""
    return spark.read.parquet(path)


def latest_checkpoint(checkpoints: DataFrame, branch: str = "branch", step: str = "step") -> DataFrame:
    """Each branch's newest checkpoint."""
    others = [c for c in checkpoints.columns if c != branch]
    return checkpoints.groupBy(branch).agg(F.max(F.struct(step, *[c for c in others if c != step])).alias("r")).select(branch, *[F.col(f"r.{c}").alias(c) for c in others])


def shards_where(registry: DataFrame, **equal: Any) -> DataFrame:
    """Registry rows that satisfy all equalities, in order of shard_id; partition columns prune the scan."""
    for k, v in equal.items():
        registry = registry.where(F.col(k) == F.lit(v))
    return registry.orderBy("shard_id")


def document_slices(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """``spans`` (shard_id, doc_id, start, end) with their tokens and eligibility from the shard documents."""
    j = spans.join(docs.select("shard_id", "doc_id", "tokens", "elig"), ["shard_id", "doc_id"])
    n = (F.col("end") - F.col("start")).cast("int")
    part = lambda c: F.slice(c, (F.col("start") + 1).cast("int"), n)
    return j.withColumns({"tokens": part("tokens"), "elig": part("elig")})


def config(text: str, schema: dict[str, type]) -> dict[str, Any]:
    """Settings from JSON; every name of ``schema`` must be there with its type, and no other."""
    values = json.loads(text)
    wrong = sorted(set(values) ^ set(schema)) or sorted(k for k, t in schema.items() if not isinstance(values[k], t))
    if wrong:
        raise ValueError(f"settings missing, unknown or of another type: {wrong}")
    return values


SCHEDULE = "step int, stage string, lane string, base_window int, row_len int, quota int"


def schedule_table(spark: SparkSession, path: str) -> DataFrame:
    """A schedule written as JSON lines, a row for each step and lane."""
    return json_lines(spark, path, T._parse_datatype_string(SCHEDULE))


def binary_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, tokens, elig, content_hash) of shards in two files each: ``<id>.tokens`` of 16-bit ids and ``<id>.elig`` of bytes, little-endian.

    The hash is made of the bytes read, so that it can be compared with a manifest's.
    """
    f = spark.read.format("binaryFile").load(path).select("path", "content")
    name = F.regexp_extract("path", r"([^/]+)\.(?:tokens|elig)$", 1)
    both = f.groupBy(name.alias("shard_id")).agg(F.max(F.when(F.endswith("path", F.lit(".tokens")), F.col("content"))).alias("t"), F.max(F.when(F.endswith("path", F.lit(".elig")), F.col("content"))).alias("e"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens = [np.frombuffer(t, "<u2").astype(np.int32) for t in b["t"]]
            yield pd.DataFrame({"shard_id": b["shard_id"], "tokens": tokens, "elig": [np.frombuffer(e, "<u1").astype(np.int32) for e in b["e"]], "content_hash": [hashlib.sha256(bytes(t) + bytes(e)).hexdigest() for t, e in zip(b["t"], b["e"])]})

    return both.mapInPandas(decode, "shard_id string, tokens array<int>, elig array<int>, content_hash string")


def manifests(files: DataFrame, registry: DataFrame, tokenizer: str) -> DataFrame:
    """(shard_id, problem) of manifests (shard_id, sha256, tokenizer_id) held against the registry (shard_id, manifest_sha256)."""
    r = registry.select(F.col("shard_id").alias("r_id"), "manifest_sha256")
    j = files.join(r, F.col("shard_id") == F.col("r_id"), "full_outer")
    problem = F.when(F.col("r_id").isNull(), "not_registered").when(F.col("shard_id").isNull(), "manifest_missing").when(F.col("sha256") != F.col("manifest_sha256"), "manifest_changed").when(F.col("tokenizer_id") != tokenizer, "other_tokenizer")
    return j.select(F.coalesce("shard_id", "r_id").alias("shard_id"), problem.alias("problem")).where("problem is not null")


def open_registry(entries: DataFrame, recorded: str, hash_of) -> DataFrame:
    """``entries`` if their hash is the recorded one."""
    found = hash_of(entries)
    if found != recorded:
        raise IntegrityError(f"registry {found} is not the recorded {recorded}")
    return entries


def functions_of(modules: DataFrame) -> DataFrame:
    """(module, function, text, file_sha256) of the top-level functions of Python modules (module, text); modules that do not parse have none."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for module, text in zip(b["module"], b["text"]):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                digest = hashlib.sha256((text or "").encode()).hexdigest()
                out += [(module, x.name, ast.get_source_segment(text, x), digest) for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
            yield pd.DataFrame(out, columns=["module", "function", "text", "file_sha256"])

    return modules.select("module", "text").mapInPandas(extract, "module string, function string, text string, file_sha256 string")


def plain_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of (path, content) by Python's own library: a reader that shares no code with ``hashed_files``."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "sha256": [hashlib.sha256(bytes(c)).hexdigest() for c in b["content"]]})

    return files.select("path", "content").mapInPandas(digest, "path string, sha256 string")
