"""Queries opN_<name> and pipeline over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from curator.llm.bpe import encode_and_decode
from curator.llm.decontaminate import search
from curator.llm.exact_dedup import exact_dedup
from curator.llm.html_text import main_text
from curator.llm.language import identify
from curator.llm.simhash import near_duplicates
from curator.llm.substring_dedup import substring_dedup
from curator.llm.token_counts import count_sampled_edits
from curator.llm.toxicity import detect
from curator.llm.url_filter import judge

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The url rules of the contract: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of the whole ``documents`` table."""
    return exact_dedup(_read(spark, sf_dir, "documents")).drop("tie")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text of the ``documents`` table."""
    return detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of the ``pages`` table."""
    return main_text(_read(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the whole ``documents`` table before and after three edits a document."""
    return count_sampled_edits(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of the ``documents`` table."""
    return identify(_read(spark, sf_dir, "documents")).drop("tie")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of the whole ``documents`` table by SimHash."""
    return near_duplicates(_read(spark, sf_dir, "documents")).drop("tie")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of the whole ``documents`` table."""
    return encode_and_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages in the whole ``documents`` table: a row for each document and item."""
    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("tie")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every url of the whole ``pages`` table."""
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS t(host, path, verdict)")
    return judge(_read(spark, sf_dir, "pages"), rules)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long repeated passages of the whole ``documents`` table."""
    return substring_dedup(_read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
    FROM documents
), r AS (
    SELECT doc_id, norm, length(text) AS n,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size
    FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

OP9_SQL = r"""
WITH u AS (
    SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, row_number() OVER () AS k
    FROM h
), rules(rhost, rpath, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fit AS (
    SELECT p.k, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
    FROM p JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY p.k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (k)
"""

OP10_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS s
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM windows) WHERE c > 1
), each AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w
), kept AS (
    SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS txt, count(*) AS n
    FROM each e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.txt, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, one after the other."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_html_text, op4_token_counts, op5_language, op6_simhash, op7_bpe, op8_decontaminate, op9_url_filter, op10_substring_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    """SQL cannot express the others; their tests compare them with brute force, round trips or held-out labels."""
    return {"op1_exact_dedup": OP1_SQL, "op9_url_filter": OP9_SQL, "op10_substring_dedup": OP10_SQL}
