"""Arrays of words by Arrow batches: counted, looked up and searched for n-grams, without a row for each word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Words of which a worker makes arrays at a time; one longer row is a piece of its own.
PIECE = 250_000
#: Limits of an Arrow batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000}
#: N-grams that workers hold at a time.
GRAMS = 200_000
#: A fixed odd number whose powers tell the words of an n-gram apart.
BASE = 0x9E3779B97F4A7C15


def limit_batches(spark: SparkSession) -> None:
    """Lower the session's limits of an Arrow batch where they are higher: Spark reads them when a plan runs."""
    for name, most in BATCH.items():
        now = spark.conf.get(name).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def offsets(lists: pa.Array) -> np.ndarray:
    """Each row's first item among all of ``lists.flatten()``, one more than rows; a null row has none."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])


def pieces(batch: pa.RecordBatch, column: str = "w") -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Runs of rows of about ``PIECE`` words, with their words and offsets."""
    off = offsets(batch.column(column))
    cuts = [0, *(np.flatnonzero(np.diff(off[:-1] // PIECE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part, part.column(column).flatten(), off[a : b + 1] - off[a]


def in_pieces(docs: DataFrame, run: Callable[[pa.RecordBatch, pa.Array, np.ndarray], dict | None], schema: StructType) -> DataFrame:
    limit_batches(docs.sparkSession)
    names = schema.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = run(*piece)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return docs.mapInArrow(each, schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) over all of ``docs.w``: words are counted by pieces before they are rows."""

    def run(_: pa.RecordBatch, words: pa.Array, off: np.ndarray) -> dict:
        c = pc.value_counts(words)
        return {"word": c.field("values"), "count": c.field("counts")}

    schema = StructType([StructField("word", StringType()), StructField("count", LongType())])
    return in_pieces(docs.select("w"), run, schema).groupBy("word").agg(F.sum("count").alias("count"))


def unknown_counts(docs: DataFrame, known: list[str]) -> DataFrame:
    """(doc_id, n_words, n_unk): the words of each row of ``docs`` (doc_id, w), and those that ``known`` lacks."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(rows: pa.RecordBatch, words: pa.Array, off: np.ndarray) -> dict:
        missing = ~pc.is_in(words, value_set=pa.array(held.value, pa.string())).to_numpy(zero_copy_only=False)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(missing, dtype=np.int64)])
        return {"doc_id": rows.column("doc_id"), "n_words": pa.array(np.diff(off)), "n_unk": pa.array(total[off[1:]] - total[off[:-1]])}

    schema = StructType([docs.schema["doc_id"], StructField("n_words", LongType()), StructField("n_unk", LongType())])
    return in_pieces(docs.select("doc_id", "w"), run, schema)


class Grams:
    """N-grams (k, h, text) to be looked for. The words of a text are numbered by the n-grams' own words, 0 being any other; n-grams are then
    runs of numbers without 0, which meet by a hash of the run and are told by their words."""

    def __init__(self, grams: list[tuple[int, str, str]]) -> None:
        self.texts = {text: (k, h) for k, h, text in grams}
        self.words = pa.array(sorted({w for text in self.texts for w in text.split(" ")}), pa.string())
        self.sizes = sorted({k for k, _ in self.texts.values()})
        by_size = {k: pa.array([t.split(" ") for t, (n, _) in self.texts.items() if n == k]) for k in self.sizes}
        self.hashes = {k: np.unique(self.hashed(self.numbers(g.flatten()), k)[::k]) for k, g in by_size.items()}

    def numbers(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.add(pc.index_in(words, value_set=self.words), 1), 0).to_numpy(zero_copy_only=False).astype(np.uint64)

    @staticmethod
    def hashed(numbers: np.ndarray, k: int) -> np.ndarray:
        """A hash of the run of k numbers from each place on."""
        out = np.zeros(max(len(numbers) - k + 1, 0), np.uint64)
        for j in range(k):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(BASE) + numbers[j : j + len(out)]
        return out

    def found(self, words: pa.Array, off: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """(row, k, h) of the n-grams in each row, each once."""
        numbers = self.numbers(words)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        unknown = np.concatenate([np.zeros(1, np.int64), np.cumsum(numbers == 0)])
        seen = set()
        for k in self.sizes:
            if len(numbers) < k:
                continue
            at = np.flatnonzero((unknown[k:] == unknown[:-k]) & (row[k - 1 :] == row[: len(row) - k + 1]))
            if not len(at):
                continue
            own = self.hashed(numbers, k)[at]
            for i in at[np.isin(own, self.hashes[k])].tolist():
                hit = self.texts.get(" ".join(words.slice(i, k).to_pylist()))
                if hit and (int(row[i]), *hit) not in seen:
                    seen.add((int(row[i]), *hit))
                    yield int(row[i]), *hit


def gram_hits(docs: DataFrame, grams: list[tuple[int, str, str]]) -> DataFrame:
    """(doc_id, k, h) of the n-grams ``grams`` (k, h, words joined by blanks) in ``docs`` (doc_id, w)."""
    held, made = docs.sparkSession.sparkContext.broadcast(grams), {}

    def run(rows: pa.RecordBatch, words: pa.Array, off: np.ndarray) -> dict | None:
        if "grams" not in made:
            made["grams"] = Grams(held.value)
        hits = list(made["grams"].found(words, off))
        if not hits:
            return None
        row, k, h = zip(*hits)
        return {"doc_id": rows.column("doc_id").take(pa.array(row)), "k": pa.array(k, pa.int32()), "h": pa.array(h)}

    schema = StructType([docs.schema["doc_id"], StructField("k", IntegerType()), StructField("h", StringType())])
    return in_pieces(docs.select("doc_id", "w"), run, schema)
