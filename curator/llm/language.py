"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter a language, stored slot by slot: a slot holds one bit for each language, so ANDing the slots of an
n-gram's probes gives the bit mask of all languages that contain it in one look. A text's hits are counted for each
language, corrected by that filter's false-positive rate, and the largest corrected share decides.

Learning takes a bounded sample: of each language the ``per_language`` rows with the smallest hash of doc_id, picked without reading texts.
Their n-grams are counted on the executors, and the ``grams`` most frequent of each language fill its filter;
that table is all the driver sees. Slots are as many mask words wide as the languages need. The model is bounded: the ``LANGUAGES``
languages with the most rows are learned, and all filters together hold at most ``ALL_GRAMS`` n-grams.

Cases. Null texts and texts without letters are ``und`` with score 0. Equal shares go to the language first in the alphabet.
Rows without lang are predicted like others but teach nothing. With nothing to learn from, every text is ``und``.
Repeated rows are predicted as often; rows of one doc_id and language teach once, by the least of their texts. Null texts take a place in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.llm.arrow import U64, WORD_BASE, mix, slices
from curator.llm.chars import points, tables
from curator.llm.spread import drop_rows, hash_bound, map_arrow

PER_LANGUAGE, GRAMS, N, SLOT_BITS, PROBES = 400, 20_000, 4, 18, 3
#: Most languages learned, and most n-grams of all of them together.
LANGUAGES, ALL_GRAMS = 1024, 4_000_000
UNKNOWN = "und"
#: The least corrected share of known n-grams that the pipeline's filter asks for.
LEAST_SHARE = 0.1


def grams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, each text's first (one more than texts), and each text's letters.

    Letters are lower-cased; what lies between them, and the borders, is one blank.
    """
    lower, alpha, _ = tables()
    p, off = points([f"\0{t}{chr(0) * (n - 2)}" for t in texts])
    letter = alpha[p]
    edge = p == 0
    keep = letter | edge
    keep[1:] |= letter[:-1]
    c = np.where(letter, lower[p], 32)[keep].astype(U64)
    at = np.zeros(len(p) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    first = at[off]
    letters = np.add.reduceat(np.append(letter, False).astype(np.int64), off[:-1]) if len(texts) else np.zeros(0, np.int64)
    if len(c) < n:
        return np.zeros(0, U64), np.zeros(len(first), np.int64), letters
    h = c[: len(c) - n + 1].copy()
    for i in range(1, n):
        h *= U64(WORD_BASE)
        h += c[i : len(c) - n + 1 + i]
    inside = np.ones(len(h), bool)
    for k in range(1, n):  # those that would run into the next text
        at = first[1:] - k
        inside[at[(at >= 0) & (at < len(h))]] = False
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    return mix(h[inside]), total[np.minimum(first, len(h))], letters


def probes(h: np.ndarray) -> list[np.ndarray]:
    mask = U64((1 << SLOT_BITS) - 1)
    return [((h >> U64(20 * i)) & mask).astype(np.int64) for i in range(PROBES)]


@dataclass
class Filters:
    """Languages, slots with a bit for each (a plane for every 64 of them), and each language's false-positive rate."""

    names: list[str]
    planes: list[np.ndarray]
    wrong: np.ndarray

    @classmethod
    def of(cls, members: dict[str, np.ndarray]) -> Filters:
        names = sorted(members)
        planes, wrong = [], []
        for a in range(0, len(names), 64):
            some = names[a : a + 64]
            slots = np.zeros(1 << SLOT_BITS, next(t for b, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(some) <= b))
            for i, name in enumerate(some):
                for at in probes(members[name]):
                    slots[at] |= slots.dtype.type(1 << i)
            planes.append(slots)
            wrong += [_bit(slots, i).mean() ** PROBES for i in range(len(some))]
        return cls(names, planes, np.array(wrong))

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each language in each text, and each text's letters."""
        h, first, letters = grams(texts)
        out = np.zeros((len(texts), len(self.names)))
        n = np.diff(first)
        some, at = n > 0, probes(h)
        for i in range(len(self.names) if len(texts) else 0):
            slots = self.planes[i // 64]
            if i % 64 == 0:
                found = np.full(len(h), ~slots.dtype.type(0))
                for a in at:
                    found &= slots[a]
            hits = np.add.reduceat(np.append(_bit(found, i % 64), 0).astype(np.int64), first[:-1]) * some
            out[:, i] = (hits / np.maximum(n, 1) - self.wrong[i]) / (1 - self.wrong[i])
        return np.clip(out, 0, 1), letters


def _bit(masks: np.ndarray, i: int) -> np.ndarray:
    return (masks >> masks.dtype.type(i)) & masks.dtype.type(1)


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, gram, n: how often the texts (lang, text) of each language hold an n-gram.

    A worker gives one row for each different n-gram of a text, so their number follows from the texts alone and not from how
    they are dealt to tasks; they are summed before the shuffle.
    """

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(b, "text"):
            h, first, _ = grams(part.column("text").to_pylist())
            for i, (x, y) in enumerate(zip(first.tolist(), first[1:].tolist())):
                gram, n = np.unique(h[x:y], return_counts=True)
                lang = part.column("lang").take(pa.array(np.full(len(gram), i)))
                yield pa.RecordBatch.from_arrays([lang, pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return map_arrow(sample, count, "lang string, gram long, n long")


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = GRAMS, languages: int = LANGUAGES) -> Filters:
    """Filters from the rows (text, lang) of ``labelled``; doc_id only orders the sample."""
    rows = labelled.where("lang is not null").select("lang", "text", F.xxhash64("doc_id").alias("r"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    sizes = labelled.sparkSession.createDataFrame([(c["lang"], hash_bound(c["count"], per_language)) for c in counts], "taught string, most long")
    near = rows.join(F.broadcast(sizes), (F.col("lang") == F.col("taught")) & (F.col("r") <= F.col("most"))).select("lang", "r")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("r")))
    cut = ranked.where(F.col("rank") <= per_language).groupBy("lang").agg(F.max("r").alias("most")).collect()
    if not cut:
        return Filters.of({"": np.zeros(0, U64)})
    bounds = F.broadcast(labelled.sparkSession.createDataFrame([tuple(c) for c in cut], "taught string, most long"))
    sample = rows.where("text is not null").join(bounds, (F.col("lang") == F.col("taught")) & (F.col("r") <= F.col("most")))
    sample = sample.groupBy("lang", "r").agg(F.min("text").alias("text")).select("lang", "text")
    counted = gram_counts(sample).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    each = min(most, max(ALL_GRAMS // len(cut), 1))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= each)
    found = top.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # at most ALL_GRAMS
    return Filters.of({c["lang"]: np.zeros(0, U64) for c in cut} | {r["lang"]: np.array(r["grams"], np.int64).view(U64) for r in found})


def predict(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, tie (hash of the text), lang_pred and score of every row, from the text alone."""
    names = np.array([UNKNOWN, *filters.names], dtype=object)
    taught = filters.names != [""]

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(b, "text", 1_000_000):
            share, letters = filters.shares([t or "" for t in part.column("text").to_pylist()])
            known = (letters > 0) & taught
            best = share.argmax(axis=1)
            score = np.where(known, share[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(names[np.where(known, best + 1, 0)], pa.string()), pa.array(score)], ["doc_id", "tie", "lang_pred", "score"])

    d = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    return map_arrow(d, batch, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, tie long, lang_pred string, score double")


def fold(folds: int):
    """crc32 of doc_id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(0))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned outside the held-out fold, predicted for every row."""
    filters = learn(documents.where(fold(4) != 2))
    return predict(documents, filters).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "tie")


def keep_known(documents: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``documents`` without texts that are in none of the learned languages."""
    judged = identify(documents)
    unknown = judged.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least))
    return drop_rows(documents, unknown.select("doc_id", "tie", F.lit(False).alias("keep_one")).distinct())
