"""Toxicity by multiple-instance learning: sentences are judged, documents are labelled.

A sentence's probability is a logistic function of its words and their beginnings (hashed to ``2**BITS`` weights, so
that inflected forms share evidence); a document's is the
noisy-or of its sentences, one minus the product of their complements. The weights are learned from document labels
alone by proximal AdaGrad with an L1 penalty on the noisy-or likelihood: in a document labelled 1 most of the gradient goes
to the sentences that already look worst, in one labelled 0 all sentences are pushed down. Applied to a text, the
same weights say which sentences offend.

Learning takes a bounded sample: of each label the rows with the smallest hash of doc_id, at most ``positives`` and
``negatives``, and ``SAMPLE_CHARS`` of their texts. Sentences are split and hashed on the executors, and features are chosen there: those in at least
``LEAST_DOCUMENTS`` sampled documents that are ``LIFT`` times as frequent in documents labelled 1 as in the others. The
driver sees chosen features only.

Cases. Null texts and texts without words have score 0. A document with several labels counts as 1 if any is 1; null labels and
ids teach nothing. Without labels of both kinds every score is 0. Repeated rows are scored as often. Sentences end at
``.``, ``!``, ``?`` or a line's end; offsets count characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.llm.arrow import U64, hashes, runs_of, slices, utf8
from curator.llm.spread import hash_bound, map_arrow
from curator.scratch import materialize

BITS, POSITIVES, NEGATIVES, LEAST_DOCUMENTS, LIFT = 20, 2500, 5000, 4, 3.0
#: Characters of the sample's texts of a label, but for the last.
SAMPLE_CHARS = 32_000_000
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
STEPS, RATE, L1, INTERCEPT = 150, 1.0, 0.5, -9.0
OFFENDING = 0.5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and all of longer UTF-8 sequences.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
STOP = np.zeros(256, bool)
STOP[[0x2E, 0x21, 0x3F, 0x0A]] = True


def sentences(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and the sentence of each, and row and (start, end) bytes of each sentence."""
    start, end = runs_of(LETTER[raw], off)
    low = LOWER[raw]
    row = np.searchsorted(off, start, "right") - 1
    part = np.cumsum(STOP[raw])[start] if len(start) else start
    new = np.append(True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])) if len(start) else np.zeros(0, bool)
    head, own = np.flatnonzero(new), np.cumsum(new) - 1
    last = np.append(head[1:], len(start))[: len(head)] - 1
    feature, sentence = [hashes(low, start, end)], [own]
    for k in BEGINNINGS:
        longer = np.flatnonzero(end - start > k)
        feature.append(hashes(low, start[longer], start[longer] + k) ^ U64(k))
        sentence.append(own[longer])
    every = (np.concatenate(feature) >> U64(64 - BITS)).astype(np.int64)
    return every, np.concatenate(sentence), row[head], np.stack([start[head], end[last]])


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(feature: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept. sentence: of each word; document: of each sentence; label: of each document."""
    weights = np.zeros(1 << BITS, np.float32)
    if not 0 < label.sum() < len(label):
        return weights, -1000.0
    n, b = len(document), INTERCEPT
    used, f = np.unique(feature, return_inverse=True)
    s, w, seen = sentence, np.zeros(len(used)), np.full(len(used), 1e-6)
    for _ in range(STEPS):
        z = b + np.bincount(s, w[f], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clear = np.bincount(document, -softplus(z), len(label))  # log of the chance that no sentence offends
        toxic = np.maximum(-np.expm1(clear), 1e-6)
        pull = np.where(label == 1, np.exp(clear) / toxic, -1.0)
        g = p * pull[document]
        gw = np.bincount(f, g[s], len(used))
        seen += gw**2
        step = RATE / np.sqrt(seen)
        w = w + step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
    weights[used] = w
    return weights, b


def learn(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> tuple[np.ndarray, float]:
    """Weights from the rows of ``documents`` (doc_id, text) that ``labels`` (doc_id, toxic) marks."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    marks = materialize(marks.withColumn("r", F.xxhash64("doc_id")), "toxicity-labels")
    of = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}  # two rows at most
    bound = F.when(F.col("toxic") == 1, hash_bound(of.get(1, 0), positives)).otherwise(hash_bound(of.get(0, 0), negatives))
    ranked = marks.where(F.col("r") <= bound).withColumn("rank", F.row_number().over(Window.partitionBy("toxic").orderBy("r", "doc_id")))
    sample = ranked.where(F.col("rank") <= F.when(F.col("toxic") == 1, positives).otherwise(negatives)).select(F.col("doc_id").alias("_id"), "toxic")
    d = documents.select("doc_id", "text").where("text is not null")
    d = d.join(F.broadcast(sample), d["doc_id"] == sample["_id"]).groupBy("doc_id", "text", "toxic").agg(F.lit(1).alias("one"))

    # the least hashes of each label, as long as their texts are no more than SAMPLE_CHARS together
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < SAMPLE_CHARS).select("doc_id", "text", "toxic")
    d = materialize(d, "toxicity-sample")
    totals = {r.toxic: r["count"] for r in d.groupBy("toxic").count().collect()}

    def features(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(b, "text"):
            feature, sentence, row, _ = sentences(*utf8(part.column("text")))
            at, f = np.divmod(np.unique(row[sentence] * np.int64(1 << BITS) + feature), 1 << BITS)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[at] == 1
            one, zero = np.bincount(f[toxic], minlength=1 << BITS), np.bincount(f[~toxic], minlength=1 << BITS)
            some = np.flatnonzero(one + zero)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(one[some]), pa.array(zero[some])], ["feature", "one", "zero"])

    counted = map_arrow(d, features, "feature long, one long, zero long").groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    lift = F.col("one") * max(totals.get(0, 0), 1) >= F.lit(LIFT) * F.col("zero") * max(totals.get(1, 0), 1)
    told = np.zeros(1 << BITS, bool)
    told[[r.feature for r in counted.where((F.col("one") >= LEAST_DOCUMENTS) & lift).select("feature").collect()]] = True

    def words_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(b, "text"):
            feature, sentence, row, _ = sentences(*utf8(part.column("text")))
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            pairs = np.unique(sentence * np.int64(1 << BITS) + feature)
            own, feature = np.divmod(pairs[told[pairs % (1 << BITS)]], 1 << BITS)
            for i, (x, y) in enumerate(np.searchsorted(own, np.stack([first[:-1], first[1:]], axis=1)).tolist()):
                packed = np.stack([feature[x:y], own[x:y] - first[i]]).astype("<i4").tobytes()
                count = pa.array([first[i + 1] - first[i]], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(i, 1), part.column("toxic").slice(i, 1), count, pa.array([packed], pa.binary())], ["doc_id", "toxic", "sentences", "packed"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = sorted(map_arrow(d, words_of, f"doc_id {kind}, toxic int, sentences long, packed binary").collect(), key=lambda r: (r.doc_id, bytes(r.packed)))
    features, owners, docs, base = [], [], [], 0
    for k, r in enumerate(rows):
        f, s = np.frombuffer(r.packed, "<i4").reshape(2, -1).astype(np.int64)
        n = r.sentences
        features.append(f)
        owners.append(s + base)
        docs.append(np.full(n, k))
        base += n
    empty = [np.zeros(0, np.int64)]
    return fit(np.concatenate(features + empty), np.concatenate(owners + empty), np.concatenate(docs + empty), np.array([r.toxic for r in rows], np.int64))


def score(documents: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """doc_id, score and the offending sentences (start, end, score) of every row."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(b, "text"):
            raw, off = utf8(part.column("text"))
            feature, sentence, row, span = sentences(raw, off)
            n, m = part.num_rows, len(row)
            # each feature of a sentence counts once, as in learning
            hot = np.flatnonzero(weights[feature])
            own, f = np.divmod(np.unique(sentence[hot] * np.int64(1 << BITS) + feature[hot]), 1 << BITS)
            z = intercept + np.bincount(own, weights[f], m)
            s = -np.expm1(-np.bincount(row, softplus(z), n)) if m else np.zeros(n)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            bad = np.flatnonzero(p >= OFFENDING)
            chars = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
            place = (chars[span[:, bad]] - chars[off[row[bad]]]).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(place[0]), pa.array(place[1]), pa.array(p[bad])], ["start", "end", "score"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[bad], np.arange(n + 1)).astype(np.int32)), struct)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(s, 0, 1)), lists], ["doc_id", "score", "offending"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), batch, f"doc_id {kind}, score double, offending array<struct<start: int, end: int, score: double>>")


def fold(folds: int):
    """crc32 of doc_id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(0))


def detect(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and offending sentences: learned outside the held-out fold, applied to every row."""
    weights, intercept = learn(documents, labels.where(fold(5) != 0))
    scored = score(documents, weights, intercept)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
