"""Near duplicates by 64-bit SimHash fingerprints, linked at a few differing bits.

Method. Every fingerprint has a row in a table of Hamming distances to reference fingerprints (pivots), taken block by block: a coordinate
is the distance to one pivot over one of ``blocks`` runs of bits. By the triangle inequality the largest coordinate difference within a
block is at most the distance within it, so those of all blocks add up to at most the distance of two fingerprints.

Candidates come from the table. If two fingerprints are within ``k`` bits, at most ``k`` blocks have a coordinate difference
above zero, so some ``blocks - k`` blocks agree in all coordinates: each choice of so many blocks, with its coordinates, is
a bucket, and no pair is lost. (Cells over distances to whole pivots would not do: those crowd around 32 of 64 bits, so that a cell
of k bits holds most rows.) Within a bucket a pair whose largest coordinate differences add up to more than ``k`` is discarded; survivors are
verified by their exact distance. Equal fingerprints are one row before that. The number of blocks grows with the number of
fingerprints, so that a bucket holds few by chance. A bucket with more than ``TILE`` fingerprints is dealt to pairs of
chunks of it, so no task holds more than two chunks of one bucket.

A bucket's links are reduced to a spanning forest of them before they leave the task, so that thousands of near copies
do not become millions of pairs; components are the same.

Cases. Null text counts as empty; a text without words has fingerprint zero and is linked like any other. A null
``doc_id`` never names a component unless all members' ids are null. Repeated rows are returned as often.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm.arrow import MIX_1, U64, mix, slices
from curator.llm.components import components
from curator.llm.spread import drop_rows, map_arrow, release
from curator.scratch import materialize

SHINGLE, SEED, MOST_BITS, PIVOTS, TILE = 4, 42, 4, 12, 4096
#: Fingerprints that may share a bucket by chance, on average, and the most blocks beyond the bits that may differ.
BY_CHANCE, MOST_SPARE = 64, 5

BYTES = U64(0x0101010101010101)


def shingle_digests(text: bytes, size: int = SHINGLE, seed: int = SEED) -> bytes:
    """The XXH64 of each shingle, big-endian, one after the other."""
    words = text.lower().split()  # for bytes: A-Z only, and x20, x09-x0D only
    if not words:
        return b""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return digest(joined, seed)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-size])]
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])])


def fold(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints: bit set if set in over half of a row's hashes. counts: hashes of each row."""
    rows = len(counts)
    out = np.zeros(rows, dtype=U64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # rows are cut into pieces of at most 255 hashes, whose bits are counted eight at a time in the bytes of a word
    first = np.cumsum(counts) - counts
    pieces = -(-counts[some] // 255)
    owner = np.repeat(np.arange(len(some)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[some][owner] + 255 * nth
    heads = np.cumsum(pieces) - pieces
    n = counts[some].astype(np.int64)
    for j in range(8):
        lanes = np.add.reduceat((h >> U64(j)) & BYTES, at)
        each = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)  # little-endian: byte i counts bit 8 i + j
        total = np.add.reduceat(each, heads, axis=0)
        for i in range(8):
            out[some] |= (total[:, i] * 2 > n).astype(U64) << U64(8 * i + j)
    return out


def fingerprints(documents: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, tie (hash of the text) and fingerprint ``fp`` of each row, as a signed long."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(b, "text"):
            raw = [shingle_digests((t or "").encode(), size, seed) for t in part.column("text").to_pylist()]
            counts = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
            h = np.frombuffer(b"".join(raw), ">u8").astype(U64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(fold(h, counts).view(np.int64))], ["doc_id", "tie", "fp"])

    d = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    return map_arrow(d, batch, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, tie long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random words."""
    return np.array([int.from_bytes(hashlib.sha256(b"pivot %d" % i).digest()[:8], "big") for i in range(n)], dtype=U64)


def blocks_for(n: int, most: int = MOST_BITS) -> int:
    """Blocks for ``n`` fingerprints: the fewest whose buckets hold ``BY_CHANCE`` by chance at most; twelve pivots tell over nine tenths of a block's bits."""
    bits = lambda b: 0.9 * 64 * (b - most) / b
    return next((b for b in range(most + 2, most + MOST_SPARE) if n <= BY_CHANCE * 2 ** bits(b)), most + MOST_SPARE)


def masks(blocks: int) -> list[int]:
    """The bits of each block."""
    if not 5 <= blocks <= 64:
        raise ValueError("a block has 1 to 13 bits")  # a coordinate takes four bits
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def coordinates(fp, mask: int):
    """A column of the pivots' distances over one block, four bits each."""
    each = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed(int(p)))).bitwiseAND(F.lit(signed(mask)))).cast("long"), 4 * i) for i, p in enumerate(pivots())]
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def table(fp: np.ndarray, blocks: int) -> np.ndarray:
    """The same for fingerprints at hand: rows x blocks x pivots."""
    apart = fp[:, None] ^ pivots()[None, :]
    return np.stack([np.bitwise_count(apart & U64(m)) for m in masks(blocks)], axis=1).astype(np.int8)


def linked(fp: np.ndarray, bucket: np.ndarray, most: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``bucket``; for runs over 8 rows a forest of them."""
    distances = table(fp, blocks)

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.zeros(len(i), np.int64)
        for b in range(blocks):  # one block after the other, on what is left
            least += np.abs(distances[i, b] - distances[j, b]).max(axis=1, initial=0)
            keep = least <= most
            i, j, least = i[keep], j[keep], least[keep]
            if len(i) < 64:
                break
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= most
        return i[ok], j[ok]

    a, b = forest(bucket, near)
    return fp[a], fp[b]


def forest(bucket: np.ndarray, near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within runs of equal ``bucket`` that ``near`` leaves; for runs over 8 rows a forest of them."""
    cut = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
    length = np.diff(np.append(cut, len(bucket)))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    small = (length > 1) & (length <= 8)
    for d in range(1, 8):
        i = np.concatenate([cut[small & (length > d + k)] + k for k in range(8 - d)])
        out.append(near(i, i + d))
    for a, n in zip(cut[length > 8], length[length > 8]):
        open_, todo = np.arange(a, a + n), []
        while len(open_) or todo:
            if not todo:
                todo, open_ = [open_[0]], open_[1:]
            x = todo.pop()
            i, j = near(np.full(len(open_), x), open_)
            out.append((i, j))
            todo += j.tolist()
            open_ = np.setdiff1d(open_, j, assume_unique=True)
    a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
    return a, b


def buckets(distinct: DataFrame, most: int, blocks: int) -> DataFrame:
    """fp and bucket: a row for each choice of ``blocks - most`` blocks, bucket being a hash of their coordinates."""
    rows = distinct.select("fp", *[coordinates(F.col("fp"), m).alias(f"c{i}") for i, m in enumerate(masks(blocks))])
    keys = [F.xxhash64(F.lit(k), *[f"c{i}" for i in chosen]) for k, chosen in enumerate(combinations(range(blocks), blocks - most))]
    return rows.select("fp", F.explode(F.array(*keys)).alias("bucket"))


def bucket_keys(fp: np.ndarray, most: int, blocks: int) -> np.ndarray:
    """Buckets of the same kind for fingerprints at hand, where choices are so many that an expression for each would be slow: rows x choices."""
    each = table(fp, blocks).astype(U64)
    packed = mix(np.bitwise_or.reduce(each << (U64(4) * np.arange(PIVOTS, dtype=U64)), axis=2))  # a block's coordinates, four bits each
    out = np.empty((len(fp), math.comb(blocks, most)), U64)
    for k, chosen in enumerate(combinations(range(blocks), blocks - most)):
        h = np.full(len(fp), U64(k + 1))
        for i in chosen:
            h = mix(h * MIX_1 + packed[:, i])
        out[:, k] = h
    return out


def links(distinct: DataFrame, most: int = MOST_BITS, blocks: int | None = None) -> DataFrame:
    """Edges (a < b) between distinct fingerprints ``fp`` that connect all pairs within ``most`` bits."""
    blocks = blocks or blocks_for(distinct.count(), most)
    keyed = buckets(distinct, most, blocks)
    hot = keyed.groupBy("bucket").count().where(F.col("count") > TILE).select(F.col("bucket").alias("hot"), F.ceil(F.col("count") / TILE).cast("int").alias("chunks"))
    hot = materialize(hot, "hot-buckets")
    rows = keyed
    if hot.limit(1).count():
        marked = keyed.join(hot, F.col("bucket") == F.col("hot"), "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        tiles = marked.where("chunks is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        tiles = tiles.select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
        rows = marked.where("chunks is null").select("fp", "bucket").unionByName(tiles)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, bucket = np.zeros(0, U64), np.zeros(0, np.int64)
        more = True
        while more:
            b = next(batches, None)
            more = b is not None
            if more:
                fp = np.append(fp, b.column("fp").to_numpy(zero_copy_only=False).view(U64))
                bucket = np.append(bucket, b.column("bucket").to_numpy(zero_copy_only=False))
            end = len(fp) if not more else int(np.searchsorted(bucket, bucket[-1])) if len(fp) else 0
            f, k = fp[:end], bucket[:end]
            fp, bucket = fp[end:], bucket[end:]
            if len(f) > 1:
                several = np.append(False, k[1:] == k[:-1])
                several[:-1] |= several[1:]
                f, k = f[several], k[several]
            if len(f) > 1:
                x, y = (z.view(np.int64) for z in linked(f, k, most, blocks))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
        release()

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(near, "a long, b long").where("a < b").distinct()


def near_duplicates(documents: DataFrame, size: int = SHINGLE, most: int = MOST_BITS, least: float | None = None) -> DataFrame:
    """doc_id, tie, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Fingerprints are of ``size`` words' shingles; those within ``most`` bits are linked. With ``least`` these links are candidates, texts beyond ``most``
    bits are searched exactly, and those are linked whose shingles have that similarity (see ``curator.llm.similar``); the fingerprint is left out then.
    """
    if least is not None:
        from curator.llm.similar import similar_groups  # it builds on this module

        return similar_groups(documents, size, least, most)
    rows = materialize(fingerprints(documents, size), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = materialize(components(links(nodes.select("fp"), most)), "roots")
    members = nodes.join(roots, nodes["fp"] == roots["node"])
    named = members.groupBy("root").agg(F.min("least").alias("smallest"))
    linked_nodes = roots.join(named, "root").select(F.col("node"), "smallest")
    named_nodes = nodes.join(linked_nodes, nodes["fp"] == linked_nodes["node"], "left").select(F.col("fp").alias("node_fp"), F.coalesce("smallest", "least").alias("component_id"))
    named_nodes = materialize(named_nodes, "components")  # a side of its own, so that adaptive execution can split a hot fingerprint
    out = rows.join(named_nodes, rows["fp"] == named_nodes["node_fp"])
    return out.select("doc_id", "tie", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, size: int = SHINGLE, most: int = MOST_BITS, least: float | None = None) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return keep_smallest(documents, near_duplicates(documents, size, most, least))


def keep_smallest(documents: DataFrame, grouped: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component. grouped: doc_id, tie, component_id."""
    rows = materialize(grouped.groupBy("doc_id", "tie", "component_id").agg(F.count("*").alias("times")), "members")
    # rows that share the smallest id differ in their text: the smallest hash of it stays
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")).alias("first")).select(F.col("component_id").alias("c"), "first")
    first = materialize(first, "first-members")  # sides of their own, so that adaptive execution can split a hot component
    mine = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")
    judged = rows.join(first, F.col("component_id").eqNullSafe(F.col("c"))).withColumn("keep_one", mine.eqNullSafe(F.col("first")))
    return drop_rows(documents, judged.where("not keep_one or times > 1").select("doc_id", "tie", "keep_one"))
