"""Groups of documents whose word shingles have a Jaccard similarity of at least a given share.

Method. Candidates come from SimHash fingerprints and their table of pivots (``curator.llm.simhash``); an exact search adds what lies beyond their radius.
1. Texts whose fingerprints differ in ``most`` bits or fewer are linked, all of them: each choice of two of ``most + 2`` runs of bits, with the pivots'
   coordinates over them, is a bucket. In a bucket only sets whose sizes differ by a factor of ``least`` at most meet, and the exact distance decides.
2. Similar sets may be further apart: at 0.8 they differ in 9.7 of 64 bits on average, with a deviation of 2.9 and no bound. For these: of a set of
   n shingles, in any order that all sets share, a similar set has one of the first ``n - ceil(least n) + 1``.
   Order: shingles that are frequent in a part of the documents come last (a bit map of fixed size), then by hash. A poor
   estimate of what is frequent costs time and no pairs. These first shingles are the keys under which sets meet that step 1 did not link.
   At the first shingle that two sets share they have in common what follows it at most, so a key keeps those rows only that some other row
   of it leaves possible by size and by place (of keys with over ``PAIRED`` rows, by size).
   A signature of parities of hashed shingles, at least as many as the set has, cannot differ in more bits than the sets differ in shingles, which
   is at most ``(1 - least) / (1 + least)`` of both sizes together. Signatures of two lengths are compared at the shorter one, to which the longer is folded.
3. The links of both are clusters, and a cluster's documents are verified by the exact similarity. A cluster with more than ``CLUSTER``
   shingles is dealt to pairs of chunks of it, as are buckets with more than ``TILE`` documents (``WIDE`` fingerprints), so that no task holds more than two chunks.
Within buckets and clusters only a spanning forest of links is sought, so large groups do not become all of their pairs, and what a task has linked leaves it as
links to one row of each component, the same in most buckets of a group, so that its links coincide. Groups do not depend on ``most``.

Cases. Texts are told apart by a 64-bit hash; of n texts, about n^2 / 2^65 pairs of different ones are taken for equal. Texts of at most ``size`` words are one shingle; null texts and texts without words are equal to each other. Groups are connected
components, so two of a group's documents may be less alike than ``least``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm.arrow import U64, mix, slices
from curator.llm.components import components
from curator.llm.simhash import TILE, bucket_keys, fold, forest, shingle_digests
from curator.llm.spread import among, map_arrow, release
from curator.scratch import drop_shuffles, materialize

SIZE, LEAST, SEED = 5, 0.8, 42
#: Bits in which fingerprints may differ, fingerprints of a bucket that one task holds, and pairs that are compared at a time.
MOST, WIDE, PAIRS = 10, 1 << 16, 1 << 20
#: Bits of a signature, and shingles of a cluster, or of a chunk of it, that are verified in one task.
FEWEST_BITS, MOST_BITS, CLUSTER = 512, 1 << 16, 1 << 19
#: One in PART documents tells which shingles are frequent: those in OFTEN of them. SLOTS is the bit map's size, as a power of two.
PART, OFTEN, SLOTS = 16, 3, 24
#: Bits of the names of shingles and of buckets that are moved (names that clash cost time and no pairs), and rows of a key that are compared by place.
SHINGLE_BITS, BUCKET_BITS, PAIRED = 40, 32, 64
EPS = 1e-9


def shingles(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """The set of a text's shingle hashes, sorted; never empty."""
    return _set(shingle_digests((text or "").encode(), size, seed))


def _set(digests: bytes) -> np.ndarray:
    raw = np.frombuffer(digests, ">u8").astype(U64)
    return np.unique(raw) if len(raw) else np.zeros(1, U64)


def parities(s: np.ndarray) -> np.ndarray:
    """Parities of the hashes, as words of 64 bits: at least as many as hashes, a power of two."""
    bits = min(max(FEWEST_BITS, 1 << (len(s) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((mix(s) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


class Signatures:
    """Parities of several sets, compared at the shorter of two lengths."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.length = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.words = np.concatenate([*parts, np.zeros(0, U64)])

    def at(self, rows: np.ndarray, length: int) -> np.ndarray:
        """The signatures of ``rows``, folded to ``length`` words."""
        out = np.empty((len(rows), length), U64)
        for own in np.unique(self.length[rows]).tolist():
            r = np.flatnonzero(self.length[rows] == own)
            folds = self.words[self.first[rows[r]][:, None] + np.arange(own)].reshape(len(r), own // length, length)
            out[r] = np.bitwise_xor.reduce(folds, axis=1)
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the signatures of ``i`` and ``j`` differ, at least."""
        out = np.zeros(len(i), np.int64)
        shorter = np.minimum(self.length[i], self.length[j])
        for length in np.unique(shorter).tolist():
            k = np.flatnonzero(shorter == length)
            for part in np.array_split(k, -(-len(k) * length // (1 << 20))):  # 8 MB at a time
                out[part] = np.bitwise_count(self.at(i[part], length) ^ self.at(j[part], length)).sum(axis=1, dtype=np.int64)
        return out


def _first(n, least: float):
    """The number of first shingles of a set of ``n``."""
    return n - np.ceil(least * n - EPS) + 1


def prefix(s: np.ndarray, least: float, frequent: np.ndarray) -> np.ndarray:
    """The first shingles, of which any similar set has one."""
    slot = (s & U64((1 << SLOTS) - 1)).astype(np.int64)
    late = frequent[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
    return s[np.argsort(late, kind="stable")][: int(_first(len(s), least))]


def _short(s: np.ndarray) -> np.ndarray:
    """Shingles' names, as signed longs."""
    return (s & U64((1 << SHINGLE_BITS) - 1)).view(np.int64)


def placed(signed: DataFrame) -> DataFrame:
    """k, id and at: a row for each of the first shingles, ``at`` being the set's size and the shingle's place among them, in 256 steps. In order of size."""
    each = signed.select("id", "n", F.size("keys").alias("count"), F.posexplode("keys").alias("place", "k"))
    return each.select("k", "id", F.expr("shiftleft(bigint(n), 8) + shiftleft(bigint(place), 8) div count").alias("at"))


def partnered(k: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """The rows that may have their first shingle in common with another row of their key ``k``. Rows are in order of ``k`` and ``at`` (see ``placed``)."""
    n = at >> 8
    same = k[1:] == k[:-1]
    near = same & (n[:-1] >= least * n[1:] - EPS)
    rows = np.flatnonzero(np.append(near, False) | np.append(False, near))
    if not len(rows):
        return rows
    k, n, at = k[rows], n[rows], at[rows]
    rest = n - (at & 255) * _first(n, least) / 256 + EPS  # shingles from this place on, at least as many as there are
    start = np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1)
    length = np.diff(np.append(start, len(k)))
    keep = np.repeat(length > PAIRED, length)
    for d in range(1, int(length[length <= PAIRED].max(initial=1))):
        i = np.flatnonzero(k[d:] == k[:-d])
        j = i + d
        ok = (n[i] >= least * n[j] - EPS) & (np.minimum(rest[i], rest[j]) >= least / (1 + least) * (n[i] + n[j]) - EPS)
        keep[i[ok]] = keep[j[ok]] = True
    return rows[keep]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same numbers as the links of ``a`` and ``b``: of each component its least number to every other one."""
    name, ends = np.unique(np.append(a, b), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(name))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots are joined to lesser roots, and then all rows to theirs
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    other = np.flatnonzero(root != np.arange(len(root)))
    return name[root[other]], name[other]


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """A bit map of the low bits of shingles that are frequent in one of PART documents."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(b, "text"):
            s = np.concatenate([shingles(t, size) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(_short(s))], ["s"])

    some = map_arrow(texts.where(F.pmod(F.xxhash64("node"), F.lit(PART)) == 0).select("text"), batch, "s long")
    spot = (F.col("s").bitwiseAND(F.lit((1 << SLOTS) - 1)) + 1).alias("spot")
    often = some.groupBy("s").count().where(F.col("count") >= OFTEN).select(spot)
    maps = often.groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    out = np.zeros(1 << SLOTS - 3, np.uint8)
    for r in maps.collect():  # at most 2**SLOTS / 8 bytes
        at = (r.bucket - 1) * 4096
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def centred(a: np.ndarray, b: np.ndarray, fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same rows as the links of ``a`` and ``b``, rows of equal ``fp`` and ``n`` being one: of each component the row nearest
    to the majority of its bits to every other one. Most buckets that share a group of near copies agree on this row, so that their links coincide."""
    order = np.lexsort((fp, n))  # a number for each different row, in the same order in every task
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(np.append(0, (n[order][1:] != n[order][:-1]) | (fp[order][1:] != fp[order][:-1])))
    some = np.empty(len(order), np.int64)
    some[number] = np.arange(len(number))
    root, other = stars(number[a], number[b])
    first = np.unique(root)
    row, group = np.append(first, other), np.append(first, root)
    by = np.lexsort((row, group))
    row, group = row[by], group[by]
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(row)))
    f = fp[some[row]]
    votes = np.add.reduceat(np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1), start, axis=0, dtype=np.int64)
    major = np.packbits(2 * votes > size[:, None], axis=1).view(U64).ravel()
    row = row[np.lexsort((row, np.bitwise_count(f ^ np.repeat(major, size)), group))]
    centre = np.repeat(row[start], size)
    return some[centre[row != centre]], some[row[row != centre]]


def _grouped(df: DataFrame, key: str, f, schema: str) -> DataFrame:
    """``f`` of record batches that hold all rows of a ``key`` together, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(k, k[-1]))
            if held and (cut or held[-1].column(key)[held[-1].num_rows - 1].as_py() != k[0]):
                yield from f(pa.Table.from_batches([*held, *([b.slice(0, cut)] if cut else [])]))
                held = []
            elif cut:
                yield from f(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield from f(pa.Table.from_batches(held))
            held.clear()
        release()

    return df.repartition(key).sortWithinPartitions(key, *[c for c in ("n", "at") if c in df.columns]).mapInArrow(run, schema)


def within(bucket: np.ndarray, fp: np.ndarray, n: np.ndarray, most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, in order of ``bucket`` and ``n``, that share a bucket, have sizes ``n`` that a similarity of ``least`` allows and
    fingerprints within ``most`` bits. Of buckets with over eight such pairs a row a forest of them."""
    run = np.cumsum(np.append(0, bucket[1:] != bucket[:-1]))
    longest = np.minimum((n + EPS) / least, (1 << 32) - 1).astype(np.int64)
    meets = np.searchsorted((run << 32) + n, (run << 32) + longest, "right") - np.arange(1, len(n) + 1)
    total, rows, links = np.cumsum(meets), np.bincount(run), np.zeros(run[-1] + 1, np.int64)
    if not total[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    cuts = np.searchsorted(total, np.arange(PAIRS, total[-1] + PAIRS, PAIRS))
    for a, b in zip([0, *(cuts + 1).tolist()], (np.minimum(cuts, len(n) - 1) + 1).tolist()):
        few = np.where(links[run[a:b]] > 8 * rows[run[a:b]], 0, meets[a:b])
        i = np.repeat(np.arange(a, b), few)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(few) - few, few)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= most
        out.append((i[near], j[near]))
        links += np.bincount(run[i[near]], minlength=len(links))
    i, j = (np.concatenate([x[k] for x in out]) for k in (0, 1))
    dense = links > 8 * rows
    keep = ~dense[run[i]]
    at = np.flatnonzero(dense[run])
    if not len(at):
        return i, j

    def linked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, t = at[x], at[y]
        ok = (np.minimum(n[s], n[t]) >= least * np.maximum(n[s], n[t]) - EPS) & (np.bitwise_count(fp[s] ^ fp[t]) <= most)
        return x[ok], y[ok]

    x, y = forest(run[at], linked)
    return np.append(i[keep], at[x]), np.append(j[keep], at[y])


def near_fingerprints(signed: DataFrame, most: int, least: float) -> DataFrame:
    """Links a < b that connect all nodes whose fingerprints are within ``most`` bits and whose sizes allow ``least``, and no others. signed: node, n, fp."""
    sets = materialize(signed.groupBy("fp", "n").agg(F.min("node").alias("first")), "distinct-fingerprints")
    blocks = max(most + 2, 5)

    def spread(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "n"))
        keys = bucket_keys(fp.view(U64), most, blocks)
        times = keys.shape[1]
        short = (keys >> U64(64 - BUCKET_BITS)).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, times)), pa.array(np.repeat(n, times)), pa.array(short)], ["fp", "n", "bucket"])

    keyed = map_arrow(sets.select("fp", "n"), spread, "fp long, n int, bucket long")
    if sets.count() > WIDE:
        hot = keyed.groupBy("bucket").count().where(F.col("count") > WIDE).select(F.col("bucket").alias("hot"), F.ceil(F.col("count") / WIDE).cast("int").alias("chunks"))
        marked = keyed.join(materialize(hot, "hot-buckets"), F.col("bucket") == F.col("hot"), "left")
        own = F.pmod(F.xxhash64("fp", "n"), F.col("chunks")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.xxhash64("bucket", F.least(own, o), F.greatest(own, o)))
        keyed = marked.select("fp", "n", F.explode(F.when(F.col("chunks").isNull(), F.array("bucket")).otherwise(tiles)).alias("bucket"))

    def link(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, fp, n = (_numpy(t, c) for c in ("bucket", "fp", "n"))
        a, b = within(bucket, fp.view(U64), n.astype(np.int64), most, least)
        if len(a):
            a, b = centred(a, b, fp.view(U64), n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[a], n[a], fp[b], n[b])], ["fp_a", "n_a", "fp_b", "n_b"])

    pairs = materialize(_grouped(keyed, "bucket", link, "fp_a long, n_a int, fp_b long, n_b int").distinct(), "near-fingerprints")
    drop_shuffles(signed.sparkSession)
    node = lambda x: sets.select(F.col("fp").alias(f"fp_{x}"), F.col("n").alias(f"n_{x}"), F.col("first").alias(x))
    ends = pairs.join(node("a"), ["fp_a", "n_a"]).join(node("b"), ["fp_b", "n_b"])
    # a row's centres, one for each of its buckets at most, are linked to one of them, so that a group has few links more than rows
    centres = ends.groupBy("b").agg(F.collect_set("a").alias("centres"))
    met = centres.select(F.array_min("centres").alias("a"), F.explode(F.array_union("centres", F.array("b"))).alias("b"))
    equal = signed.select("node", "fp", "n").join(sets, ["fp", "n"]).select(F.col("first").alias("a"), F.col("node").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(equal).where("a < b")


def _numpy(t: pa.Table, column: str) -> np.ndarray:
    return t.column(column).to_numpy()


def candidates(texts: DataFrame, size: int, least: float, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Links a < b between nodes that connect all pairs that may be similar, and nodes with their numbers of shingles. texts: node, text."""
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, size))

    def sign(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(b, "text"):
            raw = [shingle_digests((t or "").encode(), size, SEED) for t in part.column("text").to_pylist()]
            fp = fold(np.frombuffer(b"".join(raw), ">u8").astype(U64), np.array([len(x) // 8 for x in raw], np.int64))
            sets = [_set(x) for x in raw]
            first = [_short(prefix(s, least, frequent.value)) for s in sets]
            keys = pa.ListArray.from_arrays(np.cumsum([0, *map(len, first)]).astype(np.int32), np.concatenate(first))
            columns = [part.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp.view(np.int64)), pa.array([parities(s).tobytes() for s in sets]), keys]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "fp", "sig", "keys"])

    made = map_arrow(texts, sign, "node long, n int, fp long, sig binary, keys array<long>")
    signed = materialize(made.withColumn("id", F.monotonically_increasing_id()), "signatures", "zstd")  # ids of a task are alike, and so are moved in fewer bytes than nodes
    return near_fingerprints(signed, most, least).unionByName(beyond(signed, most, least)).distinct(), signed.select("node", "n")


def beyond(signed: DataFrame, most: int, least: float) -> DataFrame:
    """Links a < b between nodes whose fingerprints differ in more than ``most`` bits: with those of ``near_fingerprints`` they connect all
    pairs that may be similar. signed: id, node, n, fp, sig, keys."""

    def several(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = partnered(_numpy(t, "k"), _numpy(t, "at"), least)
        if len(rows):
            yield from t.select(["k", "id"]).take(pa.array(rows)).combine_chunks().to_batches()

    shared = materialize(_grouped(placed(signed), "k", several, "k long, id long"), "shared-shingles")
    drop_shuffles(signed.sparkSession)
    chunks = shared.groupBy("k").count().where(F.col("count") > TILE).select(F.col("k").alias("hot"), F.ceil(F.col("count") / TILE).cast("int").alias("chunks"))
    marked = shared.join(materialize(chunks, "hot-shingles"), F.col("k") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    tile = F.explode(F.when(F.col("chunks").isNull(), F.array(F.col("k"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.xxhash64("k", F.least(own, o), F.greatest(own, o)))))
    dealt = marked.select(tile.alias("k"), F.col("id").alias("of"))
    rows = dealt.join(signed.select("id", "node", "n", "fp", "sig"), dealt["of"] == signed["id"]).select("k", "node", "n", "fp", "sig")

    def link(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k, node, n, fp = _numpy(t, "k"), _numpy(t, "node"), _numpy(t, "n").astype(np.int64), _numpy(t, "fp").view(U64)
        sig = Signatures([np.frombuffer(x, U64) for x in t.column("sig").to_pylist()])

        def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - EPS
            i, j = i[keep], j[keep]
            known = np.bitwise_count(fp[i] ^ fp[j]) <= most  # linked by their fingerprints: the forest may use them, only others are returned
            x, y = _possible(i[~known], j[~known], n, sig, least)
            return np.append(i[known], x), np.append(j[known], y)

        a, b = forest(k, near)
        new = np.bitwise_count(fp[a] ^ fp[b]) > most
        a, b = stars(node[a[new]], node[b[new]])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _grouped(rows, "k", link, "a long, b long").where("a < b")


def _possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, sig: Signatures, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that sizes and parities leave."""
    keep = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - EPS
    i, j = i[keep], j[keep]
    keep = sig.apart(i, j) <= (n[i] + n[j]) * (1 - least) / (1 + least) + EPS
    return i[keep], j[keep]


def dealt(clusters: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """node and tile: rows of ``clusters`` (node, root), with a tile for each pair of chunks of a cluster with over ``most`` shingles."""
    sized = clusters.join(sizes.select(F.col("node").alias("of"), "n"), F.col("node") == F.col("of"))
    large = sized.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    large = materialize(large.select(F.col("root").alias("hot"), F.ceil(F.col("n") / most).cast("int").alias("chunks")), "large-clusters")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.xxhash64("root", F.least(own, o), F.greatest(own, o)))
    marked = clusters.join(large, F.col("root") == F.col("hot"), "left")
    return marked.select("node", F.explode(F.when(F.col("chunks").isNull(), F.array("root")).otherwise(tiles)).alias("tile"))


def verified(texts: DataFrame, size: int, least: float) -> DataFrame:
    """Links a < b that connect all similar pairs within a tile. texts: tile, node, text."""

    def link(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sets = [shingles(x, size) for x in t.column("text").to_pylist()]
        n, sig = np.array([len(s) for s in sets]), Signatures([parities(s) for s in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]  # shingles as small numbers, one set after the other
        first, mark = np.cumsum(n) - n, np.zeros(n.sum(), bool)

        def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i, j = _possible(i, j, n, sig, least)
            common = np.zeros(len(i), np.int64)
            for x in np.unique(i):
                at = np.flatnonzero(i == x)
                size_j, mine = n[j[at]], number[first[x] : first[x] + n[x]]
                mark[mine] = True
                head = np.cumsum(size_j) - size_j
                common[at] = np.add.reduceat(mark[number[np.repeat(first[j[at]] - head, size_j) + np.arange(size_j.sum())]], head, dtype=np.int64)
                mark[mine] = False
            keep = common >= least * (n[i] + n[j] - common) - EPS
            return i[keep], j[keep]

        node = _numpy(t, "node")
        a, b = forest(_numpy(t, "tile"), near)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

    return _grouped(texts, "tile", link, "a long, b long").where("a < b").distinct()


def similar_groups(documents: DataFrame, size: int = SIZE, least: float = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, tie and component_id, the smallest doc_id of the group. Groups link sets of ``size`` words' shingles whose similarity is ``least`` or more.

    ``most`` is the radius of the search by fingerprints; it costs time and changes no group.
    """
    if not 0 < least <= 1:
        raise ValueError(f"similarity {least} is not in (0, 1]")
    if not 0 <= most <= 62:
        raise ValueError(f"a radius of {most} bits is not in 0 to 62")
    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    keys = materialize(rows.select("doc_id", "tie"), "similar-keys")
    marked = among(rows.select(F.col("tie").alias("node"), "text"), F.col("node"), keys.groupBy("tie").count().where("count > 1").select(F.col("tie").alias("member")), keys.count() // 2)
    # equal texts are one node; only those that may have an equal are moved
    texts = marked.where("not maybe_member").select("node", "text").unionByName(marked.where("maybe_member").select("node", "text").dropDuplicates(["node"]))
    possible, sizes = candidates(texts, size, least, most)
    clusters = materialize(components(possible), "clusters")
    drop_shuffles(documents.sparkSession)
    tiles = dealt(clusters, sizes, CLUSTER).select(F.col("node").alias("dealt"), "tile")
    members = among(texts, F.col("node"), clusters.select(F.col("node").alias("member")), clusters.count()).where("maybe_member").select(F.col("node").alias("of"), "text")
    members = members.join(tiles, F.col("of") == F.col("dealt"))
    roots = components(verified(members.select("tile", F.col("of").alias("node"), "text"), size, least))
    ids = keys.join(materialize(roots, "similar"), F.col("tie") == F.col("node"), "left").select("doc_id", "tie", F.coalesce("root", "tie").alias("root"))
    ids = materialize(ids, "grouped")
    least_id = materialize(ids.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component_id")), "least")
    return ids.join(least_id, F.col("root") == F.col("of")).select("doc_id", "tie", "component_id")
