"""Long repeated passages by recompression of word sequences.

A window is ``window`` consecutive words of one document. Every word covered by a window whose word sequence also
starts anywhere else, in the same document too, is removed.

Method. A text is recompressed in rounds: maximal runs of one word get a name, then, round by round, each name is
dealt to the left or right side by a bit of its hash and every adjacent (left, right) pair becomes one name.
Names are hashes of what they stand for, so equal pairs get equal names everywhere: the rounds are global without
a dictionary and its shuffles. Whether two neighbours merge depends on these two alone, so equal windows have equal
symbols inside, except for at most one symbol a round at each border that may merge with what lies outside.
A window's *interior* is what is left after dropping those; it depends on the window's words only. Its *anchor*
is the interior's longest symbol, of equally long ones that with the least name, of equals the leftmost. Equal windows thus have
the same anchor at the same place, and consecutive windows of one anchor form a stretch of text. A window with an empty
interior is its own anchor; windows within a run of one word are all alike and form one stretch.

Only anchors are shuffled, about one for every dozen words, not windows. Names found once end there. An anchor
whose whole stretch is found twice proves all its windows. For the other shared names the texts are read
again, one text for each different stretch, and their windows are compared one by one within the name. Names only bring windows
together: whether they are equal is told by a BLAKE2b digest of 128 bits of their words' own bytes, joined by one space, so a
chance or made collision of names costs time and removes nothing.

Cases. Null and empty texts have no words. Texts shorter than a window lose nothing. Rows are told apart by
doc_id and a hash of the text; a null doc_id is an id like any other. Repeated rows count as separate starts, so
their windows are removed in each. The tables of ids, names and positions may repeat columns' names of the input: only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm.arrow import U64, WORD_BASE, WORD_POWERS, mix, owners, slices, utf8, words
from curator.llm.spread import among, map_arrow
from curator.scratch import discard, materialize

WINDOW, ROUNDS = 35, 4
#: Odd multipliers that keep the parts of a name apart.
LEFT, RUN, SECOND = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0x165667B19E3779F9)


class Text:
    """The words of a slice of rows: each row's first word (one more than rows), names, and digests of ranges of them."""

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        self.start, self.end, self.first = words(raw, off)
        self.data, self.off = raw.tobytes(), off
        # how many words are followed by something else than one blank, up to each
        plain = (self.start[1:] - self.end[:-1] == 1) & (raw[np.minimum(self.end[:-1], len(raw) - 1)] == 0x20) if len(self.start) else np.zeros(0, bool)
        self.broken = np.concatenate([[0], np.cumsum(~plain)])

    def names(self) -> np.ndarray:
        rows = [self.data[a:b].split() for a, b in zip(self.off.tolist(), self.off[1:].tolist())]
        return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(rows)), U64, len(self.start))

    def digests(self, at: np.ndarray, n: np.ndarray | int, keys: list[bytes] | None = None) -> list[bytes]:
        """Of ``n`` words from each of ``at`` on, joined by one space, under ``keys`` where given."""
        data, digest = self.data, hashlib.blake2b
        parts = [data[a:e] for a, e in zip(self.start[at].tolist(), self.end[at + n - 1].tolist())]
        for i in np.flatnonzero(self.broken[at + n - 1] != self.broken[at]).tolist():
            parts[i] = b" ".join(parts[i].split())
        if keys is None:
            return [digest(p, digest_size=16).digest() for p in parts]
        return [digest(p, digest_size=16, key=k).digest() for p, k in zip(parts, keys)]


@dataclass
class Symbols:
    """Symbols of a slice: names, first word of each, and row of each."""

    name: np.ndarray
    start: np.ndarray
    row: np.ndarray


def runs(h: np.ndarray, row: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Maximal runs of equal words, and the run of each word."""
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(h)))
    name = np.where(length > 1, mix(h[start] + length.astype(U64) * RUN), h[start])
    return Symbols(name, start, row[start]), np.cumsum(new) - 1


def sides(name: np.ndarray, k: int) -> np.ndarray:
    """True: left side in round k."""
    return (mix(name ^ U64((k + 1) * WORD_BASE & (1 << 64) - 1)) & U64(1)).astype(bool)


def pairs(s: Symbols, left: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Every adjacent (left, right) pair becomes one symbol; also the new symbol of each old one."""
    second = np.append(False, left[:-1] & ~left[1:] & (s.row[1:] == s.row[:-1])) if len(left) else left
    head = np.flatnonzero(~second)
    joined = np.append(second[1:], False)[head] if len(left) else second
    name = s.name[head].copy()
    at = head[joined]
    name[joined] = mix(s.name[at] * LEFT + mix(s.name[at + 1]))
    return Symbols(name, s.start[head], s.row[head]), np.cumsum(~second) - 1


def preference(s: Symbols, words_in_all: int) -> np.ndarray:
    """Symbols in order of preference as anchors: long ones are shared by chance the least."""
    length = np.minimum(np.diff(np.append(s.start, words_in_all)), 255).astype(U64)
    return (U64(255) - length) << U64(56) | s.name >> U64(8)


def least(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each non-empty range of symbols the index of the least name, the leftmost of equals."""
    order = np.empty(len(name), np.int64)
    order[np.argsort(name, kind="stable")] = np.arange(len(name))
    table, step = [order], 1
    while step * 2 <= int((hi - lo).max(initial=1)):
        t = table[-1].copy()
        t[:-step] = np.minimum(t[:-step], t[step:])
        table.append(t)
        step *= 2
    level = np.frexp((hi - lo).astype(float))[1] - 1
    got = np.empty(len(lo), np.int64)
    for k, t in enumerate(table):
        here = level == k
        got[here] = np.minimum(t[lo[here]], t[hi[here] - (1 << k)])
    back = np.argsort(order)
    return back[got]


@dataclass
class Windows:
    """All windows of a slice: row, first word, name and offset of the anchor, index that groups stretches, and
    whether it lies in a run of one word."""

    row: np.ndarray
    word: np.ndarray
    name: np.ndarray
    offset: np.ndarray
    group: np.ndarray
    alike: np.ndarray


def windows(h: np.ndarray, first: np.ndarray, size: int, rounds: int) -> Windows:
    """Windows with their anchors. h: word hashes; first: each row's first word (one more than rows)."""
    row = owners(first)
    count = np.maximum(np.diff(first) - size + 1, 0)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    p = np.repeat(first[:-1], count) + nth
    s, of = runs(h, row)
    lo, hi = of[p] + 1, of[p + size - 1]  # the border runs may go on outside
    alike, run = of[p] == of[p + size - 1], of[p]
    for k in range(rounds):
        left = sides(s.name, k)
        full = lo < hi
        lo = lo + (full & ~left[np.minimum(lo, len(left) - 1)])
        hi = hi - (full & (lo < hi) & left[hi - 1])
        s, new = pairs(s, left)
        full = lo < hi
        lo, hi = np.where(full, new[np.minimum(lo, len(new) - 1)], 0), np.where(full, new[hi - 1] + 1, 0)
    total = sums(h)
    full = lo < hi
    name = window_hash(total, p, size)
    offset, group = np.zeros(len(p), np.int64), -1 - np.arange(len(p))
    group[alike] = -1 - len(p) - run[alike]
    a = least(preference(s, len(h)), lo[full], hi[full])
    name[full], offset[full], group[full] = s.name[a], s.start[a] - p[full], a
    return Windows(row[p], p, name, offset, group, alike)


def sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * WORD_POWERS.upto(len(h) + 1)[0][: len(h)], out=out[1:])
    return out


def window_hash(total: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """A name for the ``length`` words from each of ``at``."""
    return mix((total[at + length] - total[at]) * WORD_POWERS.upto(len(total))[1][at] ^ SECOND)


def sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Text]]:
    for part in slices(batch, "text"):
        yield part, Text(*utf8(part.column("text")))


def anchors(documents: DataFrame, size: int, rounds: int) -> DataFrame:
    """A row for each stretch: name, digest of the whole stretch and its anchor's place, row's id and tie, first window, windows."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, t in sliced(b):
            w = windows(t.names(), t.first, size, rounds)
            if not len(w.word):
                continue
            new = np.append(True, (w.group[1:] != w.group[:-1]) | (w.row[1:] != w.row[:-1]))
            second = np.append(False, new[:-1]) & ~new & w.alike  # two alike in one run prove each other
            at = np.flatnonzero(new | second)
            n = np.diff(np.append(at, len(new)))
            covered = np.where(w.alike[at], size, n + size - 1)
            whole = t.digests(w.word[at], covered, [b"%d" % o for o in w.offset[at].tolist()])
            take = pa.array(w.row[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.name[at].view(np.int64)), pa.array(whole, pa.binary()), part.column("doc_id").take(take), part.column("tie").take(take), pa.array((w.word[at] - t.first[w.row[at]]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["name", "whole", "doc_id", "tie", "p", "n"],
            )

    return map_arrow(documents, batch, f"name long, whole binary, doc_id {documents.schema['doc_id'].dataType.simpleString()}, tie long, p int, n int")


def window_rows(texts: DataFrame, size: int, rounds: int) -> DataFrame:
    """The windows of given stretches (column ``at``: arrays of first window, windows, name, copies), one row each."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, t in sliced(b):
            at = part.column("at")
            at = at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at
            count = np.diff(at.offsets.to_numpy())
            flat = at.flatten()
            p, n, name, times = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            row = np.repeat(np.repeat(np.arange(len(count)), count), n)
            which = np.repeat(np.arange(len(p)), n)
            q = p[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            for i in range(0, len(q), 100_000):
                j = slice(i, i + 100_000)
                take = pa.array(row[j])
                digest = t.digests(t.first[row[j]] + q[j], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[which[j]]), pa.array(digest, pa.binary()), part.column("doc_id").take(take), part.column("tie").take(take), pa.array(q[j].astype(np.int32)), pa.array(times[which[j]])],
                    ["name", "hash", "doc_id", "tie", "p", "times"],
                )

    return map_arrow(texts, batch, f"name long, hash binary, doc_id {kind}, tie long, p int, times long")


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["_id"]) & (a["tie"] == b["_tie"])


def with_lists(documents: DataFrame, lists: DataFrame, value) -> tuple[DataFrame, DataFrame]:
    """Rows of ``documents`` with the list ``at`` of their ``value``s, and the rows that surely have none."""
    by_row = lists.distinct().groupBy("doc_id", "tie").agg(F.collect_list(value).alias("at")).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "at")
    d = among(documents, F.xxhash64("doc_id", "tie"), lists.select(F.xxhash64("doc_id", "tie").alias("member")), lists.count())
    some, none = d.where("maybe_member").drop("maybe_member"), d.where("not maybe_member").drop("maybe_member")
    return some.join(by_row, same_row(some, by_row), "left").drop("_id", "_tie"), none


def repeated(documents: DataFrame, size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, tie, first window ``p`` and number ``n`` of the stretches of windows whose words also start elsewhere."""
    a = materialize(anchors(documents, size, rounds), "anchors")
    names = a.groupBy("name").agg(F.count("*").alias("total")).where("total > 1").select(F.col("name").alias("_name"))
    names = materialize(names, "shared-names")  # a side of its own, so that adaptive execution can split a hot name
    shared = materialize(a.join(names, a["name"] == names["_name"], "left_semi"), "shared-anchors")
    discard(a)
    place = F.struct("doc_id", "tie", "p", "n")
    kinds = materialize(shared.groupBy("name", "whole").agg(F.count("*").alias("times"), F.min(place).alias("one")), "stretches")
    k = kinds.where("times > 1").select(F.col("name").alias("_name"), F.col("whole").alias("_whole"))
    whole = shared.join(k, (shared["name"] == k["_name"]) & (shared["whole"] == k["_whole"]), "left_semi").select("doc_id", "tie", "p", "n")
    several = kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1").select(F.col("name").alias("_name"))
    ask = kinds.join(several, kinds["name"] == several["_name"], "left_semi")
    ask = materialize(ask.select("one.doc_id", "one.tie", "one.p", "one.n", "name", "times"), "to-compare")
    texts, _ = with_lists(documents, ask, F.struct("p", "n", "name", "times"))
    w = materialize(window_rows(texts.where("at is not null"), size, rounds), "windows")
    twice = w.groupBy("name", "hash").agg(F.count("*").alias("c")).where("c > 1").select(F.col("name").alias("_name"), F.col("hash").alias("_hash"))
    twice = materialize(twice, "equal-windows")
    single = w.where("times = 1")
    part = single.join(twice, (single["name"] == twice["_name"]) & (single["hash"] == twice["_hash"]), "left_semi").select("doc_id", "tie", "p", F.lit(1).alias("n"))
    found = materialize(whole.unionByName(part), "repeats")
    for table in (shared, kinds, ask, w):
        discard(table)
    return found


def substring_dedup(documents: DataFrame, size: int = WINDOW, rounds: int = ROUNDS, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), and with
    ``keep_text`` the kept words themselves as ``kept_text`` and removed word ranges as ``removed``."""
    d = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    hits, none = with_lists(d, repeated(d, size, rounds), F.struct("p", "n"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        marked = "at" in b.schema.names
        for part in slices(b, "text"):
            raw, off = utf8(part.column("text"))
            start, end, first = words(raw, off)
            gone = np.zeros(len(start) + 1, np.int64)
            if marked:
                lists = part.column("at").to_pylist()
                for i, ranges in enumerate(lists):
                    for r in ranges or ():
                        gone[first[i] + r["p"]] += 1
                        gone[min(first[i] + r["p"] + r["n"] + size - 1, len(start))] -= 1
            removed = np.cumsum(gone[:-1]) > 0
            data, ids = raw.tobytes(), range(len(first) - 1)
            kept, spans = [], []
            for i in ids:
                x = slice(first[i], first[i + 1])
                flag = removed[x]
                if flag.any():
                    kept.append(b" ".join([data[a:e] for a, e in zip(start[x][~flag].tolist(), end[x][~flag].tolist())]))
                else:
                    kept.append(b" ".join(data[start[x][0] : end[x][-1]].split()) if len(flag) else b"")
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
                spans.append(edge.tolist() if keep_text else None)
            n = np.diff(first)
            lost = np.add.reduceat(np.append(removed, False).astype(np.int64), first[:-1]) * (n > 0)
            columns = [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(lost), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns += [pa.array([k.decode() for k in kept]), pa.array(spans, pa.list_(pa.int64()))]
                names += ["kept_text", "removed"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, removed array<long>" * keep_text
    return map_arrow(hits, batch, schema).unionByName(map_arrow(none, batch, schema))
