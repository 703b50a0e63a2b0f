"""Benchmark passages in documents, by q-gram filtering and banded alignment.

Texts are compared as lower-cased letters and digits without what lies between them. Benchmark items are cut into
overlapping pieces of ``piece`` characters (shorter items are one piece), and from every word on into pieces of ``run`` words
(where they have over 3 ``piece`` characters, from every q characters on into ``piece``), so that any ``run`` words of an item in a row are found wherever they begin. If a piece of m
characters occurs in a document with at most e edits, the two share at least ``m - q + 1 - q e`` q-grams, and all
of them lie within e + 1 neighbouring diagonals (document position minus piece position). Shared q-grams are counted in
bands of 2 (e + 1) diagonals that overlap by half, so one band holds them all; bands below that bound are
discarded without loss, and what is left is verified by aligning the piece within the band.

A piece of words is also found if one word between its first and its last was replaced by 1 to ``OTHER`` characters and all others
are as they were. The longer side of the word then is whole, on one diagonal, and shares all of its q-grams: the bound is the least of
these numbers over the words, if lower. A word that leaves under q characters on both sides is not looked for that way.

An item under ``least`` compared characters is found where it stands unchanged between word borders. One under q characters has no
q-gram and is found where it is all of a document, as elsewhere it could not be told from chance.

Items are asked before their pieces: an item's q-grams are kept once, counted in bands as wide as its piece with most edits needs, and held
against the least number that any of its pieces needs. Only of items that pass are pieces made and counted, on the document that shares them.

The benchmark is a stated query set: it is read in blocks of about ``BLOCK_CHARS`` characters, chosen by hash after its size was
measured, and each block is searched in one pass over the documents, without a shuffle. Blocks are searched one after the other: only
one is on the driver and the executors at a time, about 20 bytes for each of its characters.

Cases. Null and empty texts contain nothing, and null and empty items are in nothing. A null item_id or doc_id is carried as it is. Equal
items (id and text) are one; items that share an id only are items of their own, with rows of their own. Repeated documents give
repeated rows. Very long texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from curator.llm.arrow import U64, WORD_BASE, mix, slices
from curator.llm.chars import points, tables
from curator.llm.spread import drop_rows, map_arrow
from curator.scratch import materialize

Q, PIECE, LEAST, EDIT_RATE, BLOCK_CHARS = 12, 80, 30, 0.06, 4_000_000
#: Words of a piece, and the most characters that replace one.
RUN, OTHER = 13, 24
#: Binary logarithms of the bit map of an item's q-grams, and of the largest of a block's.
TABLE_BITS, BLOCK_BITS = 16, 27
#: Items whose pieces a worker keeps.
KEPT = 100
#: Shared q-grams counted at a time.
HITS = 2_000_000


def compared(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters and digits, each one's place among all characters, first of each text, offsets of texts."""
    lower, _, alnum = tables()
    p, off = points(texts)
    at = np.flatnonzero(alnum[p])
    return lower[p[at]], at, np.searchsorted(at, off), off


def qgrams(c: np.ndarray, q: int) -> np.ndarray:
    if len(c) < q:
        return np.zeros(0, U64)
    n = len(c) - q + 1
    h = c[:n].astype(U64)
    for i in range(1, q):
        h *= U64(WORD_BASE)
        h += c[i : n + i]
    return mix(h)


def cut(text: str, a: int, b: int, at: np.ndarray, off: int, q: int, piece: int, least: int, run: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, words that may be replaced) of each piece of an item whose compared characters are a to b; words' places count from the piece's start."""
    if b - a < max(least, q):
        return [(a, b, [])] if a < b else []
    places = {(s, min(s + piece, b)): [] for s in [*range(a, b - piece, piece // 2), max(a, b - piece)]}
    begin = [w.start() for w in re.finditer(r"\S+", text)]
    word = [*(a + np.searchsorted(at[a:b] - off, begin)).tolist(), b]
    for k, s in enumerate(word[:-1]):
        whole = word[k + run] if k + run <= len(begin) else b + 4096
        if whole - s <= 3 * piece:
            if whole - s >= max(least, q):
                places[s, whole] = [(u - s, v - s) for u, v in zip(word[k + 1 :], word[k + 2 :]) if s < u < v < whole]
            continue
        for x in range(s, min(word[k + 1], b - piece + 1), q):  # words this long are a script without spaces
            places.setdefault((x, x + piece), [])
    if len(begin) <= run and (a, b) in places:
        places[a, b] = [(u - a, v - a) for u, v in zip(word[1:], word[2:]) if a < u < v < b]
    return [(s, e, [(u, v) for u, v in words if max(u, e - s - v) >= q]) for (s, e), words in places.items()]


def budget(m: int, inner: list[tuple[int, int]], q: int, least: int, rate: float) -> tuple[int, int]:
    """Edits that a piece of ``m`` characters may have, and q-grams that it then shares at least."""
    edits = 0 if m < max(least, q) else min(int(m * rate), (m - q) // q)  # a bound under one q-gram would filter nothing
    return edits, min([m - q + 1 - q * edits, *[max(u, m - v) - q + 1 for u, v in inner]])


@dataclass
class Pieces:
    """Pieces of a few items with their edit budgets, and the places of all their q-grams."""

    items: list  # their ids
    item: np.ndarray  # number of each piece's item
    chars: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    gram: np.ndarray  # sorted
    owner: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # a bit map of the q-grams' low bits
    inner: list[list[tuple[int, int]]]  # starts and ends of the words that may be replaced
    least: int  # pieces with fewer characters stand between word borders
    whole: dict[bytes, list[int]]  # pieces that are all of a text

    @classmethod
    def of(cls, items: list[tuple], q: int = Q, piece: int = PIECE, least: int = LEAST, rate: float = EDIT_RATE, run: int = RUN) -> Pieces:
        c, at, first, off = compared([t or "" for _, t in items])
        ids, chars, inner, all_of = [], [], [], {}
        for n, ((_, t), a, b) in enumerate(zip(items, first.tolist(), first[1:].tolist())):
            for s, e, words in cut(t or "", a, b, at, int(off[n]), q, piece, least, run):
                if b - a < q:
                    all_of.setdefault(c[s:e].tobytes(), []).append(len(ids))
                ids.append(n)
                chars.append(c[s:e])
                inner.append(words)
        budgets = np.array([budget(len(x), w, q, least, rate) for x, w in zip(chars, inner)], np.int64).reshape(-1, 2)
        grams = [qgrams(x, q) for x in chars]
        gram = np.concatenate([np.zeros(0, U64), *grams])
        owner = np.repeat(np.arange(len(chars), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int16), *[np.arange(len(g), dtype=np.int16) for g in grams]])
        order = np.argsort(gram, kind="stable")
        seen = np.zeros(1 << TABLE_BITS, bool)
        seen[(gram & U64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
        return cls([i for i, _ in items], np.array(ids, np.int64), chars, budgets[:, 0], budgets[:, 1], gram[order], owner[order], place[order], seen, inner, max(least, q), all_of)


@dataclass
class Block:
    """Items of a block: the places of their q-grams, and what any of their pieces needs."""

    items: list[tuple]  # (id, text)
    gram: np.ndarray  # sorted
    item: np.ndarray
    place: np.ndarray
    need: np.ndarray  # by item: the least of its pieces
    width: np.ndarray  # by item: the most edits of a piece, and one
    longest: int
    seen: np.ndarray  # bits, packed
    whole: dict[bytes, list[int]]

    @classmethod
    def of(cls, items: list[tuple], q: int = Q, piece: int = PIECE, least: int = LEAST, rate: float = EDIT_RATE, run: int = RUN) -> Block:
        c, at, first, off = compared([t or "" for _, t in items])
        need, width, all_of = np.ones(len(items), np.int64), np.ones(len(items), np.int64), {}
        for n, ((_, t), a, b) in enumerate(zip(items, first.tolist(), first[1:].tolist())):
            budgets = [budget(e - s, words, q, least, rate) for s, e, words in cut(t or "", a, b, at, int(off[n]), q, piece, least, run)]
            if 0 < b - a < q:
                all_of.setdefault(c[a:b].tobytes(), []).append(n)
            elif budgets:
                need[n], width[n] = min(x for _, x in budgets), max(e for e, _ in budgets) + 1
        h = qgrams(c, q)
        p = np.arange(len(h))
        n = np.searchsorted(first, p, "right") - 1
        inside = p + q <= first[np.minimum(n + 1, len(first) - 1)]
        h, n, p = h[inside], n[inside], p[inside]
        order = np.argsort(h, kind="stable")
        bits = min(max(16, (64 * len(h)).bit_length()), BLOCK_BITS)
        seen = np.zeros(1 << bits - 3, np.uint8)
        slot = (h & U64((1 << bits) - 1)).astype(np.int64)
        np.bitwise_or.at(seen, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        return cls(items, h[order], n[order].astype(np.int32), (p - first[n])[order].astype(np.int32), need, width, int(np.diff(first).max(initial=0)), seen, all_of)

    def pieces(self, n: int) -> Pieces:
        """The pieces of item ``n``, which a worker keeps for some items."""
        kept = self.__dict__.setdefault("_kept", {})
        if n not in kept:
            if len(kept) >= KEPT:
                kept.clear()
            kept[n] = Pieces.of([self.items[n]])
        return kept[n]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}


def align(piece: np.ndarray, text: np.ndarray, most: int, low: int, high: int) -> tuple[int, int] | None:
    """Least edits of ``piece`` against a part of ``text``, on diagonals ``low`` to ``high`` only, and where that part ends.

    None if more than ``most``. The part may start and end anywhere.
    """
    n, width = len(text), high - low + 1
    over = most + 1
    row = [0 if 0 <= d <= n else over for d in range(low, high + 1)]
    t, p = text.tolist(), piece.tolist()
    for i, ch in enumerate(p, 1):
        new = []
        for k in range(width):
            j = i + low + k
            if not 0 <= j <= n:
                new.append(over)
                continue
            best = row[k] + (t[j - 1] != ch) if j else over
            if k + 1 < width:
                best = min(best, row[k + 1] + 1)
            if k:
                best = min(best, new[k - 1] + 1)
            new.append(min(best, over))
        row = new
        if min(row) > most:
            return None
    edits = min(row)
    return edits, len(p) + low + row.index(edits)


def equal(piece: np.ndarray, text: np.ndarray, low: int, high: int) -> int | None:
    """Where ``piece`` ends in ``text`` if it is there unchanged, on a diagonal of ``low`` to ``high``."""
    n = len(piece)
    for d in range(max(low, 0), min(high, len(text) - n) + 1):
        if text[d] == piece[0] and np.array_equal(text[d : d + n], piece):
            return d + n
    return None


def replaced(piece: np.ndarray, inner: list[tuple[int, int]], text: np.ndarray, low: int, high: int, most: int = OTHER) -> tuple[int, int, int] | None:
    """Start, end and edits of ``piece`` in ``text`` with one of its ``inner`` words replaced, one side of it on a diagonal of ``low`` to ``high``."""
    n, m = len(text), len(piece)
    for d in range(low, high + 1):
        # what agrees with the text from the first character on, and from the last one back
        x, y = max(0, -d), min(m, n - d)
        if y - x < 1:
            continue
        differ = np.flatnonzero(text[x + d : y + d] != piece[x:y]) + x
        head = 0 if x else int(differ[0]) if len(differ) else y
        tail = m if y < m else int(differ[-1]) + 1 if len(differ) else x
        for u, v in inner:
            if u <= head:
                for g in range(1, most + 1):
                    s = d + u + g
                    if s + m - v <= n and np.array_equal(text[s : s + m - v], piece[v:]):
                        return d, s + m - v, max(v - u, g)
            if v >= tail:
                for g in range(1, most + 1):
                    s = d + v - g - u
                    if s >= 0 and np.array_equal(text[s : s + u], piece[:u]):
                        return s, d + m, max(v - u, g)
    return None


def met(c: np.ndarray, first: np.ndarray, q: int, gram: np.ndarray, maybe: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, text, first entry in ``gram`` and number of entries of each q-gram of the texts that is in ``gram``."""
    h = qgrams(c, q)
    p = np.flatnonzero(maybe(h))
    left = np.searchsorted(gram, h[p], "left")
    count = np.searchsorted(gram, h[p], "right") - left
    p, left, count = p[count > 0], left[count > 0], count[count > 0]
    doc = np.searchsorted(first, p, "right") - 1
    whole = p + q <= first[doc + 1]
    return p[whole], doc[whole], left[whole], count[whole]


def banded(p: np.ndarray, doc: np.ndarray, left: np.ndarray, count: np.ndarray, first: np.ndarray, owner: np.ndarray, place: np.ndarray, width: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, owner, band) with hits, and their number of hits. A band has twice its owner's ``width`` of diagonals; diagonals count from ``-base``."""
    keys, numbers = [np.zeros((3, 0), np.int64)], [np.zeros(0, np.int64)]
    end = np.cumsum(count)
    cuts = [0, *(np.flatnonzero(np.diff(end // HITS)) + 1).tolist(), len(p)]
    for a, b in zip(cuts, cuts[1:]):
        n = count[a:b]
        hit = np.repeat(left[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        o, d = owner[hit].astype(np.int64), np.repeat(doc[a:b], n)
        band = (np.repeat(p[a:b] - first[doc[a:b]], n) - place[hit] + base) // width[o]
        key = np.stack([np.concatenate([d, d]), np.concatenate([o, o]), np.concatenate([band, band - 1])])
        key = key[:, np.lexsort(key[::-1])]
        new = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if key.shape[1] else np.zeros(0, int)
        keys.append(key[:, new])
        numbers.append(np.diff(np.append(new, key.shape[1])))
    key, number = np.concatenate(keys, axis=1), np.concatenate(numbers)
    if len(keys) > 2:
        key, back = np.unique(key, axis=1, return_inverse=True)
        number = np.bincount(back.ravel(), weights=number).astype(np.int64)
    return key, number


def candidates(texts: list[str], block: Block, q: int = Q) -> list[tuple[int, int]]:
    """(text, item) of all items of which a piece may be in the text."""
    c, _, first, _ = compared(texts)
    size = np.diff(first)
    out = set()
    for d in np.flatnonzero((size > 0) & (size < q)).tolist() if block.whole else ():
        out |= {(d, i) for i in block.whole.get(c[int(first[d]) : int(first[d + 1])].tobytes(), ())}

    def maybe(h: np.ndarray) -> np.ndarray:
        slot = (h & U64(8 * len(block.seen) - 1)).astype(np.int64)
        return block.seen[slot >> 3] >> (slot & 7).astype(np.uint8) & 1

    key, number = banded(*met(c, first, q, block.gram, maybe), first, block.item, block.place, block.width, block.longest)
    key = key[:, number >= block.need[key[1]]]
    return sorted(out | set(zip(key[0].tolist(), key[1].tolist())))


def regions(texts: list[str], pieces: Pieces, q: int = Q) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, piece, start, end, edits) of every verified occurrence; start and end count characters of the text."""
    c, at, first, off = compared(texts)
    size = np.diff(first)
    for d in np.flatnonzero((size > 0) & (size < q)).tolist() if pieces.whole else ():
        a, b = int(first[d]), int(first[d + 1])
        for o in pieces.whole.get(c[a:b].tobytes(), ()):
            yield d, o, int(at[a] - off[d]), int(at[b - 1] - off[d] + 1), 0
    seen = lambda h: pieces.seen[(h & U64((1 << TABLE_BITS) - 1)).astype(np.int64)]
    key, number = banded(*met(c, first, q, pieces.gram, seen), first, pieces.owner, pieces.place, pieces.edits + 1, 4096)  # pieces are shorter
    key = key[:, number >= pieces.need[key[1]]]
    done: set[tuple[int, int, int]] = set()
    for d, o, band in key.T.tolist():
        e, x = int(pieces.edits[o]), pieces.chars[o]
        low = band * (e + 1) - 4096
        a = int(first[d])
        text = c[max(a, a + low - e) : min(int(first[d + 1]), a + low + 2 * e + 1 + len(x) + e)]
        shift = max(0, low - e)
        stop = equal(x, text, low - shift, low + 2 * e + 1 - shift)
        found = (0, stop) if stop is not None else align(x, text, e, low - e - shift, low + 2 * e + 1 + e - shift)
        if found is None:
            wide = max(0, low - OTHER - len(x))  # the other side may lie on a diagonal further off
            text = c[a + wide : min(int(first[d + 1]), a + max(0, low + 2 * e + 1) + len(x) + OTHER)]
            other = replaced(x, pieces.inner[o], text, low - wide, low + 2 * e + 1 - wide) if pieces.inner[o] else None
            if other is None:
                continue
            start, stop, edits = wide + other[0], wide + other[1], other[2]
        else:
            edits, stop = found
            stop += shift
            start = max(0, stop - len(x) - e) if edits else stop - len(x)
        if len(x) < pieces.least:
            i, j = a + start, a + stop
            if start and at[i] - at[i - 1] == 1 or j < first[d + 1] and at[j] - at[j - 1] == 1:
                continue  # within a word
        if (d, o, stop) not in done:
            done.add((d, o, stop))
            yield d, o, int(at[a + start] - off[d]), int(at[a + stop - 1] - off[d] + 1), edits


def search(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that share a region: doc_id, tie, item_id, pieces found, first start, last end, least edits."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    d = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    id_type, item_type = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {id_type}, tie long, item_id {item_type.simpleString()}, pieces int, start int, end int, edits int"
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        sent = d.sparkSession.sparkContext.broadcast(Block.of(sorted(((r.item_id, r.text) for r in block.collect()), key=str)))
        found = map_arrow(d, _searcher(sent, to_arrow_type(item_type)), schema)
        if blocks > 1:
            found = materialize(found, "benchmark-block")
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(sent, item_type: pa.DataType):
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for part in slices(b, "text", 1_000_000):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = []
            for d, i in candidates(texts, block):
                r = list(regions([texts[d]], block.pieces(i)))
                if r:
                    found.append((d, block.items[i][0], len(r), min(x[2] for x in r), max(x[3] for x in r), min(x[4] for x in r)))
            if found:
                take = pa.array([f[0] for f in found], pa.int64())
                columns = [part.column("doc_id").take(take), part.column("tie").take(take), pa.array([f[1] for f in found], item_type)]
                columns += [pa.array([f[k] for f in found], pa.int32()) for k in range(2, 6)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "item_id", "pieces", "start", "end", "edits"])

    return run


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that contain a region of a benchmark item."""
    return drop_rows(documents, search(documents, benchmark).select("doc_id", "tie", F.lit(False).alias("keep_one")).distinct())
