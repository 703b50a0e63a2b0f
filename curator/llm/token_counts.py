"""Token counts of documents that are edited.

A document is kept as its text cut into pre-tokens, in leaves of about ``LEAF`` pre-tokens, with the characters and tokens of each
pre-token and a segment tree above the leaves whose nodes hold the characters and tokens below. Trees are rows of a table that is
written: ``count_trees`` makes it from documents, ``apply_edits`` makes the next one from a table of trees and edits, without
encoding what the edits leave alone, any number of times.

An edit is found by descending on characters. Pre-tokens are cut from left to right without looking back, so only the
region from the pre-token before the edit on is cut anew, and only until a new border meets an old one behind the edit; from there
on all pre-tokens are as before. New pre-tokens are encoded, the leaves concerned are replaced, and the sums on their
paths are updated. Counts equal those of encoding the edited text from scratch.

Cases. Null text counts as empty. An edit (start, end, insert) replaces characters start to end of the text that the edits
before it left; positions beyond the text are moved to its end, an end before its start counts as the start, null
inserts are empty and null positions 0. No edits, or null, leave the text as it is. Repeated rows are counted as often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm.arrow import slices
from curator.llm.bpe import MEMO, read_ranks
from curator.llm.spread import map_arrow
from curator.scratch import materialize

LEAF = 32


class Counter(dict):
    """Tokens of a pre-token, by the public library; as a dict the bounded memo of them."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        self.encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n


@lru_cache(2)
def counter(path: str, pattern: str) -> Counter:
    """One for each worker process."""
    return Counter(path, pattern)


@dataclass
class Leaf:
    """Some pre-tokens in a row: their text, and the characters and tokens of each."""

    text: str
    chars: np.ndarray
    counts: np.ndarray

    def pieces(self) -> list[tuple[str, int]]:
        end = list(accumulate(self.chars.tolist()))
        return [(self.text[a:e], c) for a, e, c in zip([0, *end], end, self.counts.tolist())]


class CountTree:
    """A document's pre-tokens with a segment tree of characters and tokens."""

    def __init__(self, tokens: Counter, leaves: list[Leaf], chars: list[int] | None = None, counts: list[int] | None = None) -> None:
        """From leaves, and the nodes' sums where they are known."""
        self.tokens, self.encoded = tokens, 0
        self._grow(leaves, chars, counts)

    @classmethod
    def of(cls, tokens: Counter, text: str) -> CountTree:
        pieces = [(p, tokens[p]) for p in tokens.pattern.findall(text)]
        return cls(tokens, [cls._leaf(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)])

    @staticmethod
    def _leaf(pieces: list[tuple[str, int]]) -> Leaf:
        return Leaf("".join([p for p, _ in pieces]), np.array([len(p) for p, _ in pieces], np.int32), np.array([c for _, c in pieces], np.int32))

    def _grow(self, leaves: list[Leaf], chars: list[int] | None = None, counts: list[int] | None = None) -> None:
        self.leaves = leaves or [self._leaf([])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        if chars is not None and counts is not None:
            self.chars, self.counts = chars, counts
            return
        self.chars, self.counts = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(len(self.leaves)):
            self._sum(i)
        for i in range(self.size - 1, 0, -1):
            self._join(i)

    def _sum(self, leaf: int) -> None:
        self.chars[self.size + leaf] = len(self.leaves[leaf].text)
        self.counts[self.size + leaf] = int(self.leaves[leaf].counts.sum())

    def _join(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.counts[i] = self.counts[2 * i] + self.counts[2 * i + 1]

    @property
    def total(self) -> int:
        return self.counts[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join([leaf.text for leaf in self.leaves])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last for the end) and the character where it starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def edit(self, start: int, end: int, insert: str) -> None:
        """Replace characters start to end by ``insert``."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, begin = self.find(max(start - 1, 0))
        while first and (start - begin <= 0 or self._before(first, start - begin) < 2):  # the pre-token before the edit may change
            first -= 1
            begin -= self.chars[self.size + first]
        last, _ = self.find(end)
        while True:
            old = [p for leaf in self.leaves[first : last + 1] for p in leaf.pieces()]
            whole = "".join([leaf.text for leaf in self.leaves[first : last + 1]])
            skip = self._skip(old, start - begin)
            kept = sum(len(p) for p, _ in old[:skip])
            changed = whole[kept : start - begin] + insert + whole[end - begin :]
            complete = last + 1 >= len(self.leaves)
            new = self._cut(old, skip, kept, changed, len(insert) - (end - start), start - begin - kept + len(insert), complete)
            if new is not None:
                break
            last = min(len(self.leaves) - 1, 2 * last - first + 1)  # twice as many, so that a long region is cut few times
        self._put(first, last, new)

    def _before(self, leaf: int, chars: int) -> int:
        """Whole pre-tokens of the leaf's first ``chars`` characters."""
        n = 0
        for p in self.leaves[leaf].chars.tolist():
            chars -= p
            if chars < 0:
                break
            n += 1
        return n

    @staticmethod
    def _skip(old: list[tuple[str, int]], chars: int) -> int:
        """Pre-tokens that stay in front: all but the last two that end at or before the edit."""
        n = 0
        for p, _ in old:
            if len(p) > chars:
                break
            chars -= len(p)
            n += 1
        return max(n - 2, 0)

    def _cut(self, old: list[tuple[str, int]], skip: int, kept: int, changed: str, shift: int, edited: int, complete: bool) -> list[tuple[str, int]] | None:
        """Pre-tokens of the leaves after the edit; None if the text at hand ends too early to know."""
        borders, at = {}, kept
        for i in range(skip, len(old)):
            borders[at] = i
            at += len(old[i][0])
        new: list[str] = []
        rest = None
        for m in self.tokens.pattern.finditer(changed):
            if m.start() >= edited and (rest := borders.get(kept + m.start() - shift)) is not None:
                break
            if not complete and m.end() > len(changed) - 2:
                return None
            new.append(m[0])
        if rest is None and not complete:
            return None
        self.encoded += len(new)
        return old[:skip] + [(p, self.tokens[p]) for p in new] + (old[rest:] if rest is not None else [])

    def _put(self, first: int, last: int, pieces: list[tuple[str, int]]) -> None:
        n = last - first + 1
        if len(pieces) > 4 * LEAF * n:
            new = [self._leaf(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]
            self._grow(self.leaves[:first] + new + self.leaves[last + 1 :])
            return
        share = -(-len(pieces) // n)
        for k, leaf in enumerate(range(first, last + 1)):
            self.leaves[leaf] = self._leaf(pieces[k * share : (k + 1) * share])
            self._sum(leaf)
        nodes = {(self.size + leaf) // 2 for leaf in range(first, last + 1)}
        while nodes - {0}:
            for i in nodes:
                self._join(i)
            nodes = {i // 2 for i in nodes} - {0}


EDITS = "array<struct<start: bigint, end: bigint, insert: string>>"


#: A tree: leaves one after the other (text, and pre-tokens of each), characters and tokens of all pre-tokens, and the nodes' sums from the root on.
TREE = "leaves array<string>, pieces array<int>, chars array<int>, counts array<int>, node_chars array<int>, node_counts array<int>"


def _list(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """An array of lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32)))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *parts])


def _stored(trees: list[CountTree]) -> list[pa.Array]:
    """The columns of ``TREE``."""
    leaves = [leaf for t in trees for leaf in t.leaves]
    many = np.array([len(t.leaves) for t in trees], np.int64)
    pieces = np.array([len(leaf.chars) for leaf in leaves], np.int64)
    of = np.add.reduceat(pieces, np.cumsum(many) - many) if len(many) else many
    nodes = np.array([2 * t.size for t in trees], np.int64)
    return [
        _list(pa.array([leaf.text for leaf in leaves], pa.string()), many),
        _list(pieces, many),
        _list(_joined([leaf.chars for leaf in leaves]), of),
        _list(_joined([leaf.counts for leaf in leaves]), of),
        _list(np.fromiter(chain.from_iterable([t.chars for t in trees]), np.int32, nodes.sum()), nodes),
        _list(np.fromiter(chain.from_iterable([t.counts for t in trees]), np.int32, nodes.sum()), nodes),
    ]


def _built(tokens: Counter, texts: list[str]) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """The columns of ``TREE`` for new texts, and their tokens and characters, by whole arrays."""
    found = [tokens.pattern.findall(t) for t in texts]
    of = np.fromiter(map(len, found), np.int64, len(found))
    flat = list(chain.from_iterable(found))
    chars, counts = np.fromiter(map(len, flat), np.int64, len(flat)), np.fromiter(map(tokens.__getitem__, flat), np.int64, len(flat))
    many = np.maximum(-(-of // LEAF), 1)
    pieces = np.full(many.sum(), LEAF)
    pieces[np.cumsum(many) - 1] = of - (many - 1) * LEAF  # the last leaf of each
    end = np.cumsum(pieces)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], end])])
    leaf_chars, leaf_counts = total(chars), total(counts)
    size = 1 << np.array([(n - 1).bit_length() for n in many.tolist()], np.int64)
    node_chars, node_counts, leaves, at = [], [], [], 0
    for text, n, s in zip(texts, many.tolist(), size.tolist()):
        cut = [0, *np.cumsum(leaf_chars[at : at + n]).tolist()]
        leaves += [text[a:b] for a, b in zip(cut, cut[1:])]
        for sums, out in ((leaf_chars, node_chars), (leaf_counts, node_counts)):
            nodes = np.zeros(2 * s, np.int64)
            nodes[s : s + n] = sums[at : at + n]
            level = s
            while level > 1:
                nodes[level // 2 : level] = nodes[level : 2 * level : 2] + nodes[level + 1 : 2 * level : 2]
                level //= 2
            out.append(nodes)
        at += n
    columns = [_list(pa.array(leaves, pa.string()), many), _list(pieces, many), _list(chars, of), _list(counts, of), _list(_joined(node_chars), 2 * size), _list(_joined(node_counts), 2 * size)]
    first = lambda x: np.array([int(n[1]) for n in x], np.int64)
    return columns, first(node_counts), first(node_chars)


def _loaded(tokens: Counter, rows: pa.RecordBatch) -> Iterator[CountTree]:
    """Trees of stored rows; what no edit touches stays as the arrays it is."""
    lists = {}
    for name in NAMES:
        column = rows.column(name)
        values = column.flatten()
        lists[name] = (column.offsets.to_numpy() - column.offsets[0].as_py(), values.to_pylist() if name == "leaves" else values.to_numpy(zero_copy_only=False))
    of = lambda name, i: lists[name][1][lists[name][0][i] : lists[name][0][i + 1]]
    for i in range(rows.num_rows):
        chars, counts = of("chars", i), of("counts", i)
        end = np.cumsum(of("pieces", i)).tolist()
        leaves = [Leaf(t, chars[a:e], counts[a:e]) for t, a, e in zip(of("leaves", i), [0, *end], end)]
        yield CountTree(tokens, leaves, of("node_chars", i).tolist(), of("node_counts", i).tolist())


def count_trees(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """A tree for each row: doc_id, tie (hash of the text), n_tokens, n_chars and the columns of ``TREE``; to be written and given to ``apply_edits``."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = counter(path, pattern)
        for part in slices(b, "text", 500_000):
            columns, n_tokens, n_chars = _built(tokens, [t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(n_tokens), pa.array(n_chars), *columns], ["doc_id", "tie", "n_tokens", "n_chars", *NAMES])

    d = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    return map_arrow(d, batch, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, tie long, n_tokens long, n_chars long, {TREE}")


NAMES = ["leaves", "pieces", "chars", "counts", "node_chars", "node_counts"]


def apply_edits(trees: DataFrame, path: str, pattern: str, edits: str = "edits", keep_trees: bool = True) -> DataFrame:
    """The trees after their edits: doc_id, tie (as it was), n_tokens_before, n_tokens, n_chars, n_encoded (pre-tokens encoded anew) and the tree.

    ``edits`` names a column of structs (start, end, insert), applied in their order. Without ``keep_trees`` only the numbers are returned.
    """

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = counter(path, pattern)
        for i in range(0, b.num_rows, 50):
            part = b.slice(i, 50)
            done, rows = [], []
            for tree, changes in zip(_loaded(tokens, part), part.column("edits").to_pylist()):
                before = tree.total
                for e in changes or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["insert"] or "")
                rows.append((before, tree.total, tree.length, tree.encoded))
                if keep_trees:
                    done.append(tree)
            columns = [part.column("doc_id"), part.column("tie"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))]
            names = ["doc_id", "tie", "n_tokens_before", "n_tokens", "n_chars", "n_encoded"]
            yield pa.RecordBatch.from_arrays(columns + (_stored(done) if keep_trees else []), names + (NAMES if keep_trees else []))

    d = trees.select("doc_id", "tie", *NAMES, F.col(edits).cast(EDITS).alias("edits"))
    kind = trees.schema["doc_id"].dataType.simpleString()
    return map_arrow(d, batch, f"doc_id {kind}, tie long, n_tokens_before long, n_tokens long, n_chars long, n_encoded long" + f", {TREE}" * keep_trees)


def sample_edits(trees: DataFrame, per_document: int = 3) -> DataFrame:
    """``trees`` with ``per_document`` edits each that follow from a hash of doc_id: a replacement, an insertion and a deletion in turn."""
    each = []
    for k in range(per_document):
        at = F.pmod(F.xxhash64("doc_id", F.lit(k)), F.col("n_chars") + 1)
        gone = F.lit((8, 0, 40)[k % 3])
        each.append(F.struct(at.alias("start"), (at + gone).alias("end"), F.lit(("a new word", " inserted, it's here ", "")[k % 3]).alias("insert")))
    return trees.withColumn("edits", F.array(*each))


def count_sampled_edits(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_chars_after and n_encoded of every row: trees are written, then read and edited."""
    trees = materialize(count_trees(documents, path, pattern), "count-trees", "zstd")
    done = apply_edits(sample_edits(trees), path, pattern, keep_trees=False)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), F.col("n_chars").alias("n_chars_after"), "n_encoded")
