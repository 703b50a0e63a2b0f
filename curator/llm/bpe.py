"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token's bytes there is exactly one last token that its encoding can end in: the token
``t`` that ends there, whose start is a prefix with last token ``s``, such that ``s`` and ``t`` can stand side by
side (their bytes together encode to just these two). The table of these last tokens is the encoding of every
prefix at once, and pre-tokens that begin alike share it: a worker keeps the last tokens of the prefixes it has
asked for. A prefix is asked for its last token only where a token that begins behind it is in question, so most of a pre-token's prefixes
are never looked at. Bytes are appended exactly by extending it, and after an edit it is recomputed from the edit only until it agrees
again with the old table over the longest token's length.

``s, t`` can stand side by side iff no merge ever crosses their border. The pieces that touch the border while
the two are built are the right spine of ``s`` and the left spine of ``t``; a crossing merge happens iff its rank comes
before the next merge on the left and not after the next merge on the right. Ranks are read from a public vocabulary
file whose path is a parameter; a pre-token that is itself in the vocabulary is that one token.

Cases. Null text counts as empty, and an empty text has no tokens. Special tokens are never produced from text. Very long
pre-tokens take time in proportion to their length. Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from curator.llm.spread import map_arrow

#: Entries of a worker's memo of pre-tokens, and of its table of prefixes; either is emptied when full.
MEMO, PREFIXES = 200_000, 300_000
#: The longest pre-token, in bytes, whose prefixes are kept for others.
SHARED = 64


class Vocabulary:
    """Ranks with the spines of every token that merges can build."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {t: b for b, t in ranks.items()}
        self.left: dict[int, list[int]] = {}
        self.right: dict[int, list[int]] = {}
        self.built: dict[bytes, int] = {}
        self.pairs: dict[int, bool] = {}  # by (left << 20) + right
        self.reach: dict[bytes, int] = {}  # by the last three bytes, the longest token's length
        for token in sorted(self.bytes_of):
            b = self.bytes_of[token]
            parts = self.halves(b, token)
            if parts is None:
                continue
            a, c = parts
            self.built[b] = token
            self.reach[b[-3:]] = max(self.reach.get(b[-3:], 0), len(b))
            self.left[token] = [*self.left.get(a, ()), token]
            self.right[token] = [*self.right.get(c, ()), token]
        self.longest = max(map(len, self.built), default=1)

    def halves(self, b: bytes, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``b``; None if merging the bytes does not end in ``b``."""
        if len(b) == 1:
            return -1, -1
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return None
            if len(parts) == 2:
                return (self.ranks[parts[0]], self.ranks[parts[1]]) if best == token else None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def side_by_side(self, s: int, t: int) -> bool:
        """True if no merge crosses the border of ``s`` and ``t``."""
        known = self.pairs.get((s << 20) + t)
        if known is None:
            if len(self.pairs) > 250_000:
                self.pairs.clear()
            known = self.pairs[(s << 20) + t] = self._apart(s, t)
        return known

    def _apart(self, s: int, t: int) -> bool:
        bytes_of, ranks, never = self.bytes_of, self.ranks, 1 << 62
        before, after = self.right[s], self.left[t]
        i = j = 0
        while True:
            next_left = before[i + 1] if i + 1 < len(before) else never
            next_right = after[j + 1] if j + 1 < len(after) else never
            across = ranks.get(bytes_of[before[i]] + bytes_of[after[j]])
            if across is not None and across < next_left and across <= next_right:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


class Prefixes:
    """The last token of every prefix of ``data``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _last(self, data: bytes, last: list[int], j: int) -> int:
        built, known = self.v.built, self.v.pairs
        for i in range(max(0, j - self.v.reach.get(data[max(j - 3, 0) : j], 2)), j):  # it is mostly the longest
            t = built.get(data[i:j])
            if t is None:
                continue
            if not i:
                return t
            fits = known.get((last[i] << 20) + t)
            if fits or fits is None and self.v.side_by_side(last[i], t):
                return t
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Extend the table; what is there stays as it is."""
        n, self.data = len(self.data), self.data + more
        for j in range(n + 1, len(self.data) + 1):
            self.last.append(self._last(self.data, self.last, j))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        same = 0
        for j in range(start + 1, len(self.data) + 1):
            t = self._last(self.data, self.last, j)
            self.last.append(t)
            same = same + 1 if j > start + len(new) and old[j - shift] == t else 0
            if same >= self.v.longest:
                self.last += old[j - shift + 1 :]
                return j - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, j = [], len(self.data)
        while j:
            out.append(self.last[j])
            j -= len(self.v.bytes_of[self.last[j]])
        return out[::-1]


class Encoder(dict):
    """Encodes texts; as a dict it is the memo of pre-tokens, bounded by ``MEMO``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        if max(ranks.values(), default=0) >= 1 << 20:
            raise ValueError("ranks must be below 2**20")
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.table = self.vocabulary.bytes_of
        self.size = {t: len(b) for t, b in self.table.items()}
        self.decimal = {t: str(t) for t in self.table}
        self.prefixes: dict[bytes, int] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        if whole is None and len(data) > SHARED:
            return tuple(Prefixes(self.vocabulary, data).ids())
        if len(self) >= MEMO:
            self.clear()
        if len(self.prefixes) >= PREFIXES:
            self.prefixes.clear()
        ids = self[piece] = (whole,) if whole is not None else self._ids(data)
        return ids

    def _ids(self, data: bytes) -> tuple[int, ...]:
        out, j, size = [], len(data), self.size
        while j:
            t = self._last(data[:j])
            out.append(t)
            j -= size[t]
        return tuple(out[::-1])

    def _last(self, prefix: bytes) -> int:
        """The last token of a prefix, from the table or from the tokens it may end in, the longest first."""
        known = self.prefixes.get(prefix)
        if known is not None:
            return known
        v, n = self.vocabulary, len(prefix)
        built, pairs = v.built, v.pairs
        for i in range(max(0, n - v.reach.get(prefix[-3:], 2)), n):
            t = built.get(prefix[i:])
            if t is None:
                continue
            if i:
                s = self._last(prefix[:i])
                fits = pairs.get((s << 20) + t)
                if not (v.side_by_side(s, t) if fits is None else fits):
                    continue
            self.prefixes[prefix] = t
            return t
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(read_ranks(path), pattern)


def encode_and_decode(documents: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids themselves.

    ``path`` names a vocabulary file that is installed on every worker.
    """

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for text in part.column("text").to_pylist():
                ids = e.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(e.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), batch, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
