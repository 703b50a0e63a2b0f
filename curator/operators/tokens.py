"""A word tokenizer as an adapter: encoding, decoding, control ids and an identity that follows from all of its parts.

Ids are ranks in a vocabulary from 1 on and 0 for words outside it. Control ids follow the base vocabulary and are never made
from text. Another tokenizer is another adapter with the same four functions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.operators.words import limit_batches, offsets, word_counts

#: Names of the control ids, in their order behind the base vocabulary.
CONTROL = ("<eos>", "<pad>", "<system>", "<user>", "<assistant>", "<tool_call>", "<tool>")
RULES = {"document": "words then <eos>", "turn": "marker then words", "words": "lower-cased NFC runs of letters, marks and digits"}
TRAINABLE = ("assistant", "tool_call")
UNKNOWN = "<unk>"


class TokenizerError(Exception):
    """A tokenizer is not the pinned one."""


def ranked_words(docs: DataFrame, size: int) -> DataFrame:
    """(word, id) of the ``size`` most frequent words of ``docs.w``: a table of that many rows."""
    counts = word_counts(docs).orderBy(F.desc("count"), "word").limit(size)
    return counts.withColumn("id", F.row_number().over(Window.orderBy(F.desc("count"), "word"))).select("word", "id")


class Adapter:
    """A vocabulary on the driver, which is bounded by its size, with its control ids and identity."""

    def __init__(self, words: list[str], control: tuple[str, ...] = CONTROL) -> None:
        self.words, self.control, self.base = words, control, len(words) + 1
        self.ids = {w: i for i, w in enumerate(words, 1)}
        self.names = [UNKNOWN, *words, *control]
        self.vocabulary_sha256 = hashlib.sha256("\n".join(words).encode()).hexdigest()
        parts = {"control": {c: self.base + i for i, c in enumerate(control)}, "rules": RULES, "trainable": TRAINABLE, "vocabulary": self.vocabulary_sha256}
        self.identity = hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    @classmethod
    def of(cls, vocabulary: DataFrame) -> Adapter:
        return cls([r.word for r in vocabulary.orderBy("id").collect()])

    def pinned(self, identity: str) -> Adapter:
        """This adapter, if its identity is the recorded one."""
        if identity != self.identity:
            raise TokenizerError(f"{self.identity} is not the pinned {identity}")
        return self

    def control_id(self, name: str) -> int:
        return self.base + self.control.index(name)

    def is_special(self, token: Column) -> Column:
        return token >= self.base

    def encode(self, docs: DataFrame, w: str = "w", ids: str = "ids") -> DataFrame:
        """``docs`` with the ids of its array of words ``w``, in Arrow batches of bounded size and without a shuffle."""
        limit_batches(docs.sparkSession)
        held = docs.sparkSession.sparkContext.broadcast(self.words)

        @F.arrow_udf("array<int>")
        def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = pa.array(held.value, pa.string())
            for lists in batches:
                found = pc.fill_null(pc.add(pc.index_in(lists.flatten(), value_set=known), 1), 0)
                yield pa.ListArray.from_arrays(pa.array(offsets(lists), pa.int32()), found, mask=pc.is_null(lists))

        return docs.withColumn(ids, look_up(F.col(w)))

    def decode(self, docs: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
        """``docs`` with the names of its ``ids``, control tokens by name, joined by a blank."""
        limit_batches(docs.sparkSession)
        held = docs.sparkSession.sparkContext.broadcast(self.names)

        @F.arrow_udf("string")
        def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            names = pa.array(held.value, pa.string())
            for lists in batches:
                spelled = pa.ListArray.from_arrays(pa.array(offsets(lists), pa.int32()), names.take(lists.flatten()), mask=pc.is_null(lists))
                yield pc.binary_join(spelled, " ")

        return docs.withColumn(text, spell(F.col(ids)))
