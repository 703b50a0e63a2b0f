"""Fixtures shared by the tests of the corpus operators."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def docs(spark, rows):
    """documents from (doc_id, text) pairs, or (doc_id, text, lang) triples."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS).repartition(3)


def words(seed, n, syllables="ba be bi do du fa fe ka ki lo lu ma me ni no pa ra re sa se ti to".split()):
    """n invented words, the same for the same seed."""
    import random

    r = random.Random(seed)
    return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
