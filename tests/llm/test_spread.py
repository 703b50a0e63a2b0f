from pyspark.sql import functions as F

from curator.llm.spread import among, drop_rows, hash_bound
from tests.llm.common import docs


def test_members_are_never_missed(spark):
    d = spark.range(5000).withColumnRenamed("id", "k")
    members = spark.range(0, 5000, 7).withColumnRenamed("id", "member")
    for at_most in (None, 1, 10**6):
        got = among(d, F.col("k"), members, at_most).collect()
        assert len(got) == 5000
        assert all(r.maybe_member for r in got if r.k % 7 == 0)
        assert sum(r.maybe_member for r in got) < 800
    assert among(d, F.col("k"), members.where("false")).where("maybe_member").count() == 0


def test_rows_are_dropped_by_id_and_text(spark):
    d = docs(spark, [(1, "a"), (1, "b"), (2, "c"), (2, "c"), (None, None), (3, "d")])
    d = d.withColumns({"_tie": F.lit(1), "maybe_member": F.lit(2), "tie": F.lit(3), "_row": F.lit(4), "member": F.lit(5)})
    t = lambda x: F.xxhash64(F.lit(x))
    gone = spark.createDataFrame([(1, False), (2, True), (None, False)], "doc_id long, keep_one boolean")
    gone = gone.withColumn("tie", F.when(F.col("doc_id") == 1, t("a")).when(F.col("doc_id") == 2, t("c")).otherwise(t("")))
    kept = drop_rows(d, gone)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "b"), (2, "c"), (3, "d")]
    assert kept.select("_row").first()[0] == 4


def test_hash_bound():
    assert hash_bound(0, 5) == hash_bound(20, 5) == (1 << 63) - 1
    share = (hash_bound(4000, 100) + (1 << 63)) / (1 << 64)
    assert abs(share - 0.1) < 1e-9 and hash_bound(10**12, 100) > -(1 << 63)


def test_bounded_sample_is_the_least_hashes(spark):
    d = spark.range(3000).select(F.xxhash64("id").alias("r"))
    got = sorted(r.r for r in d.where(F.col("r") <= hash_bound(3000, 50)).collect())
    assert 150 < len(got) < 260
    assert got[:50] == [r.r for r in d.orderBy("r").limit(50).collect()]
