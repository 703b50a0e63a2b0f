import duckdb
import pytest

from curator.plans import admission, gates

#: Numbers that share a border, numbers whose border is a country code's sign, and a line feed at the end.
TEXTS = ["12345 67890 98765 43210", "1234567890é0987654321 x", "01234567890 910 1234567890", "a@b.co+1234567890@0987654321", "1234567890\n+91 12345-67890\n", "1234567890\n", None, "1234567890 ", "1234567890, 1234567890"]


@pytest.mark.parametrize("name", ["redact_pii", "pii_exemption", "admission_decisions"])
def test_redaction_is_that_of_sql(spark, tmp_path, name):
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(TEXTS) if name == "redact_pii" or t is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    part = gates if name == "pii_exemption" else admission
    want = con.execute(part.SQL[name]).df()
    got = part.QUERIES[name](spark, str(tmp_path)).select(*want.columns).toPandas()
    text = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert text(got) == text(want) and len(got)
