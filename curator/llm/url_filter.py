"""URL rules by a sort-merge range join, in DataFrame operations only.

A rule is a host, a path prefix and a verdict; it fits its host and all subdomains if the url's path starts with the
rule's. Host labels are reversed, so a host's rules and those of its parents are prefixes of its key: every url
is asked once for each parent of its host (a host has few labels), and for one host key a path prefix is an
interval of paths. Within a host key rules and questions are sorted by path; a running ``last`` over the sorted rows
is the innermost rule opened so far, which carries the stack of rules it is nested in. The rules of that stack whose
prefix the path has are those whose interval is still active; the longest of all a url's questions wins.

Hot hosts are salted by their measured size: the questions of a host key are dealt to sorts of about ``SORT`` questions, with a copy of its
rules in each. Only host keys that have rules are sorted at all. The longest rule is the one with the most characters of host and
path together; of equals the one with the longest host, then blocking before allowing.

Cases. The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows up to ``?``,
``#`` or the end. A null url, or one without ``://``, has an empty host and path, which no rule fits. Where no rule
fits, the verdict is ``default``. Repeated rows are returned as often, null page ids too. Repeated rules count once;
rules with a null host count as the empty host, which fits nothing, and a null path is the empty prefix. Without rules
everything has the default verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curator.scratch import materialize

#: Questions of a host key that are sorted together.
SORT = 1_000_000


def lower_ascii(c):
    """A-Z only: ``lower`` would change other letters too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url) -> tuple:
    """Host and path of a url column."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return lower_ascii(host), path


def reversed_host(host):
    """``a.example.org`` as ``org.example.a``."""
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def nested(rules: DataFrame) -> DataFrame:
    """Rules by host key with their stacks: the rules of the same host whose paths are prefixes of theirs."""
    r = rules.select(F.coalesce(lower_ascii(F.col("host")), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"))
    r = r.where("host != ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' is after 'allow'
    r = r.withColumn("key", reversed_host(F.col("host")))
    outer = r.select(F.col("key").alias("okey"), F.struct(F.length("path").alias("n"), F.col("path").alias("path"), F.concat("host", "path").alias("rule"), "verdict").alias("outer"))
    # a rule's own prefixes are asked for by equality, so no rule is compared with all others of its host
    starts = r.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))))
    found = starts.join(outer, (starts["key"] == outer["okey"]) & (starts["start"] == outer["outer.path"]))
    return found.groupBy("key", "path").agg(F.array_sort(F.collect_list("outer")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sort: int = SORT) -> DataFrame:
    """page_id, host, path, rule (host and path prefix of the longest that fits, else null) and verdict."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("times"))
    labels = F.split(F.col("key"), r"\.", -1)
    asked = rows.withColumn("key", reversed_host(F.col("host"))).where("host != ''")
    asked = asked.withColumn("upto", F.explode(F.sequence(F.lit(1), F.size(labels))))
    asked = asked.select("page_id", "host", "path", F.array_join(F.slice(labels, F.lit(1), F.col("upto")), ".").alias("key"))
    ruled = nested(rules)
    sizes = asked.groupBy("key").agg(F.ceil(F.count("*") / sort).alias("salts"))
    hosts = materialize(ruled.select("key").distinct().join(sizes, "key").select(F.col("key").alias("rkey"), "salts"), "ruled-hosts")
    asked = asked.join(hosts, asked["key"] == hosts["rkey"]).withColumn("salt", F.pmod(F.xxhash64("page_id", "path", "host"), F.col("salts"))).drop("rkey", "salts")
    ruled = ruled.join(hosts, ruled["key"] == hosts["rkey"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("rkey", "salts")
    events = ruled.select("key", "salt", "path", F.lit(0).alias("kind"), "stack", F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"))
    events = events.unionByName(asked.withColumns({"kind": F.lit(1), "stack": F.lit(None).cast(ruled.schema["stack"].dataType)}))
    sweep = Window.partitionBy("key", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1 and open is not null")
    active = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    fits = swept.withColumn("top", F.element_at(F.when(F.size(active) > 0, active), -1)).where("top is not null")
    fits = fits.select("page_id", "host", "path", F.struct(F.length("top.rule").alias("n"), (F.length("top.rule") - F.col("top.n")).alias("host_n"), "top.verdict", "top.rule").alias("fit"))
    best = fits.groupBy("page_id", "host", "path").agg(F.max("fit").alias("fit")).select(F.col("page_id").alias("_id"), F.col("host").alias("_host"), F.col("path").alias("_path"), "fit")
    same = rows["page_id"].eqNullSafe(best["_id"]) & (rows["host"] == best["_host"]) & (rows["path"] == best["_path"])
    out = rows.join(best, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
