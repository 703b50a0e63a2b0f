"""Tables written to the folder that all executors share, to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves, but only
for a local master: on a cluster a machine's own folder would be invisible to the other machines.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='curator-')}")
    return f"{root.rstrip('/')}/curator-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone when the interpreter ends
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    A lost executor costs no recomputation before this point. ``codec`` is Parquet's: large texts that are read once or twice are worth zstd. The table is removed when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of ``materialize`` from which nothing will be read any more."""
    _remove(df.sparkSession, df._scratch)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished plans removed now: Spark removes them when the driver collects its garbage, which may be much later."""
    spark.sparkContext._jvm.System.gc()
