"""Content-addressed identities: canonical JSON, stable hashes, folds of hashes."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and no white space; nulls are kept. Not for floating-point fields, whose text form differs between systems."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sha(*parts: Column) -> Column:
    """SHA-256, in hex, of the parts joined by ``|``; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def stable_u64(*parts: Column) -> Column:
    """The first 8 bytes of ``sha`` as an unsigned number."""
    return F.conv(F.substring(sha(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def order_key(*parts: Column) -> Column:
    """16 hex digits that sort like ``stable_u64``."""
    return F.substring(sha(*parts), 1, 16)


def array_bytes(values, dtype: str) -> bytes:
    """An array's bytes in a fixed little-endian type, behind its shape."""
    a = np.asarray(values, dtype=np.dtype(dtype).newbyteorder("<"))
    return json.dumps({"dtype": dtype, "shape": list(a.shape)}, sort_keys=True, separators=(",", ":")).encode() + a.tobytes()


def sha256_arrays(*pairs: tuple[Column, str]) -> Column:
    """A digest of several array columns, each in its own type: the same on any machine."""
    types = [dtype for _, dtype in pairs]

    @F.pandas_udf("string")
    def digest(*columns: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(b"".join(array_bytes(v, t) for v, t in zip(row, types))).hexdigest() for row in zip(*columns)])

    return digest(*[c for c, _ in pairs])


def transform_id(config: dict, version: str, source: str) -> str:
    """Name of a transformation: it changes with its version, its settings and its own code."""
    parts = {"config": config, "source_sha256": hashlib.sha256(source.encode()).hexdigest(), "version": version}
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def leading_integer(text: Column) -> Column:
    """The number that a text begins with, null if it begins with none."""
    return F.nullif(F.regexp_extract(text, r"^\d+", 0), F.lit("")).cast("long")
