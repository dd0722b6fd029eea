"""Hash splits, ids and canonical digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill import schemas as S


def bucket(seed: str, key: Column) -> Column:
    """The first 64 bits of sha256(seed newline key), modulo 10,000."""
    digest = F.sha2(F.concat(F.lit(seed + "\n"), key), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % 10000).cast("int")


def split_3way(group: Column) -> Column:
    b = bucket(S.SPLIT_SEED_3WAY, group)
    return F.when(b < 8000, "train").when(b < 9000, "dev").otherwise("test")


def split_4way(group: Column) -> Column:
    b = bucket(S.SPLIT_SEED_4WAY, group)
    return F.when(b < 7000, "train").when(b < 8000, "development").when(b < 9000, "calibration").otherwise("test")


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 32))


def canonical(text: str | None, ascii_only: bool = True) -> str | None:
    """A JSON text with sorted keys and no spaces; null if it doesn't parse."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":"))
    except (TypeError, ValueError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical ASCII JSON. Spark's own writer leaves non-ASCII as it is and rewrites numbers, so this runs in Python."""
    return texts.map(canonical)


@F.pandas_udf(T.StringType())
def canonical_digest(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (c := canonical(t)) is None else hashlib.sha256(c.encode()).hexdigest())
