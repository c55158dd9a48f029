"""Samples that are the same in every run and on every cluster: rows and keys are chosen by a hash, not by the order in which tasks see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_share(key: str, parts: int = 1000) -> Column:
    """0..parts-1 by multiplicative hash of an integer key."""
    return F.pmod(F.shiftright(F.col(key) * F.lit(2654435761), 7), F.lit(parts))


def sample_rows(df: DataFrame, key: str, share: float) -> DataFrame:
    """About ``share`` of the rows; all rows of a key value together. Null keys are left out."""
    return df.where(hash_share(key) < round(share * 1000))


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of exactly ``n`` different non-null keys (fewer if there are fewer), the first by hash; ties by the key."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    chosen = keys.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)
    return df.join(chosen, key, "left_semi")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in an order that depends on the key's hash alone."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
