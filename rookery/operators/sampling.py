"""Samples that come out the same on every run, and set operations by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hash that any SQL engine computes alike.
_PRIME, _FACTOR = 2_147_483_647, 48_271


def portable_hash(key: Column, seed: int = 42) -> Column:
    """A number below 2**31 - 1 from a whole number, by two steps of a linear congruence."""
    first = ((key % _PRIME) * _FACTOR + seed) % _PRIME
    return (first * _FACTOR + 7) % _PRIME


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows, by the hash of a whole-number key."""
    return df.orderBy(portable_hash(F.col(key), seed), key).limit(n)


def split_sample(df: DataFrame, key: str, parts: int, part: int, seed: int = 42) -> DataFrame:
    """One of `parts` disjoint samples of about equal size; no sort."""
    return df.where(portable_hash(F.col(key), seed) % parts == part)


def best_by_lower(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name in lower case, the largest value)."""
    return df.groupBy(F.lower(name).alias("name")).agg(F.max(value).alias("best"))
