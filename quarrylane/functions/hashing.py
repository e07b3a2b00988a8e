"""Seeded choices by hash order: independent of input order and of partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: object, *keys: Column) -> Column:
    """md5 of the seed and the keys; its order is the seeded order of rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def number(seed: object, *keys: Column) -> Column:
    """A number below 2**32 from the first 8 hex digits of the digest."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("long")


def uniform(seed: object, *keys: Column) -> Column:
    return (number(seed, *keys) + F.lit(0.5)) / F.lit(4294967296.0)


def gaussian(seed: object, *keys: Column) -> Column:
    """Standard normal numbers from two uniform ones (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(f"{seed}|a", *keys))) * F.cos(2 * F.pi() * uniform(f"{seed}|b", *keys))
