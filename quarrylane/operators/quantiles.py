"""Exact percentiles of any number of rows: selection by histograms of the bits of the values.

Doubles become 64-bit numbers of the same order.  Four passes look at 16 bits each: a pass counts,
for every rank that is sought, the values that share the bits found so far by their next 16 bits, and
the count's running sum says which bits the value of that rank has.  No task and no buffer holds
more than 65,536 counts of a rank, however many different values there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

DIGIT, LEVELS = 16, 4
#: Ranks up to which the bits found so far are sent to all tasks; more of them meet the values in a join.
MOST_BROADCAST = 10_000


@F.pandas_udf(T.LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """Numbers, taken as unsigned, in the order of the doubles; -0 counts as 0."""
    b = (v.to_numpy(np.float64) + 0.0).view(np.uint64)
    return pd.Series(np.where(b >> np.uint64(63) > 0, ~b, b | np.uint64(1 << 63)).view(np.int64))


@F.pandas_udf(T.DoubleType())
def from_bits(v: pd.Series) -> pd.Series:
    b = v.to_numpy(np.int64).view(np.uint64)
    return pd.Series(np.where(b >> np.uint64(63) > 0, b & np.uint64((1 << 63) - 1), ~b).view(np.float64))


def percentiles(df: DataFrame, columns: list[str], shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, column, share, value): for each group and column of numbers the values below which the shares of
    its rows lie, between two ranks by linear interpolation.  Nulls and NaN don't count; a group of a
    column without values has no rows."""
    keys = keys or []
    group = ["_g", "column"]  # null keys are keys inside a struct
    whole = F.struct(*keys) if keys else F.lit(0)
    long = df.select(whole.alias("_g"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["_g"], columns, "column", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    long = long.select(*group, ordered_bits("v").alias("bits"))
    sought = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    ends = long.groupBy(*group).agg(F.count("*").alias("n")).select(*group, (F.col("n") - 1).alias("m"), sought).select("*", (F.col("share") * F.col("m")).alias("at"))
    ends = stored(ends.select(*group, "share", F.floor("at").alias("low"), F.ceil("at").alias("high"), (F.col("at") - F.floor("at")).alias("weight")), "shares")
    ranks = stored(ends.select(*group, F.explode(F.array("low", "high")).alias("rank")).distinct().select("*", F.lit(0).cast("long").alias("found"), F.col("rank").alias("left")), "ranks")
    small = ranks.count() <= MOST_BROADCAST
    for level in range(LEVELS):
        shift = 64 - DIGIT * (level + 1)
        known = ranks.select(*group, "found").distinct()
        rows = long.withColumn("found", F.shiftrightunsigned("bits", shift + DIGIT) if level else F.lit(0).cast("long"))
        rows = rows.join(F.broadcast(known) if small else known, [*group, "found"], "left_semi")
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        c = rows.groupBy(*group, "found", digit.alias("digit")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*group, "found").orderBy("digit"))  # at most 65,536 rows
        c = c.select("*", upto.alias("upto"))
        hit = ranks.join(c, [*group, "found"]).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        ranks = stored(hit.select(*group, "rank", F.shiftleft("found", DIGIT).bitwiseOR(F.col("digit")).alias("found"), (F.col("left") - F.col("upto") + F.col("n")).alias("left")), "ranks")
    v = ranks.select(*group, "rank", from_bits("found").alias("v"))
    side = lambda name: v.select(*group, F.col("rank").alias(name), F.col("v").alias(f"_{name}"))
    both = ends.join(side("low"), [*group, "low"]).join(side("high"), [*group, "high"])
    # Equal ends are the value itself, so infinities stay.
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") * (1 - F.col("weight")) + F.col("_high") * F.col("weight"))
    return both.select(*[F.col("_g")[k].alias(k) for k in keys], "column", "share", value.alias("value"))


def percentile_columns(df: DataFrame, columns: dict[str, tuple[str, float]], keys: list[str]) -> DataFrame:
    """keys and one column per name of columns: {name: (column, share)}, null where a group has no value."""
    long = percentiles(df, sorted({c for c, _ in columns.values()}), sorted({s for _, s in columns.values()}), keys)
    pick = lambda c, s: F.max(F.when((F.col("column") == c) & (F.col("share") == s), F.col("value")))
    out: list[Column] = [pick(c, float(s)).alias(name) for name, (c, s) in columns.items()]
    return long.groupBy(*keys).agg(*out)
