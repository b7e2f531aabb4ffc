"""Exact medians of groups of any size by radix selection (AGG2).

``median`` of Spark keeps all distinct values of a group in one buffer. Here a value
is turned into a 64-bit integer of the same order, and the two middle ranks are
found digit by digit, 16 bits at a time: count the digits of what is left of a
group (sums on the map side, at most 65 536 rows a group and task), find the digit
in which the rank falls, and go on with the values under that prefix. Four counts
find the exact values, however they are spread; no task ever holds a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

DIGITS = 4


@F.pandas_udf(LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """Integers in the order of doubles; both zeros are one."""
    bits = (x.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(DoubleType())
def from_bits(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(dtype=np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): the median of the values that are numbers, between the two middle ones where their count is even.

    Groups without numbers have NULL. NULL keys are a group of their own.
    """
    group = F.struct(*keys)
    good = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = df.select(group.alias("_g"), ordered_bits(F.when(good, F.col(value).cast("double")).otherwise(F.lit(0.0))).alias("_bits"), good.alias("_good"))
    sizes = rows.groupBy("_g").agg(F.count_if("_good").alias("_n"))
    left = rows.where("_good").select("_g", "_bits")
    ranks = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    targets = sizes.where("_n > 0").select("_g", F.explode(ranks).alias("_rank")).select("_g", F.col("_rank").alias("_id"), "_rank", F.lit(0).cast("long").alias("_prefix"))
    for digit in range(DIGITS):
        shift = 64 - 16 * (digit + 1)
        upto = F.shiftright("_bits", shift)  # keeps the sign: prefixes are in the order of values
        if digit:
            known = targets.select(F.col("_g").alias("_tg"), F.col("_prefix").alias("_tp")).distinct()
            left = left.join(known, left["_g"].eqNullSafe(known["_tg"]) & (F.shiftright("_bits", shift + 16) == known["_tp"])).select("_g", "_bits")
        counts = left.groupBy("_g", upto.alias("_p")).agg(F.count("*").alias("_c"))
        parent = F.shiftright("_p", 16) if digit else F.lit(0).cast("long")
        counts = counts.select("_g", "_p", "_c", parent.alias("_up"))
        before = F.sum("_c").over(Window.partitionBy("_g", "_up").orderBy("_p")) - F.col("_c")
        steps = counts.select(F.col("_g").alias("_sg"), F.col("_up").alias("_su"), F.col("_p").alias("_sp"), "_c", before.alias("_before"))
        hit = targets.join(steps, targets["_g"].eqNullSafe(steps["_sg"]) & (targets["_prefix"] == steps["_su"])).where("_rank >= _before and _rank < _before + _c")
        targets = hit.select("_g", "_id", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_sp").alias("_prefix"))
    middle = targets.groupBy(F.col("_g").alias("_mg")).agg(F.avg(from_bits("_prefix")).alias(name))
    return sizes.join(middle, sizes["_g"].eqNullSafe(middle["_mg"]), "left").select(*[F.col("_g")[k].alias(k) for k in keys], name)
