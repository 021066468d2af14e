"""Building blocks that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinery.session import cut

#: A key is hot when it alone holds more than this share of the counted rows.
#: At most 1 / HOT_SHARE keys can be hot, which bounds the broadcast below.
HOT_SHARE = 0.001


def keyed_join(rows: DataFrame, keys: DataFrame, on: Sequence[str], count_col: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``keys`` (unique on ``on``), safe for hot keys.

    ``keys`` carries in ``count_col`` how many of ``rows`` each key has. Keys above
    ``hot_share`` of the total (at most ``1 / hot_share`` of them, so the broadcast is
    bounded whatever the data) are joined by broadcast without moving their rows; the
    others by shuffle. No row is dropped or sampled. ``count_col`` is not returned.
    Null keys never join. ``keys`` is materialized in the shared folder, as three
    branches read it.
    """
    on = list(on)
    keys = cut(keys)
    total = keys.agg(F.sum(count_col)).first()[0] or 0
    is_hot = F.coalesce(F.col(count_col), F.lit(0)) > total * hot_share
    hot = keys.where(is_hot).drop(count_col)
    cold = keys.where(~is_hot).drop(count_col)
    hot_keys = F.broadcast(hot.select(*on).withColumn("__hot", F.lit(True)))
    by_broadcast = rows.join(F.broadcast(hot), on, "inner")
    by_shuffle = rows.join(hot_keys, on, "left_anti").join(cold, on, "inner")
    return by_broadcast.unionByName(by_shuffle)


def prefix_sum(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, computed in two levels.

    ``bucket`` is a coarse key that agrees with ``order`` (lower bucket, earlier rows):
    one window runs inside each (group, bucket), a second over the bucket totals only,
    so a group of any size is spread over its buckets.
    """
    group = list(group)
    work = df.withColumn("__bucket", bucket).withColumn("__value", value)
    inner = W.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = work.groupBy(*group, "__bucket").agg(F.sum("__value").alias("__total"))
    across = W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(group)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__start"),
    )
    local = work.withColumn("__local", F.coalesce(F.sum("__value").over(inner), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(group)]
    cond = F.col("__bucket").eqNullSafe(F.col("__b"))
    for s in same:
        cond = cond & s
    return (
        local.join(starts, cond, "left")
        .withColumn(out, F.col("__local") + F.coalesce(F.col("__start"), F.lit(0)))
        .drop("__bucket", "__value", "__local", "__b", "__start", *[f"__k{i}" for i in range(len(group))])
    )
