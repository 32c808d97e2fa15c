"""Left joins against sides that hold one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, *on: str, how: str = "left") -> DataFrame:
    """Join `right` (at most one row per key) to a `left` whose key may be heavily skewed.

    The right side usually comes out of an aggregation already partitioned by the key. Adaptive execution splits a hot
    left partition only when both join inputs are plain exchanges, so the first right key is written as a new
    expression, which gives that side its own exchange. It is one narrow row per key; the left side, which is the large
    one, is split as needed. A right side under the broadcast threshold still becomes a broadcast join at runtime.
    """
    return left.join(right.withColumn(on[0], F.concat(F.col(on[0]), F.lit(""))), list(on), how)


def with_zeros(counts: DataFrame, name: str, names: list[str], total: str) -> DataFrame:
    """One row for each of a fixed list of names, zero where there is no count."""
    zeros = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias(name), F.lit(0).cast("long").alias(total))
    listed = counts.where(F.col(name).isin(names)).select(name, F.col(total).cast("long").alias(total))
    return listed.unionByName(zeros).groupBy(name).agg(F.sum(total).alias(total))
