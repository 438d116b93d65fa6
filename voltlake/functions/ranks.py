"""Exact ranks and percentiles without a task that holds all values of a group.

Values are counted first. Approximate percentiles of the distinct values, a bounded array for
each group, deal the counts into buckets; running sums are made inside buckets and, over one
row a bucket, across them. The buckets only spread the work: ranks and percentiles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BUCKETS = 32


def ranked(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """keys, value, n, before, total: how often each value occurs in its group, and how many
    smaller values there are, and values in all. Missing values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    counts = cut(counts.withColumn("_one", F.lit(1)), "counts")  # read for the edges, the buckets' sums and the ranks
    group = [*keys, "_one"]
    shares = [i / buckets for i in range(1, buckets)]
    edges = counts.groupBy(*group).agg(F.percentile_approx(value, shares, 100 * buckets).alias("_edges"))
    dealt = counts.join(F.broadcast(edges.withColumnsRenamed({k: f"_k_{k}" for k in group})), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in group])
    dealt = dealt.withColumn("_bucket", F.size(F.filter("_edges", lambda x: x < F.col(value)))).select(*group, value, "n", "_bucket")
    inside = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group)
    sums = dealt.groupBy(*group, "_bucket").agg(F.sum("n").alias("_n"))  # a row a bucket
    earlier = over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"_k_{k}") for k in group), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(over).alias("total"))
    out = dealt.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    out = out.join(F.broadcast(sums), [*(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in group), F.col("_bucket") == F.col("_b")])
    return out.select(*keys, value, "n", (F.col("_before") + F.col("_inside")).alias("before"), "total")


def percentile_columns(value: str, shares: dict[str, float]) -> list[Column]:
    """Aggregates over `ranked` rows of a group: linearly interpolated percentiles by name."""
    out = []
    for name, p in shares.items():
        place = (F.col("total") - 1) * p
        at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return out


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and the named percentiles; groups without a value have no row."""
    return ranked(df, keys, value).groupBy(*keys).agg(*percentile_columns(value, shares))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """Each value of a column and the mean of its ranks, from 1."""
    return ranked(df, [], column).select(column, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
