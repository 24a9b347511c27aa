"""Totals at several levels from one pass over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(rows: DataFrame, levels: list[list[str]], sums: list[str] = (), distinct: list[str] = (), medians: list[str] = (), accuracy: int = 12, size: int = 200) -> DataFrame:
    """One row for each group of each level, a level being a list of the columns that it groups by ([] for all rows): those columns, null where a level does not have them, level (bit i,
    from the last column up, is set where column i is summed over), n, sum_x and, by sketches that can be merged, distinct_x and median_x.

    The rows are shuffled once, summed by the columns of all levels; only these sums are copied for each level. Sums are exact. distinct_x has a relative error of 1.04 / sqrt(2^accuracy) (one
    standard deviation), median_x lies within a rank of about 2 / size of the middle. Nulls are groups of their own, and no part of sums, counts of values or medians.
    """
    keys = list(dict.fromkeys(c for level in levels for c in level))
    parts = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums]]
    parts += [F.hll_sketch_agg(F.col(c), accuracy).alias(f"distinct_{c}") for c in distinct] + [F.kll_sketch_agg_double(F.col(c).cast("double"), size).alias(f"median_{c}") for c in medians]
    base = rows.groupBy(*keys).agg(*parts)
    whole = [F.grouping_id().alias("level"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums]]
    whole += [F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{c}")).alias(f"distinct_{c}") for c in distinct]
    whole += [F.kll_merge_agg_double(f"median_{c}", size).alias(f"median_{c}") for c in medians]
    made = base.groupingSets([[F.col(c) for c in level] for level in levels], *keys).agg(*whole)
    for c in medians:
        some = F.kll_sketch_get_n_double(F.col(f"median_{c}")) > 0
        made = made.withColumn(f"median_{c}", F.when(some, F.kll_sketch_get_quantile_double(F.col(f"median_{c}"), F.lit(0.5))))
    return made
