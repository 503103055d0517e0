"""Exact quantiles of groups of any size.

Spark's own exact percentile gathers all different values of a group in one
task. Here only groups of up to LARGE values are done so. For a larger one a
mergeable summary brackets each wanted rank, a pass counts what lies below each
bracket and how often each value within it occurs, and the ranks are picked
from those few values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Values of a group that one task may gather.
LARGE = 1 << 17
#: Accuracy of the summaries: a bracket holds about 4 / ACCURACY of its group's values, and all of those that are equal to its ends.
ACCURACY = 20_000


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls are values like others; the right side's keys go."""
    right = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)])
    out = left.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_right_{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, value: str, shares: list[float], *keys: str, large: int | None = None) -> DataFrame:
    """(keys, q): the quantiles of value by keys, interpolated between the two nearest ranks, as an array in the order of shares.

    Nulls don't count; NaN is larger than all numbers; a group without values
    has null. No keys: all rows are one group, and an empty table gives one null.
    """
    large = LARGE if large is None else large
    if not keys:
        one = quantiles(df.select(F.lit(0).alias("_all"), value), value, shares, "_all", large=large)
        return df.sparkSession.range(1).select(F.lit(0).alias("_all")).join(one, "_all", "left").select("q")
    names = list(keys)
    exact = F.percentile("_v", F.array(*map(F.lit, shares))).alias("q")
    rows = df.select(*names, F.col(value).cast("double").alias("_v"))
    sizes = written(rows.groupBy(*names).agg(F.count("_v").alias("_n")).where(F.col("_n") > large), "sizes")
    if sizes.isEmpty():
        return rows.groupBy(*names).agg(exact)
    rows = written(rows, "values")
    small = matched(rows, sizes, names, "left_anti").groupBy(*names).agg(exact)
    picked = written(_picked(matched(rows, sizes, names).where("_v IS NOT NULL"), shares, names, large), "picked")
    whole = F.forall("q", lambda x: x.isNotNull())
    missed = picked.where(~whole)  # brackets are wide enough for what the summaries promise; should one miss its rank, its group is done in a task
    return small.unionByName(picked.where(whole)).unionByName(matched(rows, missed.select(*names), names, "left_semi").groupBy(*names).agg(exact))


def _picked(rows: DataFrame, shares: list[float], keys: list[str], large: int) -> DataFrame:
    """(keys, q) of rows (keys, _v, _n) of groups of over large values; a rank that its bracket misses is null."""
    margin = 2 / ACCURACY + 2 / max(large, 1)
    ends = [min(1.0, max(0.0, s + side)) for s in shares for side in (-margin, margin)]
    brackets = written(rows.groupBy(*keys).agg(F.first("_n").alias("_n"), F.percentile_approx(F.when(F.isnan("_v"), float("inf")).otherwise(F.col("_v")), ends, ACCURACY).alias("_ends")), "brackets")
    last = lambda end: F.when(end == float("inf"), float("nan")).otherwise(end)
    met = matched(rows.select(*keys, "_v"), brackets.drop("_n"), keys)
    # Of each bracket: null for a value below, the value for one within, nothing for one above.
    within = lambda i: F.when(F.col("_v") <= last(F.col("_ends")[2 * i + 1]), F.struct(F.lit(i).alias("i"), F.when(F.col("_v") >= F.col("_ends")[2 * i], F.col("_v")).alias("x")))
    seen = met.select(*keys, F.explode(F.array_compact(F.array(*map(within, range(len(shares)))))).alias("_s")).select(*keys, "_s.i", "_s.x")
    counts = seen.groupBy(*keys, "i", "x").agg(F.count(F.lit(1)).alias("c"))  # summed before the shuffle, so values below cost a row a task
    sizes = brackets.select(*keys, "_n")
    by = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("x"))
    upto = counts.withColumn("_upto", F.sum("c").over(by))  # the different values of a bracket
    ranked = matched(upto, sizes, keys).withColumn("_p", F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1) * (F.col("_n") - 1))
    at = lambda rank: F.min(F.when(F.col("x").isNotNull() & (F.col("_upto") > rank), F.col("x")))
    low, high = F.floor("_p"), F.ceil("_p")
    found = ranked.groupBy(*keys, "i").agg(at(low).alias("a"), at(high).alias("b"), F.first("_p").alias("p"), F.max(F.when(F.col("x").isNull(), F.col("c"))).alias("below"), F.max("_upto").alias("above"))
    a, b, p = F.col("a"), F.col("b"), F.col("p")
    value = F.when(F.floor(p) == F.ceil(p), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)
    value = F.when((F.coalesce("below", F.lit(0)) <= F.floor(p)) & (F.col("above") > F.ceil(p)), value)
    picked = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))).alias("_q"))  # a row a share
    return picked.select(*keys, F.transform("_q", lambda s: s["v"]).alias("q"))
