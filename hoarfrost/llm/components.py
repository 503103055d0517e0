"""Connected components of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import forget, written


def _summed(links: DataFrame) -> tuple[DataFrame, tuple]:
    """links, written, and a checksum of them that is found on the way."""
    seen = Observation()
    out = written(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")), "links")
    return out, (seen.get["n"], seen.get["x"])


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, root): every linked node and the smallest node it can reach.

    Alternates two steps until nothing changes: each node hands its larger
    neighbours to its smallest one, then its smaller ones. Rounds grow with the
    logarithm of the links. Only minima are gathered by node, summed before the
    shuffle, so a node with a third of all links is no group of its own; each
    round's links are written to the shared folder, which cuts the lineage.
    Links with a null end and loops are ignored.
    """
    down = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = _summed(down)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        before = now
        last = seen
        now, seen = _summed(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        forget(before)
        if seen == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def rooted_by(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) and further links (a, b) of their nodes -> (node, root) by both: only the roots are linked anew."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    ends = links.join(of("b"), "b").join(of("a"), "a").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    further = connected(ends).select(F.col("node").alias("root"), F.col("root").alias("further"))
    return roots.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
