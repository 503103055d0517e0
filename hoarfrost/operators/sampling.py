"""Reproducible samples, stratified designs and grouped splits; order comes from md5 of the key and a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import matched
from .storage import forget, written


def draw(*cols: str, seed: int = 42) -> Column:
    """A pseudo-random string for each row, the same in any engine with md5."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """n rows without replacement (a top-n, no global sort)."""
    return df.withColumn("_h", draw(*keys, seed=seed)).orderBy("_h", *keys).limit(n).drop("_h")


def sample_per_group(df: DataFrame, group: str, fraction: float, *keys: str, seed: int = 42) -> DataFrame:
    """max(1, int(size * fraction)) rows of each group: those of the smallest draws.

    A row's place in its group is its rank over the whole table less that of
    the group's first row, so a large group is no task of its own.
    """
    # The draw as 16 bytes, which are in the order of their digits; it isn't kept once rows are in order.
    order = ranked(df.withColumn("_h", F.unhex(draw(*keys, seed=seed))), group, "_h", *keys, name="_i", leave=("_h",))
    sizes = order.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    kept = order.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    return kept.where(F.col("_i") - F.col("_first") < F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).select(*df.columns)


def binned(df: DataFrame, col: str, bins: int, name: str) -> DataFrame:
    """df with the number of col's bin of equal width over its whole range; the largest value is in the last bin. Null and NaN have no bin and no say in the range."""
    known = F.when(~F.isnan(F.col(col).cast("double")), F.col(col))
    ends = df.agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    width = F.coalesce(F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(1.0))
    at = F.floor((known - F.col("_lo")) / width * bins).cast("int")
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.when(at.isNotNull(), F.least(at, F.lit(bins - 1)))).drop("_lo", "_hi")  # ends is one row


def stratified(df: DataFrame, strata: list[str], n: int, *keys: str, cells: int = 200, seed: int = 42) -> DataFrame:
    """max(1, n // cells) rows of each stratum, then others by their draw up to n in all.

    A stratum's rows are a top-k, which tasks cut to k rows before they are
    shuffled; the others are among the n smallest draws of the whole table, a
    top-n. So a stratum may hold all rows. keys tell rows apart.
    """
    drawn = df.withColumn("_h", draw(*keys, seed=seed))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_h", *keys))
    top = drawn.withColumn("_i", place).where(F.col("_i") <= max(1, n // cells)).withColumn("_i", F.lit(0))
    rest = drawn.orderBy("_h", *keys).limit(n).withColumn("_i", F.lit(1))
    found = matched(rest, top.select(*keys), list(keys), "left_anti").unionByName(top)
    return found.orderBy("_i", "_h", *keys).limit(n).drop("_h", "_i")


def extremes(df: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    """The rows of the least and the largest value of each col (of equal ones the first by keys), each once."""
    lows = [F.min(F.struct(c, *keys)).alias(f"lo_{c}") for c in cols]
    highs = [F.min(F.struct((-F.col(c)).alias("v"), *keys)).alias(f"hi_{c}") for c in cols]
    one = df.agg(*lows, *highs)
    picked = F.array(*[F.struct(*[F.col(f"{s}_{c}")[k].alias(k) for k in keys]) for c in cols for s in ("lo", "hi")])
    ids = one.select(F.explode(picked).alias("x")).select("x.*").distinct()
    return df.join(F.broadcast(ids), list(keys), "left_semi")  # two rows a column at most


def group_split(df: DataFrame, group: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """df with is_test: ceil(share * number of groups) whole groups are test, those of the smallest draws."""
    groups = ranked(df.select(group).distinct().withColumn("_h", draw(group, seed=seed)), "_h", group, name="_i")
    test = math.ceil(groups.count() * share)
    return df.join(groups.select(group, (F.col("_i") <= test).alias("is_test")), group)


def ranked(df: DataFrame, *keys: str, name: str = "rank", leave: tuple[str, ...] = ()) -> DataFrame:
    """df with the rank (from 1) of each row by keys (ascending, nulls first), without one task that sorts all rows.

    Rows are dealt by ranges of the keys, and within equal ones by a draw, so
    that a heavy key is split; a row's rank is its place in its range and the
    number of rows in the ranges before. The dealt rows are written once to the
    shared folder, without the columns to leave. Equal keys are in any order.
    """
    spread = df.withColumn("_tie", F.rand(7))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = spread.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie", *leave)
    dealt = written(order.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)  # its lower 33 bits count the rows of a partition
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    placed = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_place", "_before")


def runs(df: DataFrame, key: str, n: int, name: str = "fold") -> DataFrame:
    """df with the number (from 0) of the one of n runs in order of key that the row is in; the first ones are larger by one row if need be. Equal keys are in the order of a hash of their rows, however these are partitioned."""
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    size, more = F.floor(F.col("_t") / n), F.col("_t") % n
    at = F.col("_rank") - 1
    big = more * (size + 1)
    number = F.when(at < big, F.floor(at / (size + 1))).otherwise(more + F.floor((at - big) / F.greatest(size, F.lit(1))))
    tied = df.withColumn("_row", F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]))
    return ranked(tied, key, "_row", name="_rank").crossJoin(F.broadcast(total)).withColumn(name, number.cast("int")).drop("_rank", "_t", "_row")  # one row


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """df with fold: groups, largest first, each to the fold with the fewest rows so far (the first of equal ones).

    Groups of one size are dealt together: the driver sees only how many
    groups there are of each size (fewer sizes than the square root of twice
    the rows), and a group finds its fold by its rank among those of its size.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_m", -F.col("_n"))
    order = ranked(sizes, "_m", group, name="_i")
    load, first, dealt = [0] * folds, 1, []
    for n, count in order.groupBy("_n").count().orderBy(F.desc("_n")).collect():
        for length, cycle in rounds_of(load, n, count):
            dealt.append((n, first, first + length, cycle))
            first += length
    spark = df.sparkSession
    parts = spark.createDataFrame(dealt, "_n long, _from long, _to long, _cycle array<int>")
    found = order.join(parts, "_n").where((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to")))
    at = F.pmod(F.col("_i") - F.col("_from"), F.size("_cycle")).cast("int")
    return df.join(found.select(group, F.get("_cycle", at).alias("fold")), group)


def rounds_of(load: list[int], n: int, count: int) -> list[tuple[int, list[int]]]:
    """How count groups of n rows go to the folds, each to the least loaded (the first of equal ones): runs (groups, the folds that they go to in turn). load is brought up to date."""
    out = []
    while count:
        order = sorted(range(len(load)), key=lambda f: (load[f], f))
        low = load[order[0]]
        cycle = [f for f in order if (load[f], f) <= (low + n, order[0])]
        rest = [load[f] for f in range(len(load)) if f not in cycle]
        turns = min(count // len(cycle), *((low_rest - max(load[f] for f in cycle) - 1) // n + 1 for low_rest in [min(rest)])) if rest else count // len(cycle)
        if turns < 1:
            cycle, turns = cycle[:1], 1
        for f in cycle:
            load[f] += n * turns
        count -= turns * len(cycle)
        out.append((turns * len(cycle), cycle))
    return out


def thinned(points: DataFrame, key: str, x: str, y: str, order: str, apart: float) -> DataFrame:
    """A maximal subset of points at least apart from each other: that of going through the points by order, then key.

    Points lie in squares whose diagonal is apart, so a square has one chosen
    point at most, and a chosen point is found from each square's first
    undecided one alone: it is chosen if it comes before the first ones of the
    24 squares around, which is before all points in its reach. Then its square
    and what is near it in the others is decided at once. So a round works on
    a row a square and on the points left, however dense they lie, and no pairs
    of points are made. Rounds go on while points are undecided. Points without
    coordinates are left out.
    """
    side = apart / math.sqrt(2) * (1 - 1e-9)  # a little less, so that rounding brings no two chosen points into a square
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    spread = lambda df: df.withColumn("_s", F.explode(around)).withColumn("cx", F.col("cx") + F.col("_s.i")).withColumn("cy", F.col("cy") + F.col("_s.j")).drop("_s")
    todo = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(order).alias("o"), cell(x).alias("cx"), cell(y).alias("cy"))
    todo, chosen = written(todo, "undecided"), None
    while not todo.isEmpty():
        first = written(todo.groupBy("cx", "cy").agg(F.min(F.struct("o", "k", "x", "y")).alias("f")), "first")  # summed before the shuffle
        least = spread(first).groupBy("cx", "cy").agg(F.min(F.struct("f.o", "f.k")).alias("least"))
        free = first.join(least, ["cx", "cy"]).where(F.struct("f.o", "f.k") <= F.col("least")).select("f.k", "f.x", "f.y", "cx", "cy")
        free = written(free, "free")
        chosen = free.select("k") if chosen is None else chosen.unionByName(free.select("k"))
        reach = spread(free.withColumn("own_x", F.col("cx")).withColumn("own_y", F.col("cy"))).select("cx", "cy", "own_x", "own_y", F.col("x").alias("fx"), F.col("y").alias("fy")).alias("r")
        near = (F.col("t.x") - F.col("r.fx")) * (F.col("t.x") - F.col("r.fx")) + (F.col("t.y") - F.col("r.fy")) * (F.col("t.y") - F.col("r.fy")) < apart * apart
        own = (F.col("t.cx") == F.col("r.own_x")) & (F.col("t.cy") == F.col("r.own_y"))
        before = todo
        todo = written(todo.alias("t").join(reach, (F.col("t.cx") == F.col("r.cx")) & (F.col("t.cy") == F.col("r.cy")) & (own | near), "left_anti"), "undecided")
        forget(before)
        forget(first)
    forget(todo)
    return points.join(chosen.withColumnRenamed("k", key), key, "left_semi") if chosen is not None else points.limit(0)
