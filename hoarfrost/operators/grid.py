"""Neighbourhood operators on grids in long form (row, col, value); a missing cell is a null value.

Lines of a grid are windows by row or by column, so the work spreads over as
many lines as there are; nothing needs the whole grid in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _down():
    return Window.partitionBy("col").orderBy("row")


def _across():
    return Window.partitionBy("row").orderBy("col")


def gradient(value: str, along, step: float) -> Column:
    """Central difference within a line, one-sided at its ends."""
    before, here, after = F.lag(value).over(along), F.col(value), F.lead(value).over(along)
    at_start = F.row_number().over(along) == 1
    at_end = F.lead(F.lit(1)).over(along).isNull()
    return F.when(at_start, (after - here) / step).when(at_end, (here - before) / step).otherwise((after - before) / (2 * step))


def slope_aspect(grid: DataFrame, z: str = "z", size: float = 100.0) -> DataFrame:
    """dx, dy, slope (degrees), aspect (radians, 0 to 2 pi), and the aspect's sine and cosine."""
    out = grid.withColumn("dy", gradient(z, _down(), size)).withColumn("dx", gradient(z, _across(), size))
    aspect = F.pmod(F.atan2(-F.col("dx"), F.col("dy")), F.lit(2 * np.pi))
    out = out.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))).withColumn("aspect", aspect)
    return out.withColumn("aspect_sin", F.sin("aspect")).withColumn("aspect_cos", F.cos("aspect"))


def laplacian_curvature(grid: DataFrame, z: str = "z", size: float = 100.0) -> DataFrame:
    """curvature: minus the sum of the second differences, each a gradient of a gradient."""
    out = grid.withColumn("_y", gradient(z, _down(), size)).withColumn("_x", gradient(z, _across(), size))
    out = out.withColumn("_yy", gradient("_y", _down(), size)).withColumn("_xx", gradient("_x", _across(), size))
    return out.withColumn("curvature", -(F.col("_xx") + F.col("_yy"))).drop("_x", "_y", "_xx", "_yy")


def _padded_sum(value: str, along: Column, index: str, k: int) -> Column:
    """Sum over index - k to index + k of a line whose ends are repeated outwards."""
    inner = F.sum(value).over(along.rowsBetween(-k, k))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, high = F.min(index).over(whole), F.max(index).over(whole)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    return inner + F.greatest(k - (F.col(index) - low), F.lit(0)) * first + F.greatest(k - (high - F.col(index)), F.lit(0)) * last


def focal_mean(grid: DataFrame, size: int, z: str = "z", name: str = "focal") -> DataFrame:
    """Mean of the known cells in a size x size square, edges repeated outwards; one pass down and one across."""
    k = size // 2
    out = grid.withColumn("_s", F.coalesce(F.col(z), F.lit(0.0))).withColumn("_n", F.col(z).isNotNull().cast("double"))
    out = out.withColumn("_sd", _padded_sum("_s", _down(), "row", k)).withColumn("_nd", _padded_sum("_n", _down(), "row", k))
    out = out.withColumn("_sa", _padded_sum("_sd", _across(), "col", k)).withColumn("_na", _padded_sum("_nd", _across(), "col", k))
    return out.withColumn(name, F.try_divide(F.col("_sa"), F.col("_na"))).drop("_s", "_n", "_sd", "_nd", "_sa", "_na")


def position_index(grid: DataFrame, radius: float, z: str = "z", cell: float = 100.0, name: str = "tpi") -> DataFrame:
    """Height over the mean of the square of 2 * round(radius / cell) + 1 cells around."""
    return focal_mean(grid, 2 * round(radius / cell) + 1, z, "_f").withColumn(name, F.col(z) - F.col("_f")).drop("_f")


def wetness_index(grid: DataFrame, z: str = "z", size: float = 100.0) -> DataFrame:
    """ln(a / tan b): b at least 0.1 degrees, a at least 1 and the 5 x 5 mean of 1 / tan b times the cell size."""
    out = slope_aspect(grid, z, size).withColumn("_t", F.tan(F.radians(F.greatest(F.col("slope"), F.lit(0.1))))).withColumn("_i", 1 / F.col("_t"))
    out = focal_mean(out, 5, "_i", "_a")
    return out.withColumn("twi", F.ln(F.greatest(F.col("_a") * size, F.lit(1.0)) / F.col("_t"))).drop("_t", "_i", "_a")


def _offsets(azimuths: int, reach: int) -> list[list[tuple[int, int, int]]]:
    """For each direction the cells (step, down, right) to look at, rounded half to even."""
    angles = [2 * np.pi * k / azimuths for k in range(azimuths)]
    return [[(s, int(np.rint(-s * np.cos(a))), int(np.rint(s * np.sin(a)))) for s in range(1, reach + 1)] for a in angles]


def sky_view(grid: DataFrame, z: str = "z", cell: float = 100.0, reach_m: float = 1000.0, azimuths: int = 36, tile: int = 256) -> DataFrame:
    """horizon (largest angle, radians) and svf (1 less the mean of sin squared of the horizon angles, 0 to 1) of each known cell.

    The grid goes into tiles with a margin of the search's reach; each tile is
    worked out in numpy. A cell is copied to its neighbours' margins only.
    """
    reach = round(reach_m / cell)
    ways = _offsets(azimuths, reach)
    tiles = F.sequence(F.floor((F.col("row") - reach) / tile), F.floor((F.col("row") + reach) / tile))
    across = F.sequence(F.floor((F.col("col") - reach) / tile), F.floor((F.col("col") + reach) / tile))
    dealt = grid.where(F.col(z).isNotNull()).select("row", "col", F.col(z).alias("z")).select("*", F.explode(tiles).alias("ti")).select("*", F.explode(across).alias("tj"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        n = tile + 2 * reach
        field = np.full((n, n), np.nan)
        field[pdf["row"].to_numpy() - ti * tile + reach, pdf["col"].to_numpy() - tj * tile + reach] = pdf["z"].to_numpy()
        inner = field[reach : reach + tile, reach : reach + tile]
        total, top = np.zeros(inner.shape), np.zeros(inner.shape)
        for way in ways:
            h = np.zeros(inner.shape)
            for step, down, right in way:
                there = field[reach + down : reach + down + tile, reach + right : reach + right + tile]
                h = np.fmax(h, np.arctan2(there - inner, step * cell))
            total += np.sin(h) ** 2
            top = np.maximum(top, h)
        i, j = np.nonzero(~np.isnan(inner))
        return pd.DataFrame({"row": (i + ti * tile).astype("int32"), "col": (j + tj * tile).astype("int32"), "horizon": top[i, j], "svf": np.clip(1 - total[i, j] / azimuths, 0, 1)})

    return dealt.groupBy("ti", "tj").applyInPandas(run, "row int, col int, horizon double, svf double")


def nearest_of(at: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For each of some ascending places the number of the one with the least squared offset plus more (the first of equal ones; NaN: none), -1 if there is none.

    The nearest one's number never falls from place to place, so the places are
    taken middle first, each within the bounds that its neighbours on the level
    before leave: a level looks at each number about once.
    """
    known = np.flatnonzero(~np.isnan(more))
    n, m = len(at), len(known)
    if not m:
        return np.full(n, -1, np.int32)
    a, g, best = at[known], more[known], np.zeros(n, np.int64)
    step = 1 << (n.bit_length() - 1)
    while step:
        i = np.arange(step - 1, n, 2 * step)
        low = np.where(i - step >= 0, best[np.maximum(i - step, 0)], 0)
        high = np.where(i + step < n, best[np.minimum(i + step, n - 1)], m - 1)
        size = high - low + 1
        begin = np.cumsum(size) - size
        j = np.arange(size.sum()) - np.repeat(begin - low, size)
        cost = (np.repeat(at[i], size) - a[j]) ** 2 + g[j]
        hit = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, begin), size))
        part = np.repeat(np.arange(len(i)), size)[hit]
        best[i] = j[hit[np.append(True, part[1:] != part[:-1])]]
        step //= 2
    return known[best].astype(np.int32)


#: Cells of a band of rows, which a task works out at once; offsets that are tried for all cells before rows are taken one by one.
BAND_CELLS, OFFSETS = 1 << 18, 256


def nearest_columns(g: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each cell of some rows the number of the column with the least squared offset plus g (inf: none), the first of equal ones; -1 if there is none.

    Offsets grow until none can be nearer; cells that are far from all go by
    nearest_of, row by row.
    """
    best, at = g.copy(), np.where(np.isinf(g), -1, np.arange(len(cols)))
    if len(cols) == cols[-1] - cols[0] + 1:  # no gaps, so that an offset is a shift
        for d in range(1, min(len(cols), OFFSETS + 1)):
            if d * d > best.max():
                return at
            left, right = g[:, :-d] + d * d, g[:, d:] + d * d
            hit = (left <= best[:, d:]) & ~np.isinf(left)
            best[:, d:][hit], at[:, d:][hit] = left[hit], (hit.nonzero()[1])
            hit = right < best[:, :-d]
            best[:, :-d][hit], at[:, :-d][hit] = right[hit], hit.nonzero()[1] + d
        if len(cols) <= OFFSETS + 1:
            return at
    more, places = np.where(np.isinf(g), np.nan, g), cols.astype(float)
    for r in range(len(g)):
        at[r] = nearest_of(places, more[r])
    return at


def distances(grid: DataFrame, is_target: Column, cell: float = 1.0, carry: str | None = None) -> DataFrame:
    """Exact Euclidean distance of each cell to the nearest target, and that target (of equal ones the first by column, then row). carry: a column whose value at that target is near_value.

    Rows are dealt in bands. First each column's outermost targets in each band
    are found (one grouping), and from them its nearest targets before and
    after the band; so a task has all that its band's cells need: the nearest
    target within their column, both ways, and then the least of squared
    offsets over a row's columns. No column and no more than a band's rows come
    together. Without any target the distance is the diagonal of the grid.
    """
    r0, r1, c0, c1 = grid.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    high, wide = (r1 - r0 + 1, c1 - c0 + 1) if r0 is not None else (1, 1)
    rows = max(1, BAND_CELLS // wide)
    far = float(np.sqrt(float(high * high + wide * wide)))
    tasks = max(1, min(-(-high // rows), 2000))
    cells = grid.withColumn("_b", F.floor(F.col("row") / rows).cast("long")).withColumn("_t", F.coalesce(is_target, F.lit(False)))
    at = F.when(F.col("_t"), F.struct("row", (F.col(carry) if carry else F.lit(None).cast("int")).alias("v")))
    own = cells.groupBy("_b", "col").agg(F.min_by(at, F.when(F.col("_t"), F.col("row"))).alias("lo"), F.max_by(at, F.when(F.col("_t"), F.col("row"))).alias("hi"))
    every = cells.select("_b").distinct().crossJoin(cells.select("col").distinct())  # bands by columns
    known = every.join(own, ["_b", "col"], "left")
    by = lambda *order: Window.partitionBy("col").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = known.select("_b", "col", F.last("hi", True).over(by("_b")).alias("a"), F.last("lo", True).over(by(F.desc("_b"))).alias("z"))
    known = known.select(F.col("_b").alias("_e"), "col", F.col("a.row").alias("a"), F.col("a.v").alias("av"), F.col("z.row").alias("z"), F.col("z.v").alias("zv"))

    def run(cells: pa.Table, ends: pa.Table) -> pa.Table:
        ends = ends.sort_by("col")
        cols = ends.column("col").to_numpy()
        first = cells.column("_b")[0].as_py() * rows
        r, c = cells.column("row").to_numpy() - first, np.searchsorted(cols, cells.column("col").to_numpy())
        size = int(r.max()) + 1
        target = np.zeros((size, len(cols)), bool)
        hit = cells.column("_t").to_numpy(zero_copy_only=False).astype(bool)
        target[r[hit], c[hit]] = True
        here = np.arange(first, first + size, dtype=float)[:, None]
        inner = np.where(target, here, np.nan)
        before, after = (ends.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in ("a", "z"))
        above = np.fmax.accumulate(np.vstack([before, inner]))[1:]
        below = np.fmin.accumulate(np.vstack([after, inner[::-1]]))[:0:-1]
        near = np.where(np.isnan(below) | (here - above <= below - here), above, below)
        best = nearest_columns(np.where(np.isnan(near), np.inf, (here - near) ** 2), cols)
        col = best[r, c]
        none = col < 0
        row = near[r, col]
        d = np.where(none, far, np.sqrt((cols[col] - cols[c]).astype(float) ** 2 + (row - first - r) ** 2))
        out = cells.drop_columns(["_b", "_t"])
        more = {"distance": pa.array(d * cell), "near_row": pa.array(np.where(none, 0, row).astype(np.int64), mask=none).cast(cells.schema.field("row").type), "near_col": pa.array(cols[col], mask=none)}
        if carry:
            # Places of values: the band's cells, then what lies before it, then what lies behind.
            place = np.full((size, len(cols)), -1)
            place[r[hit], c[hit]] = np.flatnonzero(hit)
            inside = ~none & (row >= first) & (row < first + size)
            at = np.where(inside, place[np.where(inside, row - first, 0).astype(int), col], len(r) + col + np.where(row < first, 0, len(cols)))
            kind = cells.schema.field(carry).type
            values = pa.chunked_array([x.cast(kind) for v in (cells.column(carry), ends.column("av"), ends.column("zv")) for x in v.chunks], kind)
            more["near_value"] = values.take(pa.array(at, mask=none))
        for name, x in more.items():
            out = out.append_column(name, x)
        return out

    kinds = {f.name: f.dataType for f in grid.schema.fields}
    extra = {"distance": T.DoubleType(), "near_row": kinds["row"], "near_col": kinds["col"]} | ({"near_value": kinds[carry]} if carry else {})
    schema = T.StructType(list(grid.schema.fields))
    for name, kind in extra.items():
        schema = schema.add(name, kind)
    return cells.repartition(tasks, "_b").groupBy("_b").cogroup(known.repartition(tasks, "_e").groupBy("_e")).applyInArrow(run, schema)


#: Rows and columns of a tile in which gaps are filled, and the reach up to which they are filled so.
FILL_ROWS, FILL_COLS, FILL_REACH = 2048, 256, 32


def filled(grid: DataFrame, z: str = "z", within: float = 5.0) -> DataFrame:
    """z_filled: the value of the nearest known cell where z is null and one is near enough (of equal ones the first by column, then row).

    What is near enough is known beforehand, so cells are dealt once, in tiles
    with a margin of known cells; only a long reach goes by distances().
    """
    if within > FILL_REACH:
        found = distances(grid, F.col(z).isNotNull(), carry=z)
        return found.select(*grid.columns, F.when(F.col("distance") <= within, F.coalesce(F.col(z), F.col("near_value"))).otherwise(F.col(z)).alias("z_filled"))
    reach = max(0, int(within))
    around = range(-reach, reach + 1)
    near = sorted((r * r + c * c, c, r) for r in around for c in around if (r or c) and np.sqrt(r * r + c * c) <= within)
    own = lambda c, size: F.floor(F.col(c) / size).cast("int")
    inner = lambda c, size: F.pmod(F.col(c), F.lit(size)).between(reach, size - reach - 1)
    tiles = lambda c, size: F.sequence(F.floor((F.col(c) - reach) / size).cast("int"), F.floor((F.col(c) + reach) / size).cast("int"))
    pairs = F.flatten(F.transform(tiles("row", FILL_ROWS), lambda i: F.transform(tiles("col", FILL_COLS), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    alone = F.array(F.struct(own("row", FILL_ROWS).alias("i"), own("col", FILL_COLS).alias("j")))
    at = F.when(F.col(z).isNull() | (inner("row", FILL_ROWS) & inner("col", FILL_COLS)), alone).otherwise(pairs)
    dealt = grid.withColumn("_own", alone[0]).withColumn("_t", F.explode(at)).withColumn("_own", F.col("_t") == F.col("_own"))

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        i, j = key[0].as_py()["i"], key[0].as_py()["j"]
        cells = cells.combine_chunks()
        r, c = cells.column("row").to_numpy() - i * FILL_ROWS + reach, cells.column("col").to_numpy() - j * FILL_COLS + reach
        known = cells.column(z).is_valid().to_numpy()
        place = np.full((FILL_ROWS + 2 * reach, FILL_COLS + 2 * reach), -1, np.int32)
        place[r[known], c[known]] = np.flatnonzero(known)
        source, todo = np.arange(len(r)), np.flatnonzero(~known)
        for _, right, down in near:
            found = place[r[todo] + down, c[todo] + right]
            source[todo[found >= 0]] = found[found >= 0]
            todo = todo[found < 0]
        keep = np.flatnonzero(cells.column("_own").to_numpy(zero_copy_only=False).astype(bool))
        out = cells.drop_columns(["_t", "_own"]).append_column("z_filled", cells.column(z).take(pa.array(source)))
        return out if len(keep) == len(r) else out.take(pa.array(keep))

    return dealt.groupBy("_t").applyInArrow(run, T.StructType([*grid.schema.fields, T.StructField("z_filled", grid.schema[z].dataType)]))


def blocks(grid: DataFrame, n: int = 4, z: str = "z", flag: Column | None = None) -> DataFrame:
    """n x n blocks: mean of known values, any and majority (half or more) of flag; rows and columns left over at the end go."""
    size = grid.agg((F.floor((F.max("row") + 1) / n)).alias("_h"), (F.floor((F.max("col") + 1) / n)).alias("_w"))
    cells = grid.withColumn("brow", F.floor(F.col("row") / n).cast("int")).withColumn("bcol", F.floor(F.col("col") / n).cast("int")).crossJoin(F.broadcast(size))  # one row
    flag = F.lit(False) if flag is None else flag
    return cells.where((F.col("brow") < F.col("_h")) & (F.col("bcol") < F.col("_w"))).groupBy("brow", "bcol").agg(
        F.avg(z).alias("mean"), F.bool_or(flag).alias("any"), (F.avg(flag.cast("int")) >= 0.5).alias("majority"),
    )


def class_fractions(grid: DataFrame, label: str, codes: list[int], n: int) -> DataFrame:
    """Share of cells of the codes in each n x n block, and whether it is over a half."""
    out = grid.groupBy(F.floor(F.col("row") / n).cast("int").alias("brow"), F.floor(F.col("col") / n).cast("int").alias("bcol")).agg(F.avg(F.col(label).isin(codes).cast("int")).alias("fraction"))
    return out.withColumn("present", F.col("fraction") > 0.5)


def lattice(spark, height: int, width: int) -> DataFrame:
    """Target cells row, col of a height x width grid."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def _weighted(targets: DataFrame, grid: DataFrame, rows: list[tuple[Column, Column]], cols: list[tuple[Column, Column]], z: str) -> DataFrame:
    """Mean of the source cells (row, weight) x (col, weight) of each target, weights taken over the known ones."""
    pairs = F.array(*[F.struct(r.cast("int").alias("sr"), c.cast("int").alias("sc"), (wr * wc).alias("w")) for r, wr in rows for c, wc in cols])
    near = targets.select("row", "col", F.explode(pairs).alias("x")).select("row", "col", "x.sr", "x.sc", "x.w").where("w <> 0")
    source = grid.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(z).alias("v")).where("v is not null")
    return near.join(source, ["sr", "sc"]).groupBy("row", "col").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("z"))


def _place(index: str, ratio: float) -> Column:
    """Source coordinate of a target cell's centre, in cells from the first centre."""
    return (F.col(index) + 0.5) * ratio - 0.5


def bilinear(targets: DataFrame, grid: DataFrame, ratio_rows: float, ratio_cols: float, z: str = "z") -> DataFrame:
    """Targets from their four source neighbours; nulls and cells outside don't count."""
    def ends(index: str, ratio: float):
        p = _place(index, ratio)
        low = F.floor(p)
        return [(low, 1 - (p - low)), (low + 1, p - low)]

    return _weighted(targets, grid, ends("row", ratio_rows), ends("col", ratio_cols), z)


def cubic(targets: DataFrame, grid: DataFrame, ratio_rows: float, ratio_cols: float, z: str = "z") -> DataFrame:
    """Targets from 4 x 4 source neighbours with cubic B-spline weights (a smoother); nulls and cells outside don't count."""
    def ends(index: str, ratio: float):
        p = _place(index, ratio)
        low = F.floor(p)
        t = p - low
        w = [(1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]
        return [(low + (k - 1), w[k]) for k in range(4)]

    return _weighted(targets, grid, ends("row", ratio_rows), ends("col", ratio_cols), z)


@dataclass(frozen=True)
class Lattice:
    """Cells around the centres of two axes: the outer edges, the steps, and how many there are. Row 0 is in the north, whichever way the axis runs."""

    north: float
    west: float
    dlat: float
    dlon: float
    rows: int
    cols: int

    @staticmethod
    def around(lats, lons, alone: float = 1 / 24) -> Lattice:
        """The lattice whose cells have these centres, half a step beyond the outermost ones; alone: the step of an axis of one value."""
        lats, lons = sorted(map(float, lats)), sorted(map(float, lons))
        dlat, dlon = (abs(a[1] - a[0]) if len(a) > 1 else alone for a in (lats, lons))
        return Lattice(lats[-1] + dlat / 2, lons[0] - dlon / 2, dlat, dlon, len(lats), len(lons))

    def place(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Row and column, in cells from the first centre: whole numbers at centres."""
        return (self.north - lat) / self.dlat - 0.5, (lon - self.west) / self.dlon - 0.5

    def cell(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """The cell (row, col) that a place is in."""
        r, c = self.place(lat, lon)
        return F.floor(r + 0.5).cast("int"), F.floor(c + 0.5).cast("int")

    def affine(self) -> tuple[float, float, float, float, float, float]:
        """Column step, shear, west edge, shear, row step, north edge."""
        return self.dlon, 0.0, self.west, 0.0, -self.dlat, self.north


def cube_resampled(targets: DataFrame, cube: DataFrame, time: str, ways: dict[str, str], ratio_rows: float, ratio_cols: float) -> DataFrame:
    """A cube (time, row, col, variables) on another grid, each variable by its way: nearest, bilinear or cubic.

    The sources of a target and their weights are the same for all times, so
    they are listed once and joined with the cube by cell; a variable's
    unknown cells don't count at that time.
    """
    def spread(index: str, ratio: float, way: str) -> list[tuple[Column, Column]]:
        p = _place(index, ratio)
        low = F.floor(p)
        t = p - low
        if way == "nearest":
            return [(F.floor((F.col(index) + 0.5) * ratio), F.lit(1.0))]
        if way == "bilinear":
            return [(low, 1 - t), (low + 1, t)]
        w = [(1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]
        return [(low + (k - 1), w[k]) for k in range(4)]

    parts = []
    for way in sorted(set(ways.values())):
        parts += [F.struct(F.lit(way).alias("way"), r.cast("int").alias("sr"), c.cast("int").alias("sc"), (wr * wc).alias("w")) for r, wr in spread("row", ratio_rows, way) for c, wc in spread("col", ratio_cols, way)]
    near = targets.select("row", "col", F.explode(F.array(*parts)).alias("x")).select("row", "col", "x.*").where("w <> 0")
    values = cube.select(F.col("row").alias("sr"), F.col("col").alias("sc"), time, *ways)
    joined = near.join(values, ["sr", "sc"])
    mean = lambda name, way: F.try_divide(F.sum(F.when(F.col("way") == way, F.col(name) * F.col("w"))), F.sum(F.when((F.col("way") == way) & F.col(name).isNotNull(), F.col("w")))).alias(name)
    return joined.groupBy(time, "row", "col").agg(*[mean(n, w) for n, w in ways.items()])


def order_one(places: DataFrame, grid: DataFrame, z: str = "z") -> DataFrame:
    """places (i, j, pr, pc: row and column in cells from the first centre) with z between the four cells around, null unless all four are known."""
    low_r, low_c = F.floor("pr"), F.floor("pc")
    fr, fc = F.col("pr") - low_r, F.col("pc") - low_c
    ends = F.array(*[F.struct((low_r + a).cast("int").alias("r"), (low_c + b).cast("int").alias("c"), ((fr if a else 1 - fr) * (fc if b else 1 - fc)).alias("w")) for a in (0, 1) for b in (0, 1)])
    near = places.select("i", "j", F.explode(ends).alias("x")).select("i", "j", "x.r", "x.c", "x.w")
    known = near.join(grid.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col(z).alias("v")), ["r", "c"], "left")
    return known.groupBy("i", "j").agg(F.when(F.count("v") == 4, F.sum(F.col("v") * F.col("w"))).alias("z"))


def nearest(targets: DataFrame, grid: DataFrame, ratio_rows: float, ratio_cols: float, z: str = "z") -> DataFrame:
    """Targets from the source cell that holds their centre."""
    at = lambda index, ratio: F.floor((F.col(index) + 0.5) * ratio).cast("int")
    near = targets.withColumn("sr", at("row", ratio_rows)).withColumn("sc", at("col", ratio_cols))
    return near.join(grid.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(z).alias("z")), ["sr", "sc"]).select("row", "col", "z")


def average(grid: DataFrame, ratio_rows: float, ratio_cols: float, z: str = "z") -> DataFrame:
    """Coarse cells as the mean of the known source cells whose centres they hold."""
    at = lambda index, ratio: F.floor((F.col(index) + 0.5) / ratio).cast("int")
    cells = grid.select(at("row", ratio_rows).alias("r"), at("col", ratio_cols).alias("c"), F.col(z).alias("v"))
    return cells.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.avg("v").alias("z"))
