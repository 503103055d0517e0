"""Queries on grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoarfrost.operators import grid as ops

from . import views as v
from .registry import query
from .seasons import rounded

SIZE = "v_size AS (SELECT max(row) AS mr, max(col) AS mc FROM v_grid)"


def diff(value: str, by: str, order: str, size: str = "100.0") -> str:
    w = f"(PARTITION BY {by} ORDER BY {order})"
    return (f"(CASE WHEN row_number() OVER {w} = 1 THEN (lead({value}) OVER {w} - {value}) / {size}::DOUBLE WHEN lead(1) OVER {w} IS NULL THEN ({value} - lag({value}) OVER {w}) / {size}::DOUBLE "
            f"ELSE (lead({value}) OVER {w} - lag({value}) OVER {w}) / (2 * {size})::DOUBLE END)")  # fmt: skip


SLOPES = f"""v_diff AS (SELECT row, col, z, {diff('z', 'row', 'col')} AS dx, {diff('z', 'col', 'row')} AS dy FROM v_grid),
v_slope AS (SELECT *, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, CASE WHEN atan2(-dx, dy) < 0 THEN atan2(-dx, dy) + 2 * pi() ELSE atan2(-dx, dy) END AS aspect FROM v_diff)"""


def focal_sql(source: str, value: str, k: int, name: str) -> str:
    """Separable: sums and counts down, then across, with clamped indices."""
    return f"""v_d{name} AS (SELECT g.row, g.col, sum(h.{value}) AS s, count(h.{value}) AS n FROM {source} g CROSS JOIN v_size CROSS JOIN (SELECT range AS shift FROM range(-{k}, {k} + 1)) JOIN {source} h ON h.col = g.col AND h.row = least(greatest(g.row + shift, 0), mr) GROUP BY 1, 2),
v_{name} AS (SELECT g.row, g.col, sum(h.s) / nullif(sum(h.n), 0)::DOUBLE AS m FROM v_d{name} g CROSS JOIN v_size CROSS JOIN (SELECT range AS shift FROM range(-{k}, {k} + 1)) JOIN v_d{name} h ON h.row = g.row AND h.col = least(greatest(g.col + shift, 0), mc) GROUP BY 1, 2)"""


@query(v.with_(v.GRID, SLOPES, body="SELECT row, col, round(dx, 6) AS dx, round(dy, 6) AS dy, round(slope, 6) AS slope, round(aspect, 6) AS aspect, round(sin(aspect), 6) AS aspect_sin, round(cos(aspect), 6) AS aspect_cos FROM v_slope"))
def slope_aspect(spark, sf_dir):
    return rounded(ops.slope_aspect(v.grid(spark, sf_dir)).drop("z"), "dx", "dy", "slope", "aspect", "aspect_sin", "aspect_cos")


@query(v.with_(v.GRID, f"v_one AS (SELECT row, col, {diff('z', 'row', 'col', '10.0')} AS x, {diff('z', 'col', 'row', '10.0')} AS y FROM v_grid)",
    body=f"SELECT row, col, round(-({diff('x', 'row', 'col', '10.0')} + {diff('y', 'col', 'row', '10.0')}), 6) AS curvature FROM v_one"))
def curvature(spark, sf_dir):
    return rounded(ops.laplacian_curvature(v.grid(spark, sf_dir), size=10.0).drop("z"), "curvature")


@query(v.with_(v.GRID, v.HOLED, SIZE, focal_sql("v_hole", "z", 2, "f"), body="SELECT row, col, round(m, 6) AS focal FROM v_f"))
def focal_mean(spark, sf_dir):
    """5 x 5 mean of the known cells."""
    return rounded(ops.focal_mean(v.holed(v.grid(spark, sf_dir)), 5).select("row", "col", "focal"), "focal")


@query(v.with_(v.GRID, SIZE, focal_sql("v_grid", "z", 3, "f"), body="SELECT row, col, round(z - m, 6) AS tpi FROM v_grid JOIN v_f USING (row, col)"))
def tpi_7x7(spark, sf_dir):
    return rounded(ops.position_index(v.grid(spark, sf_dir), 300.0).select("row", "col", "tpi"), "tpi")


@query(v.with_(v.GRID, SIZE, focal_sql("v_grid", "z", 10, "f"), body="SELECT row, col, round(z - m, 6) AS tpi FROM v_grid JOIN v_f USING (row, col)"))
def tpi_21x21(spark, sf_dir):
    return rounded(ops.position_index(v.grid(spark, sf_dir), 1000.0).select("row", "col", "tpi"), "tpi")


@query(v.with_(v.GRID, SLOPES, SIZE, "v_tan AS (SELECT row, col, tan(radians(greatest(slope, 0.1::DOUBLE))) AS t, 1 / tan(radians(greatest(slope, 0.1::DOUBLE))) AS i FROM v_slope)", focal_sql("v_tan", "i", 2, "f"),
    body="SELECT row, col, round(ln(greatest(m * 100.0::DOUBLE, 1.0::DOUBLE) / t), 6) AS twi FROM v_tan JOIN v_f USING (row, col)"))
def twi(spark, sf_dir):
    return rounded(ops.wetness_index(v.grid(spark, sf_dir)).select("row", "col", "twi"), "twi")


OFFSETS = ", ".join(f"({a}, {s}, {d}, {r})" for a, way in enumerate(ops._offsets(36, 10)) for s, d, r in way)
HORIZON = f"""v_h AS (SELECT g.row, g.col, a, greatest(max(atan2(h.z - g.z, s * 100.0::DOUBLE)), 0.0::DOUBLE) AS h FROM v_grid g CROSS JOIN (VALUES {OFFSETS}) o(a, s, d, r) JOIN v_grid h ON h.row = g.row + d AND h.col = g.col + r GROUP BY 1, 2, 3)"""


@query(v.with_(v.GRID, HORIZON, body="SELECT row, col, round(max(h), 6) AS horizon FROM v_h GROUP BY 1, 2"))
def horizon_angle(spark, sf_dir):
    return rounded(ops.sky_view(v.grid(spark, sf_dir)).select("row", "col", "horizon"), "horizon")


@query(v.with_(v.GRID, HORIZON, body="SELECT row, col, round(greatest(least(1 - sum(sin(h) * sin(h)) / 36.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE), 6) AS svf FROM v_h GROUP BY 1, 2"))
def sky_view_factor(spark, sf_dir):
    return rounded(ops.sky_view(v.grid(spark, sf_dir)).select("row", "col", "svf"), "svf")


@query(v.with_(v.GRID, "v_t AS (SELECT row AS tr, col AS tc FROM v_grid WHERE z > 530.0::DOUBLE)", body="SELECT row, col, round(min(sqrt(((row - tr) * (row - tr) + (col - tc) * (col - tc))::DOUBLE)) * 100.0::DOUBLE, 6) AS distance FROM v_grid CROSS JOIN v_t GROUP BY 1, 2"))
def distance_transform(spark, sf_dir):
    return rounded(ops.distances(v.grid(spark, sf_dir), F.col("z") > 530.0, 100.0).select("row", "col", "distance"), "distance")


@query(v.with_(v.GRID, "v_known AS (SELECT row AS r, col AS c, z AS kz FROM v_grid WHERE z < 505)", "v_gap AS (SELECT row, col, CASE WHEN z < 505 THEN z END AS z FROM v_grid)", body="""
SELECT row, col, round(coalesce(z, kz), 6) AS z_filled FROM v_gap LEFT JOIN (SELECT row, col, kz FROM (SELECT row, col, kz, row_number() OVER (PARTITION BY row, col ORDER BY (r - row) * (r - row) + (c - col) * (c - col), c, r) AS rn
FROM v_gap JOIN v_known ON r BETWEEN row - 5 AND row + 5 AND c BETWEEN col - 5 AND col + 5 AND (r - row) * (r - row) + (c - col) * (c - col) <= 25 WHERE v_gap.z IS NULL) WHERE rn = 1) USING (row, col)"""))
def nearest_fill(spark, sf_dir):
    gap = v.grid(spark, sf_dir).withColumn("z", F.when(F.col("z") < 505, F.col("z")))
    return rounded(ops.filled(gap).select("row", "col", "z_filled"), "z_filled")


@query(v.with_(v.GRID, v.HOLED, SIZE, body="""SELECT CAST(floor(row / 4.0) AS INTEGER) AS brow, CAST(floor(col / 4.0) AS INTEGER) AS bcol, round(avg(z), 6) AS mean, bool_or(z > 510) AS any, avg(CASE WHEN z < 500 THEN 1 WHEN z IS NOT NULL THEN 0 END) >= 0.5 AS majority
FROM v_hole CROSS JOIN v_size WHERE floor(row / 4.0) < floor((mr + 1) / 4.0) AND floor(col / 4.0) < floor((mc + 1) / 4.0) GROUP BY 1, 2""".replace("bool_or(z > 510) AS any, ", "bool_or(z < 500) AS any, ")))
def block_mean_4x4(spark, sf_dir):
    return rounded(ops.blocks(v.holed(v.grid(spark, sf_dir)), 4, flag=F.col("z") < 500), "mean")


@query("""WITH c AS (SELECT CAST(vec_id AS INTEGER) AS row, CAST(unnest(range(64)) AS INTEGER) AS col, (label + CAST(floor(vec_id / 3.0) AS INTEGER)) % 10 AS code FROM embeddings)
SELECT CAST(floor(row / 4.0) AS INTEGER) AS brow, CAST(floor(col / 4.0) AS INTEGER) AS bcol, round(avg(CASE WHEN code IN (1, 2, 3, 4) THEN 1 ELSE 0 END), 6) AS fraction, avg(CASE WHEN code IN (1, 2, 3, 4) THEN 1 ELSE 0 END) > 0.5 AS present FROM c GROUP BY 1, 2""")
def class_fraction_majority(spark, sf_dir):
    cells = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("col"), ((F.col("label") + F.floor(F.col("vec_id") / 3)) % 10).alias("code"))
    return rounded(ops.class_fractions(cells, "code", [1, 2, 3, 4], 4), "fraction")


#: Targets cover the whole grid, whatever its size: three cells for five rows, five for eight columns.
TARGETS = """v_n AS (SELECT (max(row) + 1) * 3 + 4 AS h, (max(col) + 1) * 5 + 7 AS w FROM v_grid), v_tgt AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM (SELECT unnest(range(h // 5)) AS r FROM v_n) CROSS JOIN (SELECT unnest(range(w // 8)) AS c FROM v_n))"""
RATIO = (5 / 3, 8 / 5)


def targets(spark, sf_dir):
    high, wide = v.grid(spark, sf_dir).agg(F.max("row"), F.max("col")).first()
    return ops.lattice(spark, ((high + 1) * 3 + 4) // 5, ((wide + 1) * 5 + 7) // 8)


PLACES = f"v_pl AS (SELECT row, col, (row + 0.5::DOUBLE) * {RATIO[0]!r}::DOUBLE - 0.5::DOUBLE AS pr, (col + 0.5::DOUBLE) * {RATIO[1]!r}::DOUBLE - 0.5::DOUBLE AS pc FROM v_tgt)"


def _resampled(weights: str) -> str:
    return f"""SELECT p.row, p.col, round(sum(h.z * wr * wc) / sum(wr * wc), 6) AS z FROM (SELECT row, col, unnest({weights.format(p='pr')}) AS a, pc FROM v_pl) p
CROSS JOIN LATERAL (SELECT unnest({weights.format(p='p.pc')}) AS b) q CROSS JOIN LATERAL (SELECT a.i AS ri, a.w AS wr, b.i AS ci, b.w AS wc) x JOIN v_hole h ON h.row = ri AND h.col = ci WHERE h.z IS NOT NULL AND wr * wc <> 0 GROUP BY 1, 2"""


BILINEAR = "[{{'i': CAST(floor({p}) AS INTEGER), 'w': 1 - ({p} - floor({p}))}}, {{'i': CAST(floor({p}) AS INTEGER) + 1, 'w': {p} - floor({p})}}]"
_t = "({p} - floor({p}))"
CUBIC = f"""[{{{{'i': CAST(floor({{p}}) AS INTEGER) - 1, 'w': (1 - {_t}) * (1 - {_t}) * (1 - {_t}) / 6}}}}, {{{{'i': CAST(floor({{p}}) AS INTEGER), 'w': (3 * {_t} * {_t} * {_t} - 6 * {_t} * {_t} + 4) / 6}}}},
{{{{'i': CAST(floor({{p}}) AS INTEGER) + 1, 'w': (-3 * {_t} * {_t} * {_t} + 3 * {_t} * {_t} + 3 * {_t} + 1) / 6}}}}, {{{{'i': CAST(floor({{p}}) AS INTEGER) + 2, 'w': {_t} * {_t} * {_t} / 6}}}}]"""


@query(v.with_(v.GRID, v.HOLED, TARGETS, PLACES, body=_resampled(BILINEAR)))
def bilinear_resample(spark, sf_dir):
    return rounded(ops.bilinear(targets(spark, sf_dir), v.holed(v.grid(spark, sf_dir)), *RATIO), "z")


@query(v.with_(v.GRID, v.HOLED, TARGETS, PLACES, body=_resampled(CUBIC)))
def cubic_resample(spark, sf_dir):
    return rounded(ops.cubic(targets(spark, sf_dir), v.holed(v.grid(spark, sf_dir)), *RATIO), "z")


@query(v.with_(v.GRID, TARGETS, body=f"""SELECT t.row, t.col, round(g.z, 6) AS z FROM v_tgt t JOIN v_grid g ON g.row = CAST(floor((t.row + 0.5::DOUBLE) * {RATIO[0]!r}::DOUBLE) AS INTEGER) AND g.col = CAST(floor((t.col + 0.5::DOUBLE) * {RATIO[1]!r}::DOUBLE) AS INTEGER)"""))
def nearest_resample(spark, sf_dir):
    return rounded(ops.nearest(targets(spark, sf_dir), v.grid(spark, sf_dir), *RATIO), "z")


@query(v.with_(v.GRID, v.HOLED, body="SELECT CAST(floor((row + 0.5::DOUBLE) / 2.5::DOUBLE) AS INTEGER) AS row, CAST(floor((col + 0.5::DOUBLE) / 1.6::DOUBLE) AS INTEGER) AS col, round(avg(z), 6) AS z FROM v_hole GROUP BY 1, 2"))
def average_resample(spark, sf_dir):
    return rounded(ops.average(v.holed(v.grid(spark, sf_dir)), 2.5, 1.6), "z")
