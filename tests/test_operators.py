"""Operators on small literal tables: edges, ties, nulls, and those that SQL can't express."""

import datetime as dt
import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal
from hoarfrost.functions import geo, stats
from hoarfrost.operators import grid, joins, models, quality, sampling, season, series
from hoarfrost.operators.harmonic import harmonic_fit
from hoarfrost.sources import text

D = dt.date


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_calendar(spark):
    days = [D(2023, 9, 1), D(2024, 9, 1), D(2024, 8, 31), D(2024, 5, 31), D(2024, 2, 29), D(2023, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [tuple(r) for r in df.select(cal.frost_year(F.col("d")), cal.frost_doy(F.col("d")), cal.frost_week(F.col("d"), 39)).collect()]
    assert got == [(2023, 0, 1), (2024, 1, 1), (2023, 0, 1), (2023, 273, 0), (2023, 181, 26), (2023, 121, 18)]
    hours = spark.createDataFrame([(h,) for h in (1.9, 2.0, 5.9, 6.0, 9.9, 10.0, 19.9, 20.0)], "h double")
    assert [r[0] for r in hours.select(cal.overpass_class(F.col("h"))).collect()] == ["evening", "predawn", "predawn", "morning", "morning", "daytime", "daytime", "evening"]
    ts = spark.createDataFrame([(dt.datetime(2024, 3, 10, 1, 59),), (dt.datetime(2024, 3, 10, 2, 0),), (dt.datetime(2024, 11, 3, 1, 59),), (dt.datetime(2024, 11, 3, 2, 0),)], "t timestamp_ntz")
    assert [math.floor(r[0]) for r in ts.select(cal.us_eastern_hour(F.col("t"))).collect()] == [20, 22, 21, 21]
    assert one(spark, cal.month_since_1960(F.lit(780))) == D(2025, 1, 1)
    sunrise = one(spark, cal.sunrise_second(F.lit("2024-06-21").cast("date"), F.lit(35.5951), F.lit(-82.5515))) / 3600
    assert abs(sunrise - 10.27) < 0.1  # about 6:16 EDT


def test_stats(spark):
    for x in (-3.0, -0.5, 0.0, 1.0, 2.5):
        assert abs(one(spark, stats.normal_cdf(F.lit(x))) - 0.5 * math.erfc(-x / math.sqrt(2))) < 2e-7
    assert one(spark, stats.below(0.0, F.lit(-1.0), F.lit(0.0))) == 1.0 and one(spark, stats.below(0.0, F.lit(1.0), F.lit(0.0))) == 0.0
    assert abs(one(spark, stats.logit(F.lit(1.0))) - math.log(999)) < 1e-9
    assert abs(one(spark, stats.per_step(F.lit(0.5), 5)) - (1 - 0.5**0.2)) < 1e-12
    assert one(spark, stats.variance_scaled(F.lit(3.0), F.lit(2.0), F.lit(0.0), F.lit(10.0), F.lit(1.0))) == 11.0
    assert one(spark, stats.scaled(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0.0
    assert one(spark, stats.finite(F.lit(float("nan")))) is None


def other_utm(lat, lon):
    """The classical power series, good to some centimetres."""
    a, e2 = geo.AXIS, geo.FLATTENING * (2 - geo.FLATTENING)
    p, q = math.radians(lat), e2 / (1 - e2)
    n, t, c = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, q * math.cos(p) ** 2
    x = math.radians(lon + 81) * math.cos(p)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
    east = n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * q) * x**5 / 120)
    north = m + n * math.tan(p) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * q) * x**6 / 720)
    return 500000 + 0.9996 * east, 0.9996 * north


def test_utm(spark):
    points = spark.createDataFrame([(35.5951, -82.5515), (0.0, -81.0), (45.0, -78.0)], "lat double, lon double")
    e, n = geo.utm(F.col("lat"), F.col("lon"))
    back = points.withColumn("e", e).withColumn("n", n)
    la, lo = geo.wgs84(F.col("e"), F.col("n"))
    rows = back.select("*", la.alias("la"), lo.alias("lo")).collect()
    assert all(abs(r.la - r.lat) < 1e-8 and abs(r.lo - r.lon) < 1e-8 for r in rows)
    assert abs(rows[1].e - 500000) < 1e-6 and abs(rows[1].n) < 1e-6
    for r in rows:
        x, y = other_utm(r.lat, r.lon)
        assert abs(r.e - x) < 0.05 and abs(r.n - y) < 0.05


def test_quality(spark):
    obs = spark.createDataFrame([(1, "TMIN", -31.0, ""), (1, "TMAX", 51.0, ""), (2, "TMIN", 5.0, ""), (2, "TMAX", 4.0, ""), (3, "TMIN", 1.0, "x"), (4, "TMIN", 1.0, ""), (5, "TMIN", None, "")], "k int, element string, value double, flag string")
    kept = quality.range_screen(obs, flagged=F.col("flag") != "")
    assert sorted(r.k for r in kept.collect()) == [2, 2, 4, 5]
    assert sorted(r.k for r in quality.without_crossed_days(kept, ["k"]).collect()) == [4, 5]
    inv = spark.createDataFrame([(1, 1990, 2021), (2, 1992, 2021)], "station_id int, first_year int, last_year int")
    assert [r[0] for r in quality.covering(inv, 1991, 2020).collect()] == [1]
    assert sorted(r[0] for r in quality.covering(inv, 1980, 2020).collect()) == [1, 2]
    assert quality.covering(inv.limit(0), 1980, 2020).count() == 0
    few = quality.quantile_composite(spark.createDataFrame([(1, float(i)) for i in range(4)] + [(2, float(i)) for i in range(5)], "p int, v double"), "p", "v")
    rows = {r.p: r for r in few.collect()}
    assert rows[1].p50 is None and rows[2].p50 == 2.0 and rows[2].iqr == 2.0


def test_two_pass_order(spark):
    """The cell that the climatology removes would have shifted the first quartile."""
    cells = [(1, float(x), 0.0, 10.0, 1.0) for x in (10, 10.5, 11, 11.5, 12, 10.2, 10.8, 11.2, 11.7, 10.1, 9.9, 8.0)] + [(1, -40.0, 0.0, 10.0, 1.0)]
    df = spark.createDataFrame(cells, "scene int, lst double, base double, clim_mean double, clim_std double")
    out = {r.lst: r for r in quality.two_pass(df).collect()}
    assert out[-40.0].removed_climatology and out[-40.0].removed_floor and not out[-40.0].removed_tukey
    values = [c[1] for c in cells[:-1]]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert abs(out[8.0].fence - (q1 - 1.25 * (q3 - q1))) < 1e-9 and out[8.0].removed_tukey == (8.0 < q1 - 1.25 * (q3 - q1))
    assert quality.two_pass(df.limit(5)).count() == 0


def test_season_edges(spark):
    rows = [(1, D(2000, 9, 1), 0.0), (1, D(2000, 12, 1), -1.0), (1, D(2001, 3, 1), 0.0), (1, D(2001, 5, 31), 3.0), (2, D(2000, 10, 1), 5.0), (1, D(2001, 7, 1), -9.0), (2, D(2000, 10, 2), None)]
    obs = spark.createDataFrame(rows, "s int, d date, tmin double")
    got = {r.s: r for r in season.frost_dates(obs, "s", completeness=0.0).collect()}
    assert (got[1].first_fall_frost_doy, got[1].last_spring_frost_doy, got[1].n_days) == (1.0, 181.0, 4)
    assert got[2].first_fall_frost_doy is None and got[2].n_days == 2
    strict = {r.s: r for r in season.frost_dates(obs, "s", completeness=0.0, inclusive=False).collect()}
    assert strict[1].first_fall_frost_doy == 92.0 and strict[1].last_spring_frost_doy is None
    counts = {(r.s, r.week_num): (r.n_frost, r.n_days) for r in season.weekly_counts(obs, "s").collect()}
    assert counts[1, 1] == (0, 1) and counts[2, 5] == (0, 2)


def test_last_frost(spark):
    p = {1: [0.1, 0.5, 0.2, 0.5], 2: [0.0] * 4}
    df = spark.createDataFrame([(k, i, x) for k, v in p.items() for i, x in enumerate(v)], "k int, t int, p double")
    curve = season.last_frost_curve(df, "k", "t", "p")
    got = {(r.k, r.t): r for r in curve.collect()}
    assert [round(got[1, t].survival, 9) for t in range(4)] == [0.2, 0.4, 0.5, 1.0]
    assert got[1, 0].peak == 1 and [round(got[1, t].cum, 9) for t in range(4)] == [0.0, 0.2, 0.3, 0.8]
    cross = {(r.k, r.threshold): r.step for r in season.threshold_crossings(curve, "k", "t", [0.2, 0.5, 0.9]).collect()}
    assert cross == {(1, 0.2): 1, (1, 0.5): 3, (1, 0.9): None, (2, 0.2): None, (2, 0.5): None, (2, 0.9): None}
    share = season.confidence_curve(spark.createDataFrame([(1, 0.1, 2), (1, 0.2, None)], "k int, threshold double, step int"), spark.createDataFrame([(1,), (2,)], "week_num int"), "k")
    assert {r.week_num: r.share for r in share.collect()} == {1: 0.0, 2: 0.5}


def test_series(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])] + [(2, 0, None), (2, 1, 7.0)], "k int, i int, v double")
    got = sorted((r.k, r.i, r.filled) for r in series.gap_filled(df, "k", "i", "v").collect())
    assert [x[2] for x in got] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0, None, 7.0]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in series.upserted(old, new, "k").collect() if r.v) == [(1, "a"), (2, "c")]
    even = spark.createDataFrame([(1, i) for i in range(4)], "k int, i int")
    assert [r.i for r in series.median_row(even, "k", ["i"]).collect()] == [2]
    assert sorted(r.i for r in series.every_nth(even, "k", ["i"], 3).collect()) == [0, 3]


def test_nearest_joins(spark):
    left = spark.createDataFrame([(i, D(2020, 1, 1) + dt.timedelta(i)) for i in range(-5, 40)], "id int, d date")
    dim = [D(2020, 1, 1), D(2020, 1, 6), D(2020, 1, 10), D(2020, 1, 29)]
    got = {r.id: r.v for r in joins.asof_nearest(left, "d", spark.createDataFrame([(d, i) for i, d in enumerate(dim)], "c date, v int"), "c").collect()}
    for i in range(-5, 40):
        day = D(2020, 1, 1) + dt.timedelta(i)
        assert got[i] == min(range(4), key=lambda k: (abs((day - dim[k]).days), k))
    points = spark.createDataFrame([(1, 10, 10), (2, 50, 50)], "id int, row int, col int")
    cells = spark.createDataFrame([(15, 10), (10, 5), (56, 50), (13, 14)], "row int, col int")
    snap = {r.id: (r.snap_row, r.snap_col, r.d2) for r in joins.snap(points, cells).collect()}
    assert snap == {1: (10, 5, 25), 2: (None, None, None)}
    half = spark.createDataFrame([(D(2020, 1, 8),), (D(2020, 1, 22),), (D(2020, 1, 21),)], "d date")
    centers = spark.createDataFrame([(D(2020, 1, 15),)], "c date")
    assert sorted(r.d for r in joins.within_windows(half, "d", centers, "c").collect()) == [D(2020, 1, 8), D(2020, 1, 21)]
    assert one(spark, joins.nearest_value(F.lit(0.075), [0.05, 0.1])) == 0.05


def test_group_folds_are_greedy(spark):
    rng = random.Random(3)
    sizes = {g: rng.randrange(1, 30) for g in range(23)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g int")
    got = {r.g: r.fold for r in sampling.group_folds(df, "g", 4).distinct().collect()}
    load, want = [0] * 4, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        want[g] = load.index(min(load))
        load[want[g]] += sizes[g]
    assert got == want


def test_thinning_is_greedy(spark):
    rng = random.Random(5)
    pts = [(i, rng.random() * 20, rng.random() * 20, rng.randrange(50)) for i in range(300)]
    got = {r.id for r in sampling.thinned(spark.createDataFrame(pts, "id int, x double, y double, r int"), "id", "x", "y", "r", 2.0).collect()}
    want = []
    for p in sorted(pts, key=lambda p: (p[3], p[0])):
        if all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 >= 4 for q in want):
            want.append(p)
    assert got == {p[0] for p in want}


def frame(spark, a):
    return spark.createDataFrame([(i, j, None if np.isnan(x) else float(x)) for (i, j), x in np.ndenumerate(a)], "row int, col int, z double")


def array(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r[col] is None else r[col]
    return out


def test_grid_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(100, 20, (13, 9))
    dy, dx = np.gradient(a, 10.0)
    s = grid.slope_aspect(frame(spark, a), size=10.0)
    assert np.allclose(array(s, "dx", a.shape), dx) and np.allclose(array(s, "dy", a.shape), dy)
    curve = -(np.gradient(dx, 10.0, axis=1) + np.gradient(dy, 10.0, axis=0))
    assert np.allclose(array(grid.laplacian_curvature(frame(spark, a), size=10.0), "curvature", a.shape), curve)
    holes = a.copy()
    holes[rng.random(a.shape) < 0.3] = np.nan
    k = 2
    pad = np.pad(holes, k, mode="edge")
    want = np.array([[np.nanmean(pad[i : i + 5, j : j + 5]) for j in range(9)] for i in range(13)])
    assert np.allclose(array(grid.focal_mean(frame(spark, holes), 5), "focal", a.shape), want)
    targets = a > 125
    d = np.array([[min(((i - y) ** 2 + (j - x) ** 2) ** 0.5 for y, x in zip(*np.nonzero(targets))) for j in range(9)] for i in range(13)])
    assert np.allclose(array(grid.distances(frame(spark, a), F.col("z") > 125), "distance", a.shape), d)
    far = array(grid.distances(frame(spark, a), F.col("z") > 1e9), "distance", a.shape)
    assert np.allclose(far, math.hypot(13, 9))
    flat = grid.sky_view(frame(spark, np.full((5, 5), 3.0)), tile=2)
    assert {(r.horizon, r.svf) for r in flat.collect()} == {(0.0, 1.0)}
    small, large = (array(grid.sky_view(frame(spark, a), cell=10.0, reach_m=40.0, tile=t), "svf", a.shape) for t in (3, 64))
    assert np.allclose(small, large) and (small < 1).any()


def test_resampling(spark):
    a = np.arange(48.0).reshape(6, 8)
    up = grid.bilinear(grid.lattice(spark, 12, 16), frame(spark, a), 0.5, 0.5)
    got = array(up, "z", (12, 16))
    assert got[0, 0] == a[0, 0] and abs(got[1, 1] - (0.75 * 0.75 * 0 + 0.75 * 0.25 * (1 + 8) + 0.25 * 0.25 * 9)) < 1e-9
    smooth = array(grid.cubic(grid.lattice(spark, 6, 8), frame(spark, a), 1.0, 1.0), "z", (6, 8))
    assert np.allclose(smooth[2:4, 2:6], a[2:4, 2:6])  # a plane stays
    b = grid.blocks(frame(spark, a), 4, flag=F.col("z") > 8).collect()
    assert {(r.brow, r.bcol): (r.mean, r.any, r.majority) for r in b} == {(0, 0): (13.5, True, True), (0, 1): (17.5, True, True)}


def test_harmonic_fit_against_numpy(spark):
    rng = np.random.default_rng(2)
    days = [D(2000, 1, 1) + dt.timedelta(int(x)) for x in rng.integers(0, 2000, 300)]
    y = rng.normal(size=300)
    df = spark.createDataFrame([(1, d, float(v)) for d, v in zip(days, y)] + [(2, days[0], 3.0), (2, days[1], None)], "k int, d date, y double")
    got = {r.k: r for r in harmonic_fit(df, "k", "d", "y").collect()}
    w = 2 * np.pi / 365 * np.array([d.timetuple().tm_yday for d in days])
    x = np.stack([np.ones(300), np.cos(w), np.sin(w), np.cos(2 * w), np.sin(2 * w)], 1)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(got[1].beta, b) and abs(got[1].sigma - np.sqrt(((y - x @ b) ** 2).sum() / 295)) < 1e-9
    assert got[2].n == 1 and got[2].sigma < 1e-6


def test_models(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 30), float(x[0]), float(x[1]), float(3 * x[0] + rng.normal(0, 0.1))) for i, x in enumerate(rng.random((1500, 2)))]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 1.0), (1, float("nan"), 1.0, 1.0)], "g int, a double, b double, y double")
    model = models.fit(df, models.forest(["a", "b"], "y", trees=10, depth=6, leaf=5))
    got = models.metrics(model.transform(models.complete(df, ["a", "b", "y"])), "y", "predicted").first()
    assert got.r2 > 0.95 and got.n == 1500
    ranks = {r.feature: r.rank for r in models.importances(spark, model).collect()}
    assert ranks == {"a": 1, "b": 2}
    rise = {r.feature: r.rise for r in models.permuted(models.complete(df, ["a", "b", "y"]), model, ["a", "b"], "y").collect()}
    assert rise["a"] > 0.3 > abs(rise["b"])
    pd1 = {r.a: r.mean_predicted for r in models.partial_dependence(models.complete(df, ["a", "b", "y"]), model, {"a": [0.1, 0.9]}).collect()}
    assert pd1[0.9] - pd1[0.1] > 1.5
    cv = models.cross_validated(models.complete(df, ["a", "b", "y"]), lambda: models.forest(["a", "b"], "y", trees=5, depth=5, leaf=5), "g", "y", 3).collect()
    assert len(cv) == 3 and all(r.r2 > 0.9 for r in cv)
    assert models.available(df, ["z", "b", "a"]) == ["b", "a"]


def test_text_sources(spark):
    head = "USC00311234200002TMIN"
    slots = ["  -55   ", "-9999   ", "        ", "  120  X"] + ["   10   "] * 27
    lines = [head + "".join(slots), head[:17] + "PRCP" + "".join(slots), "USC00311234" + "198902TMIN" + "".join(slots), head]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = sorted(text.daily_lines(df).collect(), key=lambda r: r.date)
    assert [(r.date.day, r.value, r.qflag) for r in got][:3] == [(1, -5.5, ""), (4, 12.0, ""), (5, 1.0, "")] or [(r.date.day, r.value) for r in got][:3] == [(1, -5.5), (4, 12.0), (5, 1.0)]
    assert got[-1].date == D(2000, 2, 29) and {r.element for r in got} == {"TMIN"}
    inv = spark.createDataFrame([("A 1.0 2.0 TMIN 1990 2021",), ("bad line",), ("  B 1 2 TMAX 1990 x",)], "value string")
    assert [tuple(r) for r in text.inventory_lines(inv).collect()] == [("A", "TMIN", 1990, 2021)]
    names = spark.createDataFrame([("HLS.L30.T17SNA.2023045T120000.NDVI",), ("a_20190115T024352_b",), ("2023366T",), ("x",)], "n string")
    g, layer = text.granule(F.col("n"))
    rows = names.select(text.julian_date(F.col("n")).alias("j"), text.stamp(F.col("n")).alias("t"), g.alias("g"), layer.alias("l")).collect()
    assert rows[0].j == D(2023, 2, 14) and rows[1].t == dt.datetime(2019, 1, 15, 2, 43, 52) and rows[2].j is None and rows[3].l == "unknown"
    with pytest.raises(FileNotFoundError):
        text.first_readable(spark, ["/nowhere/at/all"])


def test_ranks(spark):
    rng = random.Random(8)
    xs = [rng.randrange(500) + i / 1000 for i in range(317)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert {r.x: r["rank"] for r in sampling.ranked(df, "x").collect()} == {x: i + 1 for i, x in enumerate(sorted(xs))}
    folds = sorted((r.x, r.fold) for r in sampling.runs(df, "x", 5).collect())
    assert [f for _, f in folds] == [0] * 64 + [1] * 64 + [2] * 63 + [3] * 63 + [4] * 63
    assert [r.fold for r in sampling.runs(df.limit(2), "x", 5).orderBy("x").collect()] == [0, 1]


def test_null_days_match_nothing(spark):
    left = spark.createDataFrame([(1, D(2020, 1, 3)), (2, None)], "k int, d date")
    composites = spark.createDataFrame([(D(2020, 1, 1), 10.0), (D(2020, 1, 20), 20.0)], "day date, v double")
    assert {r.k: (r.nearest, r.v) for r in joins.asof_nearest(left, "d", composites, "day").collect()} == {1: (D(2020, 1, 1), 10.0), 2: (None, None)}
    assert {r.k: r.v for r in joins.with_fallback(left, "d", composites, "day", "v", 2013).collect()} == {1: 10.0, 2: None}


def test_ranks_of_heavy_keys(spark):
    rows = [(7, i) for i in range(900)] + [(k, 0) for k in range(60)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    got = sampling.ranked(df, "k", "v").collect()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(r["rank"] for r in sampling.ranked(df, "k").collect()) == list(range(1, 962))
    assert sampling.ranked(df.limit(0), "k").count() == 0


def test_sample_of_a_heavy_group(spark):
    rows = [("a", i) for i in range(1000)] + [("b", i) for i in range(3)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {}
    for r in sampling.sample_per_group(df, "g", 0.1, "v").collect():
        got.setdefault(r.g, set()).add(r.v)
    draws = lambda vs: sorted(vs, key=lambda v: (hashlib.md5(f"{v}|42".encode()).hexdigest(), v))
    assert got == {"a": set(draws(range(1000))[:100]), "b": {draws(range(3))[0]}, None: {draws([1, 2])[0]}}


def slow_folds(sizes, folds):
    load, out = [0] * folds, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = min(range(folds), key=lambda f: (load[f], f))
        out[g] = f
        load[f] += n
    return out


@pytest.mark.parametrize("seed", range(4))
def test_folds_against_the_greedy_pass(spark, seed):
    rng = random.Random(seed)
    sizes = {g: rng.choice([1, 1, 2, 2, 3, 5, 40, 41, 200]) for g in range(rng.choice([3, 40, 120]))}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g int")
    folds = rng.choice([2, 3, 5])
    got = {r.g: r.fold for r in sampling.group_folds(df, "g", folds).distinct().collect()}
    assert got == slow_folds(sizes, folds)


def test_rounds_of_groups():
    for seed in range(300):
        rng = random.Random(seed)
        load = [rng.randrange(50) for _ in range(rng.randrange(1, 6))]
        n, count = rng.randrange(1, 12), rng.randrange(0, 80)
        want, mine = list(load), list(load)
        order = []
        for _ in range(count):
            f = min(range(len(want)), key=lambda f: (want[f], f))
            want[f] += n
            order.append(f)
        got = [f for length, cycle in sampling.rounds_of(mine, n, count) for k in range(length) for f in [cycle[k % len(cycle)]]]
        assert got == order and mine == want, (seed, load)


def test_bins_with_odd_values(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (float("nan"),), (None,)], "x double")
    assert [r.b for r in sampling.binned(df, "x", 4, "b").collect()] == [0, 2, 3, None, None]


def test_points_and_units(spark):
    texts = ["35.5,-83.25", " 1 , 2 ", "91,0", "0,181", "1", "1,2,3", "a,b", "", None]
    got = [r.p and (r.p.lat, r.p.lon) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(geo.point(F.col("t")).alias("p")).collect()]
    assert got == [(35.5, -83.25), (1.0, 2.0), None, None, None, None, None, None, None]
    north, east = spark.range(1).select(*geo.degrees_per_metre(F.lit(60.0))).first()
    assert abs(north * 111_319.49 - 1) < 1e-6 and abs(east / north - 2) < 1e-9
    assert spark.range(1).select(stats.celsius(F.lit(300.0))).first()[0] == 300 - 273.15


def test_tables_in_between_go(spark):
    from hoarfrost.operators.storage import scratch, written

    with scratch():
        gone, there = written(spark.range(2), "x"), written(spark.range(2), "y", keep=True)
        assert gone.count() == 2
    assert there.count() == 2 and not os.path.exists(gone._written_at.removeprefix("file:"))


def test_cube_by_variable(spark):
    rng = np.random.default_rng(3)
    cells = [(D(2020, 1, t), r, c, float(rng.random()), float(rng.random()) if (r, c, t) != (2, 2, 1) else None) for t in (1, 2) for r in range(9) for c in range(8)]
    cube = spark.createDataFrame(cells, "time date, row int, col int, pr double, tmin double")
    targets = grid.lattice(spark, 6, 5)
    got = {(r.time, r.row, r.col): r for r in grid.cube_resampled(targets, cube, "time", {"pr": "nearest", "tmin": "bilinear"}, 1.5, 1.6).collect()}
    assert len(got) == 60
    for t in (1, 2):
        one = cube.where(F.col("time") == F.lit(D(2020, 1, t)))
        for name, way in (("pr", grid.nearest), ("tmin", grid.bilinear)):
            for r in way(targets, one, 1.5, 1.6, z=name).collect():
                assert abs(got[D(2020, 1, t), r.row, r.col][name] - r.z) < 1e-9


def test_files_that_are_missing(spark, tmp_path):
    line = "USC00311234" + "200002" + "TMIN" + "  -55 X " + "-9999   " + "        " + "   10   " * 28
    (tmp_path / "a.dly").write_text(line + "\n" + line[:40] + "\n")
    got = text.daily_files(spark, [f"{tmp_path}/a.dly", f"{tmp_path}/b.dly"]).collect()
    assert len(got) == 27 and got[0].value == -5.5 and got[0].qflag == "X"  # 29 days less one blank and one without a value
    assert text.daily_files(spark, [f"{tmp_path}/none.dly"]).count() == 0
    assert text.optional(spark, f"{tmp_path}/none") is None
    spark.range(2).write.parquet(f"{tmp_path}/some")
    assert text.optional(spark, f"{tmp_path}/some").count() == 2


def test_draws_are_not_written(spark, monkeypatch):
    """A sample's draws order its rows by their digits, and go before the rows are written."""
    kept, write = [], sampling.written
    monkeypatch.setattr(sampling, "written", lambda df, name: kept.append(df.columns) or write(df, name))
    df = spark.createDataFrame([(k % 3, k) for k in range(60)], "g int, k int")
    got = sorted((r.g, r.k) for r in sampling.sample_per_group(df, "g", 0.25, "k").collect())
    drawn = sorted((r.g, r.h, r.k) for r in df.withColumn("h", sampling.draw("k")).collect())
    assert got == sorted((g, k) for x in range(3) for g, _, k in [d for d in drawn if d[0] == x][:5])
    assert kept and not any("_h" in c for c in kept)
