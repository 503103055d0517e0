"""Queries made of several operators, and small ones around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal
from hoarfrost.functions import geo, stats
from hoarfrost.operators import grid as grid_ops
from hoarfrost.operators import models as model_ops
from hoarfrost.operators import sampling as sample_ops
from hoarfrost.operators import season as season_ops
from hoarfrost.operators import series as series_ops
from hoarfrost.operators import training as train_ops
from hoarfrost.operators.harmonic import harmonic_fit
from hoarfrost.operators.storage import written

from . import views as v
from .registry import query
from .serving import PIXEL, utm_sql
from .seasons import CLIM, COUNTS, SMOOTH, WEEKS, climatology, rounded, smoothed

SCENES = "v_sc AS (SELECT scene, count(*) AS total, count(*) FILTER (lst > 20) AS valid, CASE WHEN scene % 3 = 0 THEN 'predawn' WHEN scene % 3 = 1 THEN 'evening' ELSE 'daytime' END AS kind FROM v_scene GROUP BY 1)"
CLIMATE = "v_day AS (SELECT d, avg(tmin) AS clim FROM v_obs GROUP BY 1)"
COVER = "v_cov AS (SELECT p_partkey AS pixel, p_size AS size, p_retailprice / 10.0::DOUBLE AS elev FROM part WHERE p_size > 5)"


def training(spark, sf_dir, rows=500_000):
    cells = v.scene(spark, sf_dir)
    kind = F.when(F.col("scene") % 3 == 0, "predawn").when(F.col("scene") % 3 == 1, "evening").otherwise("daytime")
    scenes = cells.groupBy("scene").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lst") > 20).alias("valid")).withColumn("kind", kind)
    climate = v.obs(spark, sf_dir).groupBy("d").agg(F.avg("tmin").alias("clim"))
    p = v.table(spark, sf_dir, "part")
    cover = p.select(F.col("p_partkey").alias("pixel"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("size"), (F.col("p_retailprice") / 10.0).alias("elev"))
    return train_ops.assembled(cells, train_ops.qualified(scenes, "kind", "valid", "total"), climate, cover, rows)


@query(v.with_(v.SCENE, v.OBS, SCENES, CLIMATE, COVER, """v_j AS (SELECT * FROM v_scene JOIN v_sc USING (scene) JOIN v_day USING (d) JOIN v_cov USING (pixel) WHERE kind IN ('predawn', 'evening') AND valid > 0.1::DOUBLE * total)""", body="""
SELECT scene, count(*) AS n, min(size) AS size_low FROM (SELECT *, count(*) OVER (PARTITION BY scene) AS m, (SELECT least(1.0::DOUBLE, 500000 / count(*)::DOUBLE) FROM v_j) AS f,
row_number() OVER (PARTITION BY scene ORDER BY md5(concat_ws('|', CAST(scene AS VARCHAR), CAST(pixel AS VARCHAR), strftime(d, '%Y-%m-%d'), '42')), scene, pixel, d) AS i FROM v_j) WHERE i <= greatest(1, floor(m * f)) GROUP BY 1"""))
def training_table(spark, sf_dir):
    """Rows of every scene in the training table."""
    return training(spark, sf_dir).groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size_low"))


@query()
def train_and_evaluate(spark, sf_dir):
    """Training table, grouped split, forest and its metrics on held-out scenes."""
    split = written(sample_ops.group_split(training(spark, sf_dir).withColumn("doy", F.dayofyear("d")), "scene"), "split")
    features = model_ops.available(split, ["base", "clim", "size", "elev", "doy", "not_there"])
    model = model_ops.fit(split.where(~F.col("is_test")), model_ops.forest(features, "lst"))
    return model_ops.metrics(model.transform(split.where("is_test")), "lst", "predicted")


@query()
def gbt_frost_model(spark, sf_dir):
    """Boosted trees on the log odds of weekly frost; predicted maps for three anomalies."""
    p = smoothed(spark, sf_dir).join(v.station(spark, sf_dir).select(F.col("station_id").alias("entity"), "lat", "lon"), "entity")
    c, s = stats.cyclic(F.col("week_num"), 52.0)
    anomaly = season_ops.seasonal_anomaly(v.obs(spark, sf_dir), "entity").select("entity", "frost_year", "anomaly")
    rows = p.join(anomaly, ["entity", "frost_year"]).select("entity", "week_num", "lat", "lon", "anomaly", c.alias("wc"), s.alias("ws"), stats.logit(F.col("frost_prob")).alias("y"))
    features = ["lat", "lon", "wc", "ws", "anomaly"]
    model = model_ops.fit(rows, model_ops.boosted(features, "y"))
    base = rows.select("entity", "week_num", "lat", "lon", "wc", "ws").distinct().withColumn("anomaly", F.explode(F.array(*map(F.lit, (-1.0, 0.0, 1.0)))))
    return model.transform(base).select("entity", "week_num", "anomaly", stats.sigmoid(F.col("predicted")).alias("frost_prob"))


@query()
def mu_sigma_model(spark, sf_dir):
    """Two models, of the weekly mean and of the logarithm of the deviation, and the frost probability they give."""
    fit = harmonic_fit(v.obs(spark, sf_dir), "entity", "d", "tmin")
    weeks = cal.week_calendar(spark).select("week_num", "center_doy")
    terms = stats.harmonics(F.col("center_doy"))
    mu = sum((F.col("beta")[i] * t for i, t in enumerate(terms[1:], 1)), F.col("beta")[0])
    c, s = stats.cyclic(F.col("week_num"), 52.0)
    rows = fit.crossJoin(F.broadcast(weeks)).withColumn("mu", mu).withColumn("ls", F.ln(F.greatest("sigma", F.lit(0.01)))).withColumn("wc", c).withColumn("ws", s)  # 39 weeks
    rows = rows.join(v.station(spark, sf_dir).select(F.col("station_id").alias("entity"), "lat"), "entity")
    a = model_ops.fit(rows, model_ops.boosted(["lat", "wc", "ws"], "mu")).transform(rows).withColumnRenamed("predicted", "pm")
    b = model_ops.fit(rows, model_ops.boosted(["lat", "wc", "ws"], "ls")).transform(a)
    return b.select("entity", "week_num", stats.below(0.0, F.col("pm"), F.greatest(F.exp("predicted"), F.lit(0.01))).alias("frost_prob"))


def stepped(spark, sf_dir, steps=5):
    """Weekly probabilities on a finer lattice (steps a week), straight lines between weeks, as chances of each step."""
    w = climatology(spark, sf_dir)
    order = Window.partitionBy("entity").orderBy("week_num")
    ends = w.withColumn("_next", F.coalesce(F.lead("p").over(order), F.col("p")))
    fine = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).where((F.col("week_num") < 39) | (F.col("k") == 0))
    line = F.col("p") + (F.col("_next") - F.col("p")) * (F.col("k") / float(steps))
    return fine.select("entity", ((F.col("week_num") - 1) * steps + F.col("k")).alias("step"), stats.per_step(line, steps).alias("p_step"))


@query(v.with_(v.OBS, COUNTS, WEEKS, SMOOTH, CLIM, """v_fine AS (SELECT entity, CAST((week_num - 1) * 5 + k AS INTEGER) AS step, 1 - (1 - (p + (nx - p) * (k / 5.0::DOUBLE))) ** (1 / 5.0::DOUBLE) AS p_step FROM
(SELECT *, coalesce(lead(p) OVER (PARTITION BY entity ORDER BY week_num), p) AS nx FROM v_clim) CROSS JOIN (SELECT range AS k FROM range(5)) WHERE week_num < 39 OR k = 0),
v_s AS (SELECT *, coalesce(product(1 - p_step) OVER (PARTITION BY entity ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0::DOUBLE) AS survival FROM v_fine)""",
body="SELECT entity, step, round(p_step, 6) AS p_step, round(survival, 6) AS survival FROM v_s"))
def last_frost_steps(spark, sf_dir):
    """The survival product over 191 steps, five a week."""
    curve = season_ops.last_frost_curve(stepped(spark, sf_dir), "entity", "step", "p_step")
    return rounded(curve.select("entity", "step", "p_step", "survival"), "p_step", "survival")


@query()
def spatial_design(spark, sf_dir):
    """Sample points: strata of two measures, a least distance, and the extremes besides (tested by parts)."""
    cells = v.grid(spark, sf_dir)
    cells = grid_ops.position_index(cells, 300.0).withColumn("id", F.shiftleft(F.col("row").cast("long"), 32) + F.col("col"))
    binned = sample_ops.binned(sample_ops.binned(cells, "z", 20, "zbin"), "tpi", 10, "tbin")
    some = sample_ops.stratified(binned, ["zbin", "tbin"], 400, "row", "col").withColumn("x", F.col("col") * 100.0).withColumn("y", F.col("row") * 100.0).withColumn("rank", sample_ops.draw("row", "col", seed=7))
    apart = sample_ops.thinned(some, "id", "x", "y", "rank", 500.0).select("id", "row", "col")
    return apart.unionByName(sample_ops.extremes(cells, ["z", "tpi"], "row", "col").select("id", "row", "col")).distinct()


@query("SELECT c_custkey, CAST(ntile(5) OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS fold FROM customer")
def contiguous_folds(spark, sf_dir):
    """Five runs of rows in order of the key."""
    return sample_ops.runs(v.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 5)


@query(r"""SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS link FROM pages)""")
def html_index_links(spark, sf_dir):
    """Names listed by a page's index."""
    return v.table(spark, sf_dir, "pages").select("page_id", F.explode(F.expr(r"""regexp_extract_all(html, 'href="/([^"/]+)"', 1)""")).alias("link"))


@query("""WITH f AS (SELECT p_partkey AS id, p_brand || '_' || CAST(p_size AS VARCHAR) AS tile, CASE WHEN p_partkey % 2 = 0 THEN 'NDVI' ELSE 'Fmask' END AS kind FROM part)
SELECT a.id AS ndvi_id, b.id AS fmask_id, a.tile FROM f a JOIN (SELECT tile, min(id) AS id FROM f WHERE kind = 'Fmask' GROUP BY 1) b ON a.tile = b.tile WHERE a.kind = 'NDVI'""")
def band_pairing(spark, sf_dir):
    """Each index file with the mask file of its tile and date."""
    p = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("tile"))
    masks = p.where("id % 2 = 1").groupBy("tile").agg(F.min("id").alias("fmask_id"))
    return p.where("id % 2 = 0").withColumnRenamed("id", "ndvi_id").join(masks, "tile").select("ndvi_id", "fmask_id", "tile")


@query("""SELECT l_suppkey, l_linenumber, round(CASE WHEN frac IS NOT NULL THEN frac WHEN removed + kept > 0 THEN removed / (removed + kept)::DOUBLE END, 6) AS fraction FROM
(SELECT l_suppkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN avg(l_discount) END AS frac, count(*) FILTER (l_returnflag = 'R') AS removed, count(*) FILTER (l_returnflag = 'N' AND l_linenumber <> 2) AS kept FROM lineitem GROUP BY 1, 2)""")
def diagnostics_lookup(spark, sf_dir):
    """Fraction removed: the recorded one, else that of the counts, else none."""
    li = v.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("removed"), F.count_if((F.col("l_returnflag") == "N") & (F.col("l_linenumber") != 2)).alias("kept"))
    frac = F.when(F.col("l_linenumber") == 1, F.col("a"))
    return rounded(li.select("l_suppkey", "l_linenumber", train_ops.fraction_removed(frac, F.col("removed"), F.col("kept")).alias("fraction")), "fraction")


@query(v.with_(v.GRID, body="SELECT count(*) AS n, count(*) FILTER (z BETWEEN 495 AND 505) AS n_valid, count(*) FILTER (z BETWEEN 495 AND 505 AND col >= 8) AS n_predicted FROM v_grid"))
def predict_mask(spark, sf_dir):
    """Cells within the valid heights, and those that are predicted besides."""
    ok = F.col("z").between(495, 505)
    return v.grid(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"), F.count_if(ok & (F.col("col") >= 8)).alias("n_predicted"))


@query("""SELECT CAST(y AS INTEGER) AS season, CAST(make_date(CASE WHEN m >= 9 THEN y ELSE y + 1 END, m, 1) AS DATE) AS first_day, CAST(last_day(make_date(CASE WHEN m >= 9 THEN y ELSE y + 1 END, m, 1)) AS DATE) AS final_day
FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) CROSS JOIN (SELECT unnest([9, 10, 11, 12, 1, 2, 3, 4, 5]) AS m)""")
def season_month_ranges(spark, sf_dir):
    """First and last days of every month of the seasons that the observations' years begin."""
    years = v.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season")).distinct()
    y = years.select("season", F.explode(F.array(*map(F.lit, cal.FROST_MONTHS))).alias("m"))
    first = F.make_date(F.when(F.col("m") >= 9, F.col("season")).otherwise(F.col("season") + 1), F.col("m"), F.lit(1))
    return y.select("season", first.alias("first_day"), F.last_day(first).alias("final_day"))


@query("""SELECT c_custkey, CAST(split_part(p, ',', 1) AS DOUBLE) AS lat, CAST(split_part(p, ',', 2) AS DOUBLE) AS lon, lower(c_mktsegment) LIKE '%build%' AS in_context, label FROM
(SELECT c_custkey, c_mktsegment, CAST(35 + c_custkey % 7 AS VARCHAR) || '.5,-' || CAST(80 + c_custkey % 5 AS VARCHAR) || '.25' AS p, printf('anomaly_%+.1fC', (c_custkey % 9 - 4) / 2.0::DOUBLE) AS label FROM customer)""")
def point_and_label_text(spark, sf_dir):
    """'lat,lon' texts as numbers, and formatted labels."""
    k = F.col("c_custkey")
    p = geo.point(F.concat((35 + k % 7).cast("string"), F.lit(".5,-"), (80 + k % 5).cast("string"), F.lit(".25")))
    return v.table(spark, sf_dir, "customer").select("c_custkey", p["lat"].alias("lat"), p["lon"].alias("lon"), F.lower("c_mktsegment").contains("build").alias("in_context"), F.format_string("anomaly_%+.1fC", (k % 9 - 4) / 2.0).alias("label"))


#: Target lattice of the display: it spans the grid's rows (a step is 25/3 cells) and columns (8/5 cells).
LATTICE = """v_n AS (SELECT (max(row) + 1) * 3 + 24 AS h, (max(col) + 1) * 5 + 7 AS w FROM v_grid), v_ll AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 36.03::DOUBLE - i * 0.0075::DOUBLE AS lat, -83.2::DOUBLE + j * 0.002::DOUBLE AS lon
FROM (SELECT unnest(range(h // 25)) AS i FROM v_n) CROSS JOIN (SELECT unnest(range(w // 8)) AS j FROM v_n))"""
FRACTION = "(3990968.829495334::DOUBLE - north) / 100.0::DOUBLE - 0.5::DOUBLE AS pr, (east - 301472.366725655::DOUBLE) / 100.0::DOUBLE - 0.5::DOUBLE AS pc"


@query(v.with_(v.GRID, LATTICE, utm_sql("v_ll"), f"v_at AS (SELECT i, j, {PIXEL}, {FRACTION} FROM v_utm)", "v_near AS (SELECT i, j, pr - floor(pr) AS fr, pc - floor(pc) AS fc, CAST(floor(pr) AS INTEGER) AS r, CAST(floor(pc) AS INTEGER) AS c FROM v_at)", """
v_one AS (SELECT i, j, CASE WHEN count(z) = 4 THEN sum(z * w) END AS z FROM (SELECT i, j, g.z, CASE WHEN dr = 0 THEN 1 - fr ELSE fr END * CASE WHEN dc = 0 THEN 1 - fc ELSE fc END AS w FROM v_near CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc) JOIN v_grid g ON g.row = r + dr AND g.col = c + dc) GROUP BY 1, 2)""",
    body="SELECT i, j, round(v_one.z, 6) AS z, v_grid.z > 500 AS high FROM v_at LEFT JOIN v_grid USING (row, col) LEFT JOIN v_one USING (i, j)"))
def display_reproject(spark, sf_dir):
    """The grid on a longitude-latitude lattice for display: values from the four source cells around (null unless all are known), a mask from the nearest."""
    west, north = 301472.366725655, 3990968.829495334
    grid = v.grid(spark, sf_dir)
    high, wide = grid.agg(F.max("row"), F.max("col")).first()
    lattice = grid_ops.lattice(spark, ((high + 1) * 3 + 24) // 25, ((wide + 1) * 5 + 7) // 8).select(F.col("row").alias("i"), F.col("col").alias("j"))
    lat, lon = 36.03 - F.col("i") * 0.0075, -83.2 + F.col("j") * 0.002
    east, northing = geo.utm(lat, lon)
    row, col = geo.pixel(east, northing, west, north)
    at = lattice.select("i", "j", row.alias("row"), col.alias("col"), ((north - northing) / 100.0 - 0.5).alias("pr"), ((east - west) / 100.0 - 0.5).alias("pc"))
    mask = at.join(grid, ["row", "col"], "left").select("i", "j", (F.col("z") > 500).alias("high"))
    return mask.join(grid_ops.order_one(at, grid), ["i", "j"]).select("i", "j", F.round("z", 6).alias("z"), "high")


@query(v.with_(v.LONG, body="SELECT element, d, n, running FROM (SELECT element, d, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY element ORDER BY d) AS BIGINT) AS running FROM v_long GROUP BY 1, 2)"))
def running_counts(spark, sf_dir):
    """Rows by day and their sum so far."""
    by = v.long_obs(spark, sf_dir).groupBy("element", "d").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("running", F.sum("n").over(Window.partitionBy("element").orderBy("d")))


@query(v.with_(v.OBS, body="SELECT entity, n_years, round(mean_first, 6) AS mean_first, round(std_first, 6) AS std_first, round(free_days, 6) AS free_days FROM (SELECT entity, count(*) AS n_years, avg(f) AS mean_first, stddev_pop(f) AS std_first, avg(f + 365 - l) AS free_days FROM (SELECT entity, CASE WHEN month(d) >= 9 THEN year(d) ELSE year(d) - 1 END AS fy, min(CASE WHEN tmin <= 0 AND month(d) >= 9 THEN CASE WHEN dayofyear(d) >= 244 THEN dayofyear(d) - 244 ELSE dayofyear(d) + 121 END END)::DOUBLE AS f, max(CASE WHEN tmin <= 0 AND month(d) <= 5 THEN CASE WHEN dayofyear(d) >= 244 THEN dayofyear(d) - 244 ELSE dayofyear(d) + 121 END END)::DOUBLE AS l FROM v_obs WHERE month(d) NOT IN (6, 7, 8) GROUP BY 1, 2) GROUP BY 1)"))
def frost_date_statistics(spark, sf_dir):
    """Mean and deviation of first frosts, and days without frost, by place."""
    dates = season_ops.frost_dates(v.obs(spark, sf_dir), "entity", completeness=0.0)
    f, last = F.col("first_fall_frost_doy"), F.col("last_spring_frost_doy")
    out = dates.groupBy("entity").agg(F.count(F.lit(1)).alias("n_years"), F.avg(f).alias("mean_first"), F.stddev_pop(f).alias("std_first"), F.avg(f + 365 - last).alias("free_days"))
    return rounded(out, "mean_first", "std_first", "free_days")


@query(v.with_(v.LONG, body="SELECT DISTINCT entity, CAST(floor(entity / 10.0) AS BIGINT) AS decade FROM v_long"))
def distinct_keys(spark, sf_dir):
    return series_ops.newest(v.long_obs(spark, sf_dir).select("entity", "event_id"), "entity", "event_id").select("entity", F.floor(F.col("entity") / 10).alias("decade"))
