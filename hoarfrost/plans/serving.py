"""Queries behind maps and lookups, and on names and file lines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal
from hoarfrost.functions import geo
from hoarfrost.operators import season as season_ops
from hoarfrost.operators import series as series_ops
from hoarfrost.operators.quantiles import matched, quantiles
from hoarfrost.sources import text as src

from . import views as v
from .registry import query
from .seasons import CLIM, COUNTS, CROSS, CURVE, SMOOTH, THRESHOLDS, WEEKS, curve, rounded


def crossings(spark, sf_dir):
    return season_ops.threshold_crossings(curve(spark, sf_dir), "entity", "week_num", THRESHOLDS)


CHAIN = (v.OBS, COUNTS, WEEKS, SMOOTH, CLIM, CURVE, CROSS)


@query(v.with_(*CHAIN, v.STATION, body="SELECT station_id, lat, lon, step AS week, CAST(DATE '2001-09-01' + CAST((step - 1) * 7 + 3 AS INTEGER) AS DATE) AS last_frost FROM v_cross JOIN v_station ON entity = station_id WHERE threshold = 0.5"))
def last_frost_map(spark, sf_dir):
    """Week and date of the last frost of every place at one confidence."""
    week = crossings(spark, sf_dir).where("threshold = 0.5").select("entity", F.col("step").alias("week"))
    meta = v.station(spark, sf_dir).select("station_id", "lat", "lon")
    return week.join(meta, F.col("entity") == F.col("station_id")).select("station_id", "lat", "lon", "week", cal.week_to_date(F.col("week"), F.lit(2001)).alias("last_frost"))


@query(v.with_(*CHAIN, v.STATION, body="SELECT name, threshold, step FROM v_cross JOIN v_station ON entity = station_id WHERE lat BETWEEN 35.5 AND 35.7"))
def last_frost_series(spark, sf_dir):
    """Crossing weeks at every confidence for the places of one latitude band."""
    near = v.station(spark, sf_dir).where(F.col("lat").between(35.5, 35.7)).select("station_id", "name")
    return crossings(spark, sf_dir).join(near, F.col("entity") == F.col("station_id")).select("name", "threshold", "step")


@query(v.with_(*CHAIN, body="SELECT threshold, round(100.0::DOUBLE * count(*) FILTER (step IS NULL) / count(*), 6) AS not_reached_pct, round(quantile_cont(step, 0.5), 6) AS median_week FROM v_cross GROUP BY 1"))
def not_reached_share(spark, sf_dir):
    rows = crossings(spark, sf_dir)
    median = quantiles(rows, "step", [0.5], "threshold").select("threshold", F.round(F.col("q")[0], 6).alias("median_week"))
    return matched(rows.groupBy("threshold").agg(F.round(100.0 * F.count_if(F.col("step").isNull()) / F.count(F.lit(1)), 6).alias("not_reached_pct")), median, ["threshold"])


@query(v.with_(*CHAIN, body="SELECT entity, min(CASE WHEN p >= 0.5 THEN week_num END) AS first_week, round(max(p), 6) AS top FROM v_clim GROUP BY 1"))
def first_week_at_confidence(spark, sf_dir):
    from .seasons import climatology

    return climatology(spark, sf_dir).groupBy("entity").agg(F.min(F.when(F.col("p") >= 0.5, F.col("week_num"))).alias("first_week"), F.round(F.max("p"), 6).alias("top"))


def utm_sql(source: str, lat: str = "lat", lon: str = "lon", zone: int = 17) -> str:
    """Common tables v_t, v_x and v_utm: source with east and north, by Krueger's series."""
    e2 = 2 * math.sqrt(geo._N) / (1 + geo._N)
    x = " + ".join(["eta", *(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))])
    y = " + ".join(["xi", *(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))])
    k = f"{geo.SCALE * geo._RADIUS!r}::DOUBLE"
    return f"""v_t AS (SELECT *, sinh(atanh(sin(radians({lat}))) - {e2!r}::DOUBLE * atanh({e2!r}::DOUBLE * sin(radians({lat})))) AS t, radians({lon} - ({zone * 6 - 183})) AS dl FROM {source}),
v_x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM v_t),
v_utm AS (SELECT *, 500000.0::DOUBLE + {k} * ({x}) AS east, {k} * ({y}) AS north FROM v_x)"""


PIXEL = "CAST(round_even((3990968.829495334::DOUBLE - north) / 100.0::DOUBLE - 0.5::DOUBLE, 0) AS INTEGER) AS row, CAST(round_even((east - 301472.366725655::DOUBLE) / 100.0::DOUBLE - 0.5::DOUBLE, 0) AS INTEGER) AS col"


@query(v.with_(v.STATION, utm_sql("v_station"), body=f"SELECT station_id, round(east, 6) AS east, round(north, 6) AS north, {PIXEL}, round(lat, 6) AS lat_back, round(lon, 6) AS lon_back FROM v_utm"))
def utm_lookup(spark, sf_dir):
    """Grid pixel of every station, and the way back to degrees."""
    east, north = geo.utm(F.col("lat"), F.col("lon"))
    out = v.station(spark, sf_dir).withColumn("east", east).withColumn("north", north)
    row, col = geo.pixel(F.col("east"), F.col("north"), 301472.366725655, 3990968.829495334)
    lat, lon = geo.wgs84(F.col("east"), F.col("north"))
    return rounded(out.select("station_id", "east", "north", row.alias("row"), col.alias("col"), lat.alias("lat_back"), lon.alias("lon_back")), "east", "north", "lat_back", "lon_back")


@query("""SELECT p_partkey, CAST(round_even((3990968.8::DOUBLE - y) / 100.0::DOUBLE - 0.5::DOUBLE, 0) AS INTEGER) AS row, CAST(round_even((x - 301472.4::DOUBLE) / 100.0::DOUBLE - 0.5::DOUBLE, 0) AS INTEGER) AS col
FROM (SELECT p_partkey, 301472.4::DOUBLE + p_retailprice * 7 AS x, 3990968.8::DOUBLE - p_size * 111.0::DOUBLE AS y FROM part)""")
def pixel_lookup(spark, sf_dir):
    p = v.table(spark, sf_dir, "part").select("p_partkey", (301472.4 + F.col("p_retailprice") * 7).alias("x"), (3990968.8 - F.col("p_size") * 111.0).alias("y"))
    row, col = geo.pixel(F.col("x"), F.col("y"), 301472.4, 3990968.8)
    return p.select("p_partkey", row.alias("row"), col.alias("col"))


NAMES = """v_names AS (SELECT c_custkey AS id, 'SCN_v1_' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '_a_b_' || CAST(2000 + c_custkey % 20 AS VARCHAR) || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '15T0' || CAST(c_custkey % 10 AS VARCHAR) || '3000_x_y_z' ||
CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN '_LST' ELSE '_LST_err' END || '.2015' || lpad(CAST(1 + c_custkey % 366 AS VARCHAR), 3, '0') || 'T' AS name FROM customer)"""


def names(spark, sf_dir):
    k = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    layer = F.when(k % 3 == 0, "").when(k % 3 == 1, "_LST").otherwise("_LST_err")
    name = F.concat(F.lit("SCN_v1_"), pad(k, 5), F.lit("_a_b_"), (2000 + k % 20).cast("string"), pad(1 + k % 12, 2), F.lit("15T0"), (k % 10).cast("string"), F.lit("3000_x_y_z"), layer, F.lit(".2015"), pad(1 + k % 366, 3), F.lit("T"))
    return v.table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"))


@query(v.with_(NAMES, body=r"""SELECT id, strptime(regexp_extract(name, '(\d{8}T\d{6})', 1), '%Y%m%dT%H%M%S')::TIMESTAMP AS ts, CASE WHEN CAST(regexp_extract(name, '\.2015(\d{3})T', 1) AS INTEGER) <= 365 THEN CAST(DATE '2015-01-01' + (CAST(regexp_extract(name, '\.2015(\d{3})T', 1) AS INTEGER) - 1) AS DATE) END AS day,
array_to_string(list_slice(string_split(name, '_'), 1, 9), '_') AS granule, CASE WHEN len(string_split(name, '_')) > 9 THEN array_to_string(list_slice(string_split(name, '_'), 10, 99), '_') ELSE 'unknown' END AS layer FROM v_names"""))
def granule_name_parse(spark, sf_dir):
    granule, layer = src.granule(F.col("name"))
    return names(spark, sf_dir).select("id", src.stamp(F.col("name")).alias("ts"), src.julian_date(F.col("name")).alias("day"), granule.alias("granule"), layer.alias("layer"))


@query("SELECT n_regionkey AS grp, count(*) AS n_layers, string_agg(n_name || '=' || CAST(n_nationkey AS VARCHAR), ';' ORDER BY n_name) AS layers FROM nation GROUP BY 1")
def layers_map(spark, sf_dir):
    """A map from layer to its number for each group, and as text."""
    m = v.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("grp")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("grp", F.size("m").cast("long").alias("n_layers"), F.array_join(pairs, ";").alias("layers"))


def daily_text(spark, sf_dir):
    """Monthly fixed-width lines made of the observations."""
    obs = v.obs(spark, sf_dir).select("entity", F.year("d").alias("y"), F.month("d").alias("m"), F.dayofmonth("d").alias("day"), F.round(F.col("tmin") * 10).cast("int").alias("t"))
    line = obs.groupBy("entity", "y", "m").agg(F.map_from_entries(F.collect_list(F.struct("day", "t"))).alias("days"))
    slots = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda d: F.concat(F.lpad(F.coalesce(F.col("days")[d], F.lit(-9999)).cast("string"), 5, " "), F.lit("   "))), "")
    return line.select(F.concat(F.lpad(F.col("entity").cast("string"), 11, "0"), F.format_string("%04d%02d", "y", "m"), F.lit("TMIN"), slots).alias("value"))


@query(v.with_(v.OBS, body="SELECT lpad(CAST(entity AS VARCHAR), 11, '0') AS station_id, d AS date, 'TMIN' AS element, round(tmin * 10) / 10.0::DOUBLE AS value, '' AS qflag FROM v_obs"))
def dly_unpivot(spark, sf_dir):
    """Wide monthly lines written from the observations and read back as days."""
    return src.daily_lines(daily_text(spark, sf_dir))


@query(v.with_(v.STATION, body="SELECT lpad(CAST(station_id AS VARCHAR), 11, '0') AS station_id, round(lat, 4) AS lat, round(lon, 4) AS lon, 12.5::DOUBLE AS elevation, name FROM v_station"))
def station_text_parse(spark, sf_dir):
    """Fixed-width station lines, read back."""
    s = v.station(spark, sf_dir)
    num = lambda c, n: F.lpad(F.format_string("%.4f", c), n, " ")
    lines = s.select(F.concat(F.lpad(F.col("station_id").cast("string"), 11, "0"), F.lit(" "), num("lat", 8), F.lit(" "), num("lon", 9), F.lit(" "), F.lit("  12.5"), F.lit("    "), F.rpad("name", 30, " "), F.lit(" " * 20)).alias("value"))
    return src.station_lines(lines)


@query(v.with_(v.LONG, body="SELECT entity, d, count(*) AS n, round(avg(value), 6) AS mean FROM v_long WHERE entity BETWEEN 10 AND 19 AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1, 2"))
def windowed_subset(spark, sf_dir):
    """A window in space and time: comparisons that reach the scan."""
    e = v.long_obs(spark, sf_dir).where(F.col("entity").between(10, 19) & F.col("d").between("2024-01-05", "2024-01-12"))
    return e.groupBy("entity", "d").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT c_custkey, round(c_acctbal, 6) AS balance FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def top_k_report(spark, sf_dir):
    """The five largest values: a top-n, where the limit is the feature."""
    return v.table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select("c_custkey", F.round("c_acctbal", 6).alias("balance"))


@query(v.with_(v.LONG, body="SELECT entity, min(ts) AS first_ts, max(ts) AS last_ts FROM v_long GROUP BY 1"))
def latest_and_first(spark, sf_dir):
    first = v.long_obs(spark, sf_dir).groupBy("entity").agg(F.min("ts").alias("first_ts"))
    last = series_ops.newest(v.long_obs(spark, sf_dir).select("entity", "ts"), "entity", "ts")
    return first.join(last, "entity").select("entity", "first_ts", F.col("ts").alias("last_ts"))
