"""The whole run as kept stages, and the forecast's modes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal
from hoarfrost.functions import stats
from hoarfrost.operators import driver
from hoarfrost.operators import models as model_ops
from hoarfrost.operators import sampling as sample_ops
from hoarfrost.operators.storage import shared_dir

from . import cleaning, joining
from . import views as v
from .forecasts import FORECAST, SMOOTHED, TARGET, USED, forecast
from .registry import ORACLES, query
from .seasons import COUNTS, WEEKS, rounded, smoothed
from .workflows import training

#: Fall of the log odds of frost for a degree above the mean.
SLOPE = 0.4


def forecast_anomaly(spark, sf_dir, init: str):
    """One row: how far the forecasts of an init month lie above the mean of all init months of that name."""
    fc = forecast(spark, sf_dir).withColumn("t", cal.month_since_1960(F.col("target"))).where((F.abs("fcst") > 1e-6) | F.month("t").isin(9, 10, 11))
    day = F.lit(init).cast("date")
    same = fc.where(F.month("init") == F.month(day))
    return same.agg((F.avg(F.when(F.col("init") == day, F.col("fcst"))) - F.avg("fcst")).alias("anomaly"))


def seasonal_forecast(spark, sf_dir, base, mode: str, value=None):
    """Weekly frost probabilities of a season: mode climatology (no anomaly), anomaly (value degrees) or ensemble (forecasts of the init month value; none give null)."""
    if mode == "ensemble":
        anomaly = forecast_anomaly(spark, sf_dir, value)
    elif mode in ("climatology", "anomaly"):
        anomaly = spark.range(1).select(F.lit(0.0 if mode == "climatology" else float(value)).alias("anomaly"))
    else:
        raise ValueError(f"no mode {mode}")
    label = F.concat_ws("_", F.lit(mode), F.lit(None if value is None else str(value)))
    odds = stats.logit(F.col("p")) - SLOPE * F.col("anomaly")
    return base.crossJoin(F.broadcast(anomaly)).select(label.alias("label"), "entity", "week_num", stats.sigmoid(odds).alias("prob"))  # one row


def weekly(spark, sf_dir):
    return smoothed(spark, sf_dir).groupBy("entity", "week_num").agg(F.avg("frost_prob").alias("p"))


INIT = "1995-08-01"


@query(v.with_(v.OBS, COUNTS, WEEKS, SMOOTHED, FORECAST, "v_base AS (SELECT entity, week_num, avg(frost_prob) AS p FROM v_smooth GROUP BY 1, 2)",
f"v_ens AS (SELECT avg(fcst) FILTER (init = DATE '{INIT}') - avg(fcst) AS a FROM (SELECT *, {TARGET} AS t FROM v_fc) WHERE {USED} AND month(init) = month(DATE '{INIT}'))",
f"v_an AS (SELECT 'climatology' AS label, 0.0::DOUBLE AS a UNION ALL SELECT 'anomaly_1.5', 1.5 UNION ALL SELECT 'ensemble_{INIT}', a FROM v_ens)",
body="""SELECT label, entity, week_num, round(1 / (1 + exp(-(ln(greatest(least(p, 0.999::DOUBLE), 0.001::DOUBLE) / (1 - greatest(least(p, 0.999::DOUBLE), 0.001::DOUBLE))) - 0.4::DOUBLE * a))), 6) AS prob FROM v_base CROSS JOIN v_an"""))
def seasonal_forecasts(spark, sf_dir):
    """The forecast in all three modes."""
    base, out = weekly(spark, sf_dir), None
    for mode, value in (("climatology", None), ("anomaly", 1.5), ("ensemble", INIT)):
        one = seasonal_forecast(spark, sf_dir, base, mode, value)
        out = one if out is None else out.unionByName(one)
    return rounded(out, "prob")


def stages(spark, sf_dir, rows=500_000, share=0.3, seed=42, trees=200, depth=25, forecasts=(("climatology", None), ("anomaly", 1.5), ("ensemble", INIT))) -> list[driver.Stage]:
    """Composites, outlier filter, alignment, training rows, split, model, scores, weekly probabilities, and a forecast for each mode."""
    at = lambda *names: tuple(f"{sf_dir}/{n}.parquet" for n in names)
    features = ["base", "clim", "size", "elev", "doy"]

    def fitted(split, trees, depth):
        model = model_ops.fit(split.where(~F.col("is_test")), model_ops.forest(model_ops.available(split, features), "lst", trees=trees, depth=depth))
        return model.transform(split.where("is_test"))

    out = [
        driver.Stage("ndvi", lambda: joining.window_max_composite(spark, sf_dir), tables=at("events", "lineitem", "part", "orders", "customer")),
        driver.Stage("filter", lambda: cleaning.two_pass_outlier_filter(spark, sf_dir), tables=at("lineitem", "part")),
        driver.Stage("align", lambda: joining.asof_nearest_date(spark, sf_dir), tables=at("lineitem", "part", "orders", "customer")),
        driver.Stage("rows", lambda rows: training(spark, sf_dir, rows).withColumn("doy", F.dayofyear("d")), params={"rows": rows}, tables=at("lineitem", "part", "orders", "customer")),
        driver.Stage("split", lambda rows, share, seed: sample_ops.group_split(rows, "scene", share, seed), ("rows",), {"share": share, "seed": seed}),
        driver.Stage("model", fitted, ("split",), {"trees": trees, "depth": depth}),
        driver.Stage("scores", lambda model: model_ops.metrics(model, "lst", "predicted"), ("model",)),
        driver.Stage("weekly", lambda: weekly(spark, sf_dir), tables=at("orders", "customer")),
    ]
    for mode, value in forecasts:
        out.append(driver.Stage(f"forecast_{mode}", lambda weekly, mode, value: seasonal_forecast(spark, sf_dir, weekly, mode, value), ("weekly",), {"mode": mode, "value": value}, at("orders")))
    return out


def _count(stage: str, name: str) -> str:
    return f"SELECT '{stage}' AS stage, (SELECT count(*) FROM ({ORACLES[name]})) AS n"


WEEKS_OF = v.with_(v.OBS, COUNTS, WEEKS, SMOOTHED, body="SELECT DISTINCT entity, week_num FROM v_smooth")


@query(" UNION ALL ".join([
    _count("ndvi", "window_max_composite"), _count("filter", "two_pass_outlier_filter"), _count("align", "asof_nearest_date"), f"SELECT 'rows', CAST((SELECT sum(n) FROM ({ORACLES['training_table']})) AS BIGINT)", f"SELECT 'split', CAST((SELECT sum(n) FROM ({ORACLES['training_table']})) AS BIGINT)",
    f"SELECT 'weekly', (SELECT count(*) FROM ({WEEKS_OF}))", *[f"SELECT 'forecast_{m}', (SELECT count(*) FROM ({WEEKS_OF}))" for m in ("climatology", "anomaly", "ensemble")],
]))
def staged_run(spark, sf_dir):
    """Rows of each kept stage of a run (all but the model and its scores, which have queries of their own)."""
    some = [s for s in stages(spark, sf_dir) if s.name not in ("model", "scores")]
    frames, _ = driver.run(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", some)
    out = None
    for name, df in frames.items():
        one = df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
