"""Stages: kept, made anew when something before them changes, resumed after a failure; the whole run."""

import pytest
from pyspark.sql import functions as F

from hoarfrost.operators import driver
from hoarfrost.plans import runs

SMALL = "/root/testdata/sf0.001"


def made(done):
    return [d["stage"] for d in done if d["made"]]


def test_stages_are_kept(spark, tmp_path):
    table, folder = f"{tmp_path}/table", f"{tmp_path}/run"
    spark.range(10).write.parquet(table)
    fails = {"on": True}

    def two(one, add):
        if fails["on"]:
            raise RuntimeError("no luck")
        return one.withColumn("id", F.col("id") + add)

    def three(two, one):
        return two.join(one, "id")

    def stages(add=1, version=1):
        return [driver.Stage("one", lambda: spark.read.parquet(table), tables=(table,), version=version), driver.Stage("two", two, ("one",), {"add": add}), driver.Stage("other", lambda: spark.range(3)), driver.Stage("three", three, ("two", "one"))]

    with pytest.raises(RuntimeError, match="no luck"):
        driver.run(spark, folder, stages())
    fails["on"] = False
    frames, done = driver.run(spark, folder, stages())
    assert made(done) == ["two", "other", "three"] and frames["three"].count() == 9  # one was kept
    assert made(driver.run(spark, folder, stages())[1]) == []
    frames, done = driver.run(spark, folder, stages(add=4))
    assert made(done) == ["two", "three"] and frames["three"].count() == 6
    assert len([p for p in (tmp_path / "run/two").iterdir() if p.is_dir()]) == 1  # that of the other parameter is gone
    spark.range(3).write.mode("append").parquet(table)
    assert made(driver.run(spark, folder, stages(add=4))[1]) == ["one", "two", "three"]
    assert made(driver.run(spark, folder, stages(add=4, version=2))[1]) == ["one", "two", "three"]
    with pytest.raises(ValueError, match="before"):
        driver.run(spark, folder, stages()[1:])
    with pytest.raises(FileNotFoundError):
        driver.run(spark, folder, [driver.Stage("one", lambda: spark.range(1), tables=(f"{tmp_path}/none",))])


def test_whole_run(spark, tmp_path):
    """All stages on the smallest tables; then another model and another forecast only."""
    frames, done = driver.run(spark, str(tmp_path), runs.stages(spark, SMALL, trees=3, depth=4))
    assert len(made(done)) == 11 and frames["scores"].first().n > 100
    assert frames["forecast_climatology"].join(frames["weekly"], ["entity", "week_num"]).where(F.abs(F.col("prob") - F.greatest(F.least("p", F.lit(0.999)), F.lit(0.001))) > 1e-9).count() == 0
    warm, mild = frames["forecast_anomaly"], frames["forecast_climatology"]
    assert warm.withColumnRenamed("prob", "w").join(mild, ["entity", "week_num"]).where("w >= prob").count() == 0
    again = runs.stages(spark, SMALL, trees=4, depth=4, forecasts=(("climatology", None), ("anomaly", -1.0), ("ensemble", runs.INIT)))
    assert made(driver.run(spark, str(tmp_path), again)[1]) == ["model", "scores", "forecast_anomaly"]
    with pytest.raises(ValueError, match="no mode"):
        runs.seasonal_forecast(spark, SMALL, frames["weekly"], "guess")
