"""Tree models on feature tables: fitting, grouped validation, importance, partial dependence."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trees
from .quantiles import quantiles
from .sampling import group_folds
from .storage import written


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that df has, in their order."""
    return [c for c in wanted if c in df.columns]


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose cols are all finite."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return df.where(keep)


def forest(features: list[str], target: str, **more) -> trees.Forest:
    """A random forest: 200 trees of depth 25 unless told otherwise."""
    return trees.Forest(tuple(features), target, **more)


def boosted(features: list[str], target: str, **more) -> trees.Boosting:
    """Gradient-boosted trees: 500 rounds of depth 6 at rate 0.05 unless told otherwise."""
    return trees.Boosting(tuple(features), target, **more)


def fit(df: DataFrame, what: trees.Forest | trees.Boosting) -> trees.TreeModel:
    """Fit on the complete rows of df."""
    return trees.fit(complete(df, [*what.features, what.target]), what)


def metrics(df: DataFrame, y: str, p: str, *keys: str) -> DataFrame:
    """r2, rmse, mae, bias and n (by keys), in one aggregate: sums of y, y squared and errors."""
    e = F.col(p) - F.col(y)
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_se"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.var_pop(y).alias("_v"))
    total = F.col("_v") * F.col("n")
    return sums.select(*keys, "n", (1 - F.try_divide(F.col("_se"), total)).alias("r2"), F.sqrt(F.col("_se") / F.col("n")).alias("rmse"), "mae", "bias")


def cross_validated(df: DataFrame, what, group: str, target: str, folds: int = 5) -> DataFrame:
    """Metrics of each fold of whole groups. The models are few and fitted two at a time, so that one's small stages run beside the other's large ones; their test rows are told apart by the fold."""
    dealt = written(group_folds(df, group, folds), "folds")

    def tested(k: int) -> DataFrame:
        model = fit(dealt.where(F.col("fold") != k), what())
        return model.transform(dealt.where(F.col("fold") == k)).select("fold", target, "predicted")

    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(copy_context().run, inheritable_thread_target(df.sparkSession)(tested), k) for k in range(folds)]
        out = reduce(DataFrame.unionByName, [job.result() for job in jobs])
    return metrics(out, target, "predicted", "fold")


def importances(spark, model: trees.TreeModel) -> DataFrame:
    """feature, importance and rank of a tree model."""
    df = spark.createDataFrame(list(model.importances().items()), "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # one row a feature


def permuted(df: DataFrame, model: trees.TreeModel, features: list[str], target: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Rise of the mean squared error when a feature's values are dealt anew, for every feature and repeat.

    df should be rows that the model hasn't learnt from. In a repeat every row
    gets the values of the one before it in an order of hashed draws over the
    whole table (the first those of the last). Only bins, targets and draws are
    kept and moved, once a repeat; tasks go through their range of the order
    and score all features at once.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    rows = written(numbered.select("_id", model.key().alias("_key"), F.col(target).cast("double").alias("_goal")), "rows")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = lambda r: rows.select("_key", "_goal", F.xxhash64("_id", F.lit(seed + r)).alias("_draw")).repartitionByRange(parts, "_draw").sortWithinPartitions("_draw").drop("_draw")
    errors = written(trees.errors_of(model, rows.drop("_id"), [order(r) for r in range(repeats)], features), "errors")  # a row a feature and repeat
    plain = errors.where("_feature is null").first()
    return errors.where("_feature is not null").select(F.col("_feature").alias("feature"), F.col("_repeat").alias("repeat"), (F.col("_mse") - F.lit(plain["_mse"] if plain else None)).alias("rise"))


def partial_dependence(df: DataFrame, model: trees.TreeModel, grids: dict[str, list[float]]) -> DataFrame:
    """Mean prediction over all rows of df with the given features set to every combination of their grids (one or two features).

    Rows whose other features are in the same bins are predicted once, for all of them.
    """
    left = [f for f in model.features if f not in grids]
    keyed = df.select(*left, (model.key(*left) if left else F.lit(0)).alias("_key"))
    alike = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *[F.min(f).alias(f) for f in left])
    out = written(alike.repartition(4 * df.sparkSession.sparkContext.defaultParallelism), "alike").select("_n", *left)
    for f, g in grids.items():
        out = out.withColumn(f, F.explode(F.array(*[F.lit(float(x)) for x in g])))
    return model.transform(out).groupBy(*grids).agg((F.sum(F.col("predicted") * F.col("_n")) / F.sum("_n")).alias("mean_predicted"))


def grid_of(df: DataFrame, feature: str, points: int) -> list[float]:
    """points values from the least to the largest of a feature, evenly spaced."""
    low, high = df.agg(F.min(feature), F.max(feature)).first()
    return [low + (high - low) * k / (points - 1) for k in range(points)]


def binned_means(df: DataFrame, x: str, y: str, bins: int = 40, least: int = 20) -> DataFrame:
    """Mean of y in bins of equal width between the 1st and 99th percentile of x; bins with fewer than least rows go."""
    ends = quantiles(df, x, [0.01, 0.99]).select(F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    rows = df.crossJoin(F.broadcast(ends)).where(F.col(x).between(F.col("_lo"), F.col("_hi")))  # one row
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    at: Column = F.least(F.floor((F.col(x) - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    out = rows.withColumn("bin", at).withColumn("_c", F.col("_lo") + (at + 0.5) * width)
    return out.groupBy("bin").agg(F.first("_c").alias("center"), F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
