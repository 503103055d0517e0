"""Training tables of pixels and scenes: qualification, sampling, joins and distances in one dataflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import sample_per_group


def fraction_removed(recorded: Column, removed: Column, left: Column) -> Column:
    """The recorded fraction; else removed over removed and left; else null."""
    return F.coalesce(recorded, F.try_divide(removed.cast("double"), (removed + left).cast("double")))


def qualified(scenes: DataFrame, kind: str, valid: str, total: str, share: float = 0.1, kinds: tuple = ("predawn", "evening")) -> DataFrame:
    """Scenes of the wanted kinds with valid over share of total, strictly."""
    return scenes.where(F.col(kind).isin(*kinds) & (F.col(valid) > share * F.col(total)))


def assembled(cells: DataFrame, scenes: DataFrame, climate: DataFrame, covariates: DataFrame, rows: int, scene: str = "scene", pixel: str = "pixel", day: str = "d") -> DataFrame:
    """Cells of qualified scenes with the climate of their day and the covariates of their pixel.

    A day without climate drops its scenes, a pixel without all covariates
    drops out; then each scene gives its share of about rows rows, at least one.
    """
    full = covariates.dropna(how="any")
    joined = cells.join(scenes, scene).join(climate, day).join(full, pixel)
    estimate = joined.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return sample_per_group(joined, scene, min(1.0, rows / max(1, estimate)), scene, pixel, day)
