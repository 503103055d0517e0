"""All climate queries and their SQL."""

from . import cleaning, cubes, files, forecasts, grids, joining, learning, runs, sampling, seasons, serving, series, streams, workflows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
