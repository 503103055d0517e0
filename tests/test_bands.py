"""Distances over bands of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoarfrost.operators import grid


@pytest.mark.parametrize("cells, offsets, share", [(1, 256, 0.05), (40, 256, 0.02), (40, 2, 0.02), (100, 256, 0.0), (100, 256, 0.5)])
def test_bands_give_the_nearest_targets(spark, monkeypatch, cells, offsets, share):
    """Against all pairs; bands of one row and of several; no window runs along a whole column of cells."""
    monkeypatch.setattr(grid, "BAND_CELLS", cells)
    monkeypatch.setattr(grid, "OFFSETS", offsets)
    monkeypatch.setattr(grid, "_down", None)
    rng = np.random.default_rng(cells)
    z = np.where(rng.random((23, 9)) < share, rng.random((23, 9)).round(3), np.nan)
    rows = [(r + 2, c - 3, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(23) for c in range(9) if not (r == 5 and c in (0, 4))]
    df = spark.createDataFrame(rows, "row int, col int, z double").repartition(3)
    known = [(c, r, v) for r, c, v in rows if v is not None]
    got = {(x.row, x.col): x for x in grid.distances(df, F.col("z").isNotNull(), 10.0, "z").collect()}
    fill = {(x.row, x.col): x.z_filled for x in grid.filled(df, within=3.0).collect()}
    assert len(got) == len(rows)
    for r, c, v in rows:
        x = got[r, c]
        if not known:
            assert x.near_row is None and x.near_value is None and abs(x.distance - 10 * np.hypot(23, 9)) < 1e-9 and fill[r, c] is None
            continue
        d, nc, nr, nv = min(((c - kc) ** 2 + (r - kr) ** 2, kc, kr, kv) for kc, kr, kv in known)
        assert (x.near_row, x.near_col, x.near_value) == (nr, nc, nv) and abs(x.distance - 10 * d**0.5) < 1e-9
        assert fill[r, c] == (nv if d <= 9 else None)


@pytest.mark.parametrize("within", [0.0, 1.0, 2.5, 3.0])
def test_gaps_are_filled_within_tiles_with_margins(spark, monkeypatch, within):
    """Against plain loops, with tiles of less than the grid, negative places and a column besides."""
    monkeypatch.setattr(grid, "FILL_ROWS", 4)
    monkeypatch.setattr(grid, "FILL_COLS", 5)
    r = np.random.default_rng(3)
    cells = {(i, j): float(i * 100 + j) if r.random() < 0.12 else None for i in range(-6, 13) for j in range(-3, 14) if r.random() < 0.9}
    df = spark.createDataFrame([(i, j, v, f"{i}:{j}") for (i, j), v in cells.items()], "row int, col int, z double, name string").repartition(3)
    got = {(x.row, x.col): (x.z, x.name, x.z_filled) for x in grid.filled(df, within=within).collect()}
    known = [p for p, v in cells.items() if v is not None]
    for (i, j), v in cells.items():
        d, c, q = min(((i - a) ** 2 + (j - b) ** 2, b, a) for a, b in known)
        assert got.pop((i, j)) == (v, f"{i}:{j}", cells[q, c] if d <= within * within else v)
    assert not got
