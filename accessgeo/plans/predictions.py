"""Scores of the pixels by tiles with a halo, with the SQL beside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.operators import tiles
from accessgeo.plans.oracles import PIXELS, _q
from accessgeo.sources import adapters

TILE, OVERLAP = 16, 6


def slope_of_means(patch: np.ndarray) -> np.ndarray:
    """A score from 0 to 1 by the mean water around a cell less a hundredth of its height; looks one cell far."""
    water = np.pad(patch[0], 1, mode="reflect")
    rows, cols = patch.shape[1:]
    mean = sum(water[a : a + rows, b : b + cols] for a in range(3) for b in range(3)) / 9
    return 1 / (1 + np.exp(-(mean * 4 - 2 - patch[1] / 100)))


def tiled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.scored_by_tiles(adapters.pixels(spark, sf_dir), ["p_post", "hand"], slope_of_means, TILE, OVERLAP, flips=True)
    return out.withColumns({c: F.round(c, 8) for c in ("value", "weight")})


WEIGHT = "(0.5 - 0.5 * cos(2 * pi() * ({v} - k * 10 + 1) / 17))"
ALONG = "{v}w AS (SELECT i AS {v}, count(*) AS n, sum(" + WEIGHT.replace("{v}", "i") + ") AS w FROM (SELECT max({v}) + 1 AS len FROM px) s, LATERAL (SELECT unnest(range(len)) AS i), LATERAL (SELECT unnest(range(ceil(greatest(len - 16, 0) / 10)::INT + 1)) AS k) WHERE i - k * 10 BETWEEN 0 AND 15 GROUP BY 1)"
SQL = {
    "tiled_scores": _q(PIXELS + "," + ALONG.format(v="row") + "," + ALONG.format(v="col") + """,
sz AS (SELECT max(row) AS h, max(col) AS w FROM px),
nb AS (SELECT p.row, p.col, abs(p.row + a) AS r, abs(p.col + b) AS c, h, w FROM px p, range(-1, 2) x(a), range(-1, 2) y(b), sz),
mi AS (SELECT row, col, CASE WHEN r > h THEN 2 * h - r ELSE r END AS r, CASE WHEN c > w THEN 2 * w - c ELSE c END AS c FROM nb),
me AS (SELECT mi.row, mi.col, sum(CASE WHEN q.valid THEN q.p_post ELSE 0 END) / 9 AS mean FROM mi LEFT JOIN px q ON q.row = r AND q.col = c GROUP BY 1, 2)""",
        "SELECT p.row, p.col, CASE WHEN valid THEN round(1 / (1 + exp(-(mean * 4 - 2 - hand / 100))), 8) END AS value, round(roww.w * colw.w, 8) AS weight, roww.n * colw.n AS tiles FROM px p JOIN me USING (row, col) JOIN roww USING (row) JOIN colw USING (col)"),
}
QUERIES = {"tiled_scores": tiled_scores}
