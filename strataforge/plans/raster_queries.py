"""Queries for raster steps on images of several rows: one image for each order, a row of pixels for each line.

Images of equal height are worked on together, as one stack. Sums weigh each value by its place, so that a value in the
wrong place shows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import raster
from strataforge.plans.binary_queries import orders_lines

WIDTH = 7


def _stacks(spark: SparkSession, sf_dir: str, work, names: list[str]) -> DataFrame:
    """l_orderkey and work(parts, suppliers): whole numbers, a column for each name; both are stacks (image, row, 1)."""
    number = lambda c: F.transform("lines", lambda x: x[c].cast("long")).alias(c)
    rows = orders_lines(spark, sf_dir).select("l_orderkey", number("l_partkey"), number("l_suppkey"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["l_partkey"].str.len()):
                made = work(*(np.stack(same[c].to_list())[..., None] for c in ("l_partkey", "l_suppkey")))
                yield pd.DataFrame({"l_orderkey": same["l_orderkey"].to_numpy()} | dict(zip(names, made, strict=True)))

    return rows.mapInPandas(run, ", ".join(f"{n} long" for n in ["l_orderkey", *names]))


def _images(parts: np.ndarray, suppliers: np.ndarray) -> np.ndarray:
    """Stacks of RGBA: red and green from the numbers, every third pixel visible."""
    x = np.arange(WIDTH)
    alpha = np.where((parts + x) % 3 == 0, (suppliers + 40 * x) % 256, 0)
    return np.stack([(parts + 17 * x) % 256, suppliers * (x + 1) % 256, np.zeros_like(alpha), alpha], axis=-1).astype(np.uint8)


def _weighed(values: np.ndarray) -> np.ndarray:
    """For each image of a stack the sum of value times place, places counted from 1 line by line."""
    flat = values.reshape(len(values), -1).astype(np.int64)
    return flat @ np.arange(1, flat.shape[1] + 1)


def image_bounds(spark, sf_dir):
    """Visible bounds of an image, -1 if nothing is visible, its preview score, and the red inside the bounds."""

    def work(parts: np.ndarray, suppliers: np.ndarray) -> list[np.ndarray]:
        image = _images(parts, suppliers)
        box = raster.boxes(image[..., 3])
        y, x = np.arange(image.shape[1])[:, None], np.arange(WIDTH)
        left, top, right, bottom = (side[:, None, None] for side in box.T)
        inside = (x >= left) & (x < right) & (y >= top) & (y < bottom)
        seen = (image[..., 3] > 0).sum(axis=(1, 2))
        area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        return [*box.T, area + seen, (image[..., 0] * inside).sum(axis=(1, 2), dtype=np.int64)]

    return _stacks(spark, sf_dir, work, ["left_at", "top_at", "right_at", "bottom_at", "score", "red"])


def image_over(spark, sf_dir):
    """An image over another, two columns to the right and a line down."""

    def work(parts: np.ndarray, suppliers: np.ndarray) -> list[np.ndarray]:
        canvas = _images(parts, suppliers)
        raster.composite(canvas, _images(suppliers, parts), 2, 1)
        return [_weighed(canvas[..., c]) for c in (0, 1, 3)]

    return _stacks(spark, sf_dir, work, ["red", "green", "alpha"])


def image_reduce(spark, sf_dir):
    """An image shrunk to three columns and half its lines, rounded up: boxes that overlap, colours weighted by alpha."""

    def work(parts: np.ndarray, suppliers: np.ndarray) -> list[np.ndarray]:
        small = raster.resize(_images(parts, suppliers), 3, -(-parts.shape[1] // 2))
        return [_weighed(small[..., c]) for c in (0, 1, 3)]

    return _stacks(spark, sf_dir, work, ["red", "green", "alpha"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (image_bounds, image_over, image_reduce)}


_PIXELS = f"""l AS (SELECT l_orderkey AS k, CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS y, count(*) OVER (PARTITION BY l_orderkey) AS h FROM lineitem),
px AS (SELECT k, y, x, h, (p + 17 * x) % 256 AS r, s * (x + 1) % 256 AS g, CASE WHEN (p + x) % 3 = 0 THEN (s + 40 * x) % 256 ELSE 0 END AS a,
    (s + 17 * x) % 256 AS r2, p * (x + 1) % 256 AS g2, CASE WHEN (s + x) % 3 = 0 THEN (p + 40 * x) % 256 ELSE 0 END AS a2 FROM l, range({WIDTH}) AS c(x))"""


def oracle_sql() -> dict[str, str]:
    sums = "CAST(sum(r * place) AS BIGINT) AS red, CAST(sum(g * place) AS BIGINT) AS green, CAST(sum(a * place) AS BIGINT) AS alpha"
    return {
        "image_bounds": f"""WITH {_PIXELS}, b AS (SELECT k, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS seen FROM px WHERE a > 0 GROUP BY 1),
            i AS (SELECT px.k, min(x0) AS x0, min(y0) AS y0, min(x1) AS x1, min(y1) AS y1, min(seen) AS seen, sum(CASE WHEN x >= x0 AND x < x1 AND y >= y0 AND y < y1 THEN r ELSE 0 END) AS red FROM px LEFT JOIN b ON px.k = b.k GROUP BY 1)
            SELECT k AS l_orderkey, coalesce(x0, -1) AS left_at, coalesce(y0, -1) AS top_at, coalesce(x1, -1) AS right_at, coalesce(y1, -1) AS bottom_at, CAST(coalesce((x1 - x0) * (y1 - y0) + seen, 0) AS BIGINT) AS score, CAST(red AS BIGINT) AS red FROM i""",
        "image_over": f"""WITH {_PIXELS}, o AS (SELECT d.k, {WIDTH} * d.y + d.x + 1 AS place, d.r, d.g, d.a, coalesce(u.r2, 0) AS r2, coalesce(u.g2, 0) AS g2, coalesce(u.a2, 0) AS a2, u.k IS NOT NULL AS met, d.a * (255 - coalesce(u.a2, 0)) // 255 AS rest
                FROM px AS d LEFT JOIN px AS u ON u.k = d.k AND u.y = d.y - 1 AND u.x = d.x - 2),
            f AS (SELECT k, place, CASE WHEN met THEN (r2 * a2 + r * rest) // greatest(a2 + rest, 1) ELSE r END AS r, CASE WHEN met THEN (g2 * a2 + g * rest) // greatest(a2 + rest, 1) ELSE g END AS g, CASE WHEN met THEN a2 + rest ELSE a END AS a FROM o)
            SELECT k AS l_orderkey, {sums} FROM f GROUP BY 1""",
        "image_reduce": f"""WITH {_PIXELS}, t AS (SELECT *, (h + 1) // 2 AS n FROM px),
            e AS (SELECT k, i, j, sum(r * a) AS ra, sum(g * a) AS ga, sum(a) AS a, count(*) AS area FROM t JOIN (SELECT k, y AS j FROM l) USING (k), range(3) AS c(i)
                WHERE j < n AND x >= i * {WIDTH} // 3 AND x < ((i + 1) * {WIDTH} + 2) // 3 AND y >= j * h // n AND y < ((j + 1) * h + n - 1) // n GROUP BY 1, 2, 3),
            f AS (SELECT k, 3 * j + i + 1 AS place, ra // greatest(a, 1) AS r, ga // greatest(a, 1) AS g, a // area AS a FROM e)
            SELECT k AS l_orderkey, {sums} FROM f GROUP BY 1""",
    }
