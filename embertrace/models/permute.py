"""Random pairing of rows, and their distinct values, for permutation importance."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.operators.tables import number_rows


def paired_rows(rows: DataFrame, keys: list[str], features: list[str], repeats: int, seed: int) -> DataFrame:
    """(repeat, own, other): per repeat every row meets one other row, and is met by one.

    Rows are numbered in a hashed order; a repeat pairs row r with row r + shift (mod n). Over a
    random order that is a random permutation, and it costs one join for all features together.
    """
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    data = rows.select(*keys, vector.alias("own"))
    numbered = number_rows(data, [F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]], "r").select("r", "own")
    n = numbered.count()
    rng = random.Random(seed)
    shifts = F.array(*[F.lit(rng.randrange(1, max(n, 2))).cast("bigint") for _ in range(repeats)])
    asked = numbered.select("own", "r", F.posexplode(shifts).alias("repeat", "shift"))
    asked = asked.withColumn("partner", (F.col("r") + F.col("shift")) % F.lit(max(n, 1)))
    others = numbered.select(F.col("r").alias("partner"), F.col("own").alias("other"))
    return asked.join(others, "partner").select("repeat", "own", "other")


def distinct(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each row the place of its like among them."""
    points = np.ascontiguousarray(points, dtype=float) + 0.0  # no negative zeros
    if not len(points):
        return points, np.zeros(0, dtype=np.int64)
    as_bytes = points.view(np.dtype((np.void, points.itemsize * points.shape[1]))).ravel()
    _, first, back = np.unique(as_bytes, return_index=True, return_inverse=True)
    return points[first], back.ravel()
