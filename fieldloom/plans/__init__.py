"""Whole analyses put together from operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import latitude, longitude
from ..operators.aggregates import screening_summary
from ..operators.linear import correlations, logistic_probe, probabilities
from ..operators.metrics import average_precision, event_metrics, pr_curve, roc_auc
from ..operators.windows import ranked


def screen(df: DataFrame, step: list[str], components: dict, features: dict, min_rows: int = 10, apart: dict | None = None) -> DataFrame:
    """Correlation of every component with every feature in each step: ``step, component, feature, r, abs_r, rank``.

    Both are given as columns by name. Rows in which any of them isn't finite are
    left out. One Gram matrix a step gives all pairs, but that of a component with
    the feature that ``apart`` names for it; fewer such rows than ``min_rows`` give
    none, a constant side a null r, which ranks last.
    """
    apart = apart or {}
    every = F.array(*[c.cast("double") for c in (*components.values(), *features.values())])
    long = correlations(df.select(*step, every.alias("_x")), step, "_x", list(components), list(features), min_rows).withColumn("abs_r", F.abs("r"))
    if apart:
        long = long.filter(~F.concat_ws("\0", "component", "feature").isin([f"{a}\0{b}" for a, b in apart.items()]))
    return ranked(long, [*step, "component"], "abs_r", "feature")


def winners(screened: DataFrame, k: int = 5) -> DataFrame:
    """Per component the best features over all steps: mean size of r, steps, wins, place."""
    s = screening_summary(screened, ["component", "feature"])
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("mean_abs_r"), F.desc("wins"), "feature")))
    return s.filter(F.col("place") <= k)


def probe_report(train: DataFrame, test: DataFrame, vector: str, truth: str, event: str, thresholds: list[float]) -> dict[str, DataFrame] | None:
    """Fit a probe and score it: curve, average precision, area under ROC, event metrics."""
    probe = logistic_probe(train, vector, truth)
    if probe is None:
        return None
    scored = probabilities(test, vector, probe)
    curve = pr_curve(scored, "p", truth)
    return {"scored": scored, "curve": curve, "average_precision": average_precision(curve), "roc_auc": roc_auc(scored, "p", truth), "events": event_metrics(scored, event, "p", truth, thresholds)}


def icosphere(level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, faces and each vertex's first level: an icosahedron, edges halved ``level`` times onto the unit sphere."""
    g = (1 + math.sqrt(5)) / 2
    v = [(a * s, b * t, 0.0) for a, b in ((1.0, g),) for s in (-1, 1) for t in (-1, 1)]
    points = [np.roll(p, k) for k in range(3) for p in v]
    points = [p / np.linalg.norm(p) for p in points]
    d = np.array([[np.linalg.norm(p - q) for q in points] for p in points])
    edge = d[d > 0].min() * 1.01
    faces = [(i, j, k) for i in range(12) for j in range(i) for k in range(j) if max(d[i, j], d[j, k], d[i, k]) < edge]
    first = [0] * 12
    for step in range(1, level + 1):
        middle: dict[tuple[int, int], int] = {}

        def halfway(a: int, b: int) -> int:
            key = (min(a, b), max(a, b))
            if key not in middle:
                p = points[a] + points[b]
                middle[key] = len(points)
                points.append(p / np.linalg.norm(p))
                first.append(step)
            return middle[key]

        faces = [f for a, b, c in faces for ab, bc, ca in [(halfway(a, b), halfway(b, c), halfway(c, a))] for f in ((a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca))]
    return np.array(points), np.array(faces), np.array(first)


def mesh_nodes(spark: SparkSession, level: int) -> DataFrame:
    """``node, x, y, z, first_level, lat, lon``; a level's nodes are those with a first level up to it."""
    points, _, first = icosphere(level)
    rows = [(i, *map(float, p), int(f)) for i, (p, f) in enumerate(zip(points, first))]
    df = spark.createDataFrame(rows, "node int, x double, y double, z double, first_level int")
    return df.withColumn("lat", latitude(F.col("z"))).withColumn("lon", longitude(F.col("x"), F.col("y"), True))


def longest_edge(level: int) -> float:
    """Chord length of the longest edge of a mesh level."""
    points, faces, _ = icosphere(level)
    return float(max(np.linalg.norm(points[faces[:, i]] - points[faces[:, j]], axis=1).max() for i, j in ((0, 1), (1, 2), (2, 0))))


def mesh_edges(spark: SparkSession, level: int) -> DataFrame:
    _, faces, _ = icosphere(level)
    f = spark.createDataFrame([tuple(map(int, x)) for x in faces], "a int, b int, c int")
    e = f.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")), F.struct(F.col("c").alias("a"), F.col("a").alias("b")))).alias("e"))
    return e.select(F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst")).distinct()
