"""Row transforms and filters on point sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def affine(points: DataFrame, m: tuple[float, float, float, float, float, float], scale: float) -> DataFrame:
    """(x, y) -> (m0 x + m1 y + m2, m3 x + m4 y + m5), scale times a factor; the angle stays."""
    x, y = F.col("x"), F.col("y")
    return points.withColumns({"x": m[0] * x + m[1] * y + m[2], "y": m[3] * x + m[4] * y + m[5], "scale": F.col("scale") * scale})


def strongest(points: DataFrame, n: int) -> DataFrame:
    """The n points of each image with the largest cornerness, ties by point."""
    w = Window.partitionBy("image_id").orderBy(F.desc("cornerness"), "pt")
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_points(points: DataFrame, n: int) -> DataFrame:
    """The first n points of each image, by their number."""
    w = Window.partitionBy("image_id").orderBy("pt")
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def ellipse(m11: Column, m12: Column, m21: Column, m22: Column) -> dict[str, Column]:
    """Of the 2 x 2 map of a keypoint's shape: half axes (major, minor), the direction of the major one (v1, v2; v1 >= 0), and the root of the determinant."""
    p, q, r = m11 * m11 + m12 * m12, m11 * m21 + m12 * m22, m21 * m21 + m22 * m22
    root = F.sqrt((p - r) * (p - r) + 4 * q * q)
    turn = F.atan2(2 * q, p - r) / 2
    return {
        "major": F.sqrt((p + r + root) / 2), "minor": F.sqrt(F.greatest(F.lit(0.0), (p + r - root) / 2)), "v1": F.cos(turn), "v2": F.sin(turn),
        "size": F.sqrt(m11 * m22 - m12 * m21),
    }


def in_box(x0: float, x1: float, y0: float, y1: float) -> Column:
    return (F.col("x") > x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") < y1)


def sample(points: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """A share of the points by a hash of their keys: the same points on every run and partitioning. This is a sampling operator."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", *keys)), 1, 8), 16, 10).cast("long")
    return points.where(h < int(share * (1 << 32)))


def missing_ranges(ids: DataFrame, first: int, last: int) -> DataFrame:
    """(low, high) of the runs of ids between first and last that the column id lacks: from neighbours, without listing all ids."""
    have = ids.where(F.col("id").between(first, last)).select("id").distinct()
    ends = have.unionByName(ids.sparkSession.createDataFrame([(first - 1,), (last + 1,)], "id long"))
    # neighbours are found in ranges of ids; only each range's ends meet those of others
    width = 1 << 20
    blocks = ends.withColumn("_b", F.floor(F.col("id") / width))
    inside = blocks.withColumn("before", F.lag("id").over(Window.partitionBy("_b").orderBy("id")))
    edges = blocks.groupBy("_b").agg(F.max("id").alias("top"))
    edges = edges.select(F.col("_b"), F.lag("top").over(Window.orderBy("_b")).alias("_before"))  # a row for each million ids
    found = inside.join(edges, "_b").select(F.coalesce("before", "_before").alias("before"), "id")
    return found.where(F.col("id") - F.col("before") > 1).select((F.col("before") + 1).alias("low"), (F.col("id") - 1).alias("high"))
