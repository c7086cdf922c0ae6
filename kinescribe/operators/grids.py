"""Pixel grids per session. Grids are sparse tables (session_id, x, y, v); absent cells are 0.

A grid has at most width x height cells per session however many frames fall into it, so windows over a
row, a column or one session's grid are bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kinescribe.functions import landmarks as lm
from kinescribe.operators.traces import KEYS, distance
from kinescribe.plans.chunks import in_chunks, ordered

BLOCK_RADIUS = 5
BLUR_SIZE = 51


def box_density(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Sum of the weights ``w`` of all boxes [x0, x1) x [y0, y1) covering each cell.

    Each box contributes its four signed corners; two running sums, down the columns that have corners and
    then along the rows, recover the sums. The work grows with boxes and covered cells, not with box areas.
    A count of the covering boxes is carried along; being whole numbers, it tells exactly which cells are covered.
    """
    one = F.lit(1).cast("bigint")
    corner = lambda x, y, sign: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (w * sign).alias("w"), (one * sign).alias("c"))
    w = F.col("w").cast("double")
    corners = boxes.select(
        "session_id",
        F.explode(F.array(corner("x0", "y0", 1), corner("x1", "y0", -1), corner("x0", "y1", -1), corner("x1", "y1", 1))).alias("c"),
    )
    change = corners.where((F.col("c.x") < width) & (F.col("c.y") < height)).groupBy("session_id", "c.x", "c.y").agg(
        F.sum("c.w").alias("w"), F.sum("c.c").alias("c")
    )
    down = Window.partitionBy("session_id", "x").orderBy("y")
    columns = change.select(
        "session_id", "x", "y", F.sum("w").over(down).alias("w"), F.sum("c").over(down).alias("c"), F.coalesce(F.lead("y").over(down), F.lit(height)).alias("stop")
    ).where((F.col("c") != 0) | (F.col("w") != 0))
    filled = columns.select("session_id", "x", F.explode(F.sequence("y", F.col("stop") - 1)).alias("y"), "w", "c")
    along = Window.partitionBy("session_id", "y").orderBy("x")
    spans = filled.select(
        "session_id", "x", "y", F.sum("w").over(along).alias("v"), F.sum("c").over(along).alias("c"), F.coalesce(F.lead("x").over(along), F.lit(width)).alias("stop")
    ).where(F.col("c") > 0)
    return spans.select("session_id", F.explode(F.sequence("x", F.col("stop") - 1)).alias("x"), "y", "v")


def occupancy(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Number of hand (or body) boxes covering each pixel."""
    return box_density(boxes.withColumn("w", F.lit(1.0)), width, height)


def speed_blocks(trace: DataFrame, width: int, height: int, radius: int = BLOCK_RADIUS) -> DataFrame:
    """A block around each point that follows a seen point, weighted by the distance between the two."""
    def compute(df: DataFrame, by: list[str]) -> DataFrame:
        over = ordered(by, "frame_idx")
        return df.withColumn("w", distance(["x", "y"], [F.lag("x").over(over), F.lag("y").over(over)]))

    moved = in_chunks(trace.select(*KEYS, "frame_idx", "x", "y"), KEYS, "frame_idx", compute, 1, 0)
    x, y = F.col("x").cast("int"), F.col("y").cast("int")
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return moved.where((F.col("w") > 0) & inside).select(
        "session_id", "w",
        F.greatest(F.lit(0), x - radius).alias("x0"), F.least(F.lit(width), x + radius).alias("x1"),
        F.greatest(F.lit(0), y - radius).alias("y0"), F.least(F.lit(height), y + radius).alias("y1"),
    )


def speed_heatmap(trace: DataFrame, width: int, height: int, radius: int = BLOCK_RADIUS) -> DataFrame:
    """Distance travelled near each pixel."""
    return box_density(speed_blocks(trace, width, height, radius), width, height)


def blur_kernel(size: int = BLUR_SIZE) -> np.ndarray:
    """Normalised Gaussian whose width follows from its size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    taps = np.exp(-0.5 * ((np.arange(size) - (size - 1) / 2) / sigma) ** 2)
    return taps / taps.sum()


def gaussian_blur(grid: DataFrame, width: int, height: int, size: int = BLUR_SIZE) -> DataFrame:
    """Separable Gaussian blur with mirrored borders (the edge itself is not repeated).

    One session's grid is a bounded array, so the two passes run on it inside one task per session.
    """
    kernel, reach = blur_kernel(size), size // 2
    if reach >= min(width, height):
        raise ValueError("the kernel must be smaller than the frame")
    schema = StructType(
        [grid.schema["session_id"], StructField("x", IntegerType()), StructField("y", IntegerType()), StructField("v", DoubleType())]
    )

    def blur(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((height, width))
        values[cells["y"].to_numpy(), cells["x"].to_numpy()] = cells["v"].to_numpy()
        for axis, length in ((1, width), (0, height)):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (reach, reach)
            wide = np.pad(values, pad, mode="reflect")
            values = sum(k * np.take(wide, range(i, i + length), axis=axis) for i, k in enumerate(kernel))
        y, x = np.nonzero(values > 0)
        return pd.DataFrame({"session_id": key[0], "x": x.astype("int32"), "y": y.astype("int32"), "v": values[y, x]})

    return grid.groupBy("session_id").applyInPandas(blur, schema)


def relative(grid: DataFrame) -> DataFrame:
    """Adds ``share``: the cell's value over its session's maximum."""
    return grid.withColumn("share", F.col("v") / F.max("v").over(Window.partitionBy("session_id")))


def heat_threshold(grid: DataFrame, t: float) -> DataFrame:
    """Cells whose share of the maximum exceeds ``t`` (not negative)."""
    return relative(grid).where(F.col("share") > t)


def _samples(length: int, bins: int) -> list[int]:
    return [int(v) for v in np.linspace(0, length - 1, bins)]


def voxel_density(grid: DataFrame, width: int, height: int, bins: int = 50, levels: int = 20, least: float = 0.02) -> DataFrame:
    """Columns of voxels over a coarse sample of the grid, as high as the sampled share of the maximum."""
    def positions(axis: str, length: int) -> Column:
        spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(_samples(length, bins))])
        return F.explode(F.transform(F.filter(spots, lambda s: s["p"] == F.col(axis)), lambda s: s["i"]))

    hot = relative(grid).where(
        (F.col("share") > least) & F.col("x").isin(_samples(width, bins)) & F.col("y").isin(_samples(height, bins))
    )
    sampled = hot.withColumn("bin_x", positions("x", width)).withColumn("bin_y", positions("y", height))
    top = (F.col("share") * (levels - 1)).cast("int")
    return sampled.select("session_id", "bin_x", "bin_y", F.explode(F.sequence(F.lit(0), top)).alias("level"), "share")


def spatial_density(hand_frames: DataFrame, source: str = "Whole Hand", bins: int = 20) -> DataFrame:
    """2-D histogram of the normalised hand point over all sessions, y pointing up."""
    points = hand_frames.select(lm.normalized_point("landmarks", source).alias("p")).where(F.col("p").isNotNull())
    cell = lambda v: F.floor(v * bins).cast("int")
    return points.groupBy(cell(F.col("p.x")).alias("bin_x"), cell(1.0 - F.col("p.y")).alias("bin_y")).count()
