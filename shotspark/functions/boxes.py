"""Box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """B26."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))


def clip_boxes(dets: DataFrame, width: Column, height: Column) -> DataFrame:
    """Corners clipped to the frame, as ``x, y, width, height``; empty boxes dropped."""
    w, h = width.cast("double"), height.cast("double")
    x1 = F.least(F.greatest(F.col("x1"), F.lit(0.0)), w)
    y1 = F.least(F.greatest(F.col("y1"), F.lit(0.0)), h)
    x2 = F.least(F.greatest(F.col("x2"), x1), w)
    y2 = F.least(F.greatest(F.col("y2"), y1), h)
    rest = [c for c in dets.columns if c not in ("x1", "y1", "x2", "y2")]
    return dets.select(
        *rest, x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height")
    ).where("width > 0 and height > 0")


def xyxy_to_cxcywh(dets: DataFrame) -> DataFrame:
    """Centre form."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rest = [c for c in dets.columns if c not in ("x1", "y1", "x2", "y2")]
    return dets.select(
        *rest,
        (F.col("x1") + w / 2).alias("cx"), (F.col("y1") + h / 2).alias("cy"), w.alias("w"), h.alias("h"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two ``STRUCT<x1, y1, x2, y2>``."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(
        zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    )

    def area(box: Column) -> Column:
        return F.greatest(zero, box["x2"] - box["x1"]) * F.greatest(zero, box["y2"] - box["y1"])

    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(zero)
