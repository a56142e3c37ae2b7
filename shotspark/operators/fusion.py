"""Fusing the boxes of two detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotspark.functions.boxes import clamp01, clip_boxes, iou
from shotspark.session import durable

GROUP = ("video_id", "frame", "class_name")
#: Boxes of one class in one frame that a single fold may hold.  Spark cuts row_number()
#: filters down before the exchange up to 1000 (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def union_detectors(primary: DataFrame, aux: DataFrame) -> DataFrame:
    """G1: both detectors' boxes, the primary's first in every tie."""
    return primary.withColumn("detector", F.lit(0)).unionByName(aux.withColumn("detector", F.lit(1)))


def _rank() -> Column:
    """Sort value: confidence descending, then detector, then the detector's own order."""
    return F.struct((-F.col("conf")).alias("neg_conf"), F.col("detector"), F.col("det_idx"))


def _fold(dets: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """Greedy suppression of one bounded group as a fold over its ranked boxes.

    One row per group: ``boxes`` that stay, how many there were, and the rank of the last.
    """
    # Boxes start with their rank and hold nothing twice: sorting and writing them is most of the work.
    rest = [c for c in dets.columns if c not in (*keys, "conf", "detector", "det_idx")]
    box = F.struct((-F.col("conf")).alias("neg_conf"), "detector", "det_idx", *rest)
    ranked = dets.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kind = ranked.schema["boxes"].dataType
    kept = F.aggregate(
        "boxes",
        F.array().cast(kind),
        lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) >= threshold), acc).otherwise(
            F.concat(acc, F.array(b))
        ),
    )
    # A lone box needs no comparison, and most groups are lone boxes.
    kept = F.when(F.size("boxes") == 1, F.col("boxes")).otherwise(kept)
    worst = F.element_at("boxes", -1)
    last = F.struct(*[worst[c].alias(c) for c in ("neg_conf", "detector", "det_idx")])
    return ranked.select(*keys, kept.alias("boxes"), F.size("boxes").alias("n"), last.alias("last"))


def class_nms(
    dets: DataFrame, threshold: float = 0.55, *, keys: Sequence[str] = GROUP, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Keep a box unless a kept, higher-ranked box of its class overlaps it enough.

    Goes in rounds: of every group the best ``group_limit`` undecided boxes are final among
    themselves, then everything they suppress is dropped, until nothing is left.  One frame
    rarely holds more than a few hundred boxes of a class, so one round is the rule.  No pairs
    are formed and no group is ever held whole.
    """
    keys = list(keys)
    rest, result = dets, None
    best_first = Window.partitionBy(*keys).orderBy("neg_conf", "detector", "det_idx")
    while True:
        # row_number() <= limit is cut down in every task before the exchange.
        top = (
            rest.withColumn("neg_conf", -F.col("conf"))
            .withColumn("__rn", F.row_number().over(best_first))
            .where(F.col("__rn") <= group_limit)
            .drop("__rn", "neg_conf")
        )
        groups = durable(_fold(top, threshold, keys))
        kept = groups.select(*keys, F.explode("boxes").alias("b")).select(*keys, "b.*").withColumn("conf", -F.col("neg_conf"))
        kept = kept.select(*dets.columns)
        result = kept if result is None else result.unionByName(kept)
        # Only groups that filled their share may have more.
        full = groups.where(F.col("n") >= group_limit)
        if full.isEmpty():
            break
        corners = F.transform("boxes", lambda b: F.struct(*[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")]))
        me = F.struct("x1", "y1", "x2", "y2")
        rest = durable(
            rest.join(full.select(*keys, F.col("last").alias("__last"), corners.alias("__kept")), keys)
            .where(_rank() > F.col("__last"))
            .where(~F.exists("__kept", lambda k: iou(k, me) >= threshold))
            .select(*dets.columns)
        )
    return result.select(*dets.columns)


def emit_tracks(raw: DataFrame, width: Column, height: Column, emit: float = 0.5) -> DataFrame:
    """Tracked boxes that may be published: confident, of a known class, not empty."""
    seen = raw.where((F.col("conf") >= emit) & F.col("class_name").isNotNull())
    return clip_boxes(seen, width, height).withColumn("confidence", clamp01(F.col("conf"))).drop("conf")
