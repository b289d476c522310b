"""Boxes and candidates in frames: suppression, grouping, best candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwell.functions import kernels


def suppress(df: DataFrame, keys: list[str], overlap: float = 0.3) -> DataFrame:
    """Rows (x1, y1, x2, y2, score, pos) of each key that greedy suppression keeps; a key is one image's boxes."""
    box = F.struct(F.col("pos"), F.col("score").cast("double").alias("score"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(box)).alias("boxes"))

    @F.pandas_udf("array<long>")
    def keep(boxes: pd.Series) -> pd.Series:
        return boxes.map(lambda bs: [bs[i]["pos"] for i in kernels.nms([(b["x1"], b["y1"], b["x2"], b["y2"]) for b in bs], [b["score"] for b in bs], overlap)])

    return g.select(*keys, F.explode(keep("boxes")).alias("pos"))


def best_candidate(iou: Column, score: Column, take: Column) -> Column:
    """take of the candidate with the best (iou in steps of 0.03, score)."""
    return F.max_by(take, F.struct(F.bround(iou / 0.03, 0), score))


def group_rows(df: DataFrame, keys: list[str], value: str, fold, *args) -> DataFrame:
    """df's (keys, pos) with a group number from a fold over the key's values in order."""
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(value, "pos"))).alias("vs"))

    @F.pandas_udf("array<int>")
    def number(vs: pd.Series) -> pd.Series:
        return vs.map(lambda x: fold([float(v[value]) for v in x], *args))

    z = g.withColumn("g", number("vs")).select(*keys, F.explode(F.arrays_zip("vs", "g")).alias("z"))
    return z.select(*keys, F.col("z.vs.pos").alias("pos"), F.col("z.g").alias("group_no"))
