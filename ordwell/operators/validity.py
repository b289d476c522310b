"""Which frames are valid, and which version of the interface a match shows, from pixels.

A frame is valid under a version if a player lives, and a corner whose place the version
fixes is plain and bright: the largest deviation of its channels is below one limit, the mean
of their means above another. All is worked out by expressions over the column of bytes,
each version for the same row, so a frame is neither copied for its versions nor sent to
Python. A match has the lowest valid version of its first frame that has one; later frames
are judged by it.

Null or too short bytes are valid under no version. A match without a valid frame has no
row in `versions_of`, and no valid frames. Repeated frames each keep their row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Version:
    """A version's number, its corner in pixels (x, y, width, height), and the limits of deviation and mean."""

    number: int
    corner: tuple[int, int, int, int]
    max_std: float
    min_mean: float


def channel_sums(data: Column, width: Column, channels: int, corner: tuple[int, int, int, int]) -> Column:
    """For each channel the sum of a corner's pixels and of their squares."""
    x, y, w, h = corner
    pixel = lambda i, k: (((F.floor(i / w) + y) * width + x + i % w) * channels + k + 1).cast("int")
    value = lambda i, k: F.conv(F.hex(data.substr(pixel(i, k), F.lit(1))), 16, 10).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    add = lambda k: lambda a, i: F.struct((a["s"] + value(i, k)).alias("s"), (a["q"] + value(i, k) * value(i, k)).alias("q"))
    return F.array(*(F.aggregate(F.sequence(F.lit(0), F.lit(w * h - 1)), zero, add(k)) for k in range(channels)))


def plain_and_bright(data: Column, width: Column, channels: int, version: Version) -> Column:
    """Whether the version's corner is; false where it isn't all there."""
    n = version.corner[2] * version.corner[3]
    sums = channel_sums(data, width, channels, version.corner)
    # exact in integers up to the last division and root
    spread = F.array_max(F.transform(sums, lambda c: F.sqrt((c["q"] * n - c["s"] * c["s"]).cast("double")) / n))
    mean = F.aggregate(sums, F.lit(0).cast("long"), lambda a, c: a + c["s"]).cast("double") / (n * channels)
    inside = F.lit(version.corner[0] + version.corner[2]) <= width
    return F.coalesce(inside & (spread < version.max_std) & (mean > version.min_mean), F.lit(False))


def judged(frames: DataFrame, versions: Sequence[Version], channels: int = 3, alive: str = "alive") -> DataFrame:
    """frames (match_id, frame, width, data and alive) without data, with valid_under: the numbers of versions they are valid under, rising."""
    ordered = sorted(versions, key=lambda v: v.number)
    data, width = F.col("data"), F.col("width")
    found = F.array(*(F.when(plain_and_bright(data, width, channels, v), F.lit(v.number)) for v in ordered))
    none = F.array().cast("array<int>")
    return frames.withColumn("valid_under", F.when(F.coalesce(F.col(alive), F.lit(False)), F.array_compact(found)).otherwise(none)).drop("data")


def versions_of(judgements: DataFrame) -> DataFrame:
    """(match_id, since, version): the first frame with a valid version, and the lowest such version."""
    least = F.min(F.struct("frame", F.col("valid_under")[0].alias("version")))
    found = judgements.where(F.size("valid_under") > 0).groupBy("match_id").agg(least.alias("m"))
    return found.select("match_id", F.col("m.frame").alias("since"), F.col("m.version").alias("version"))


def validated(judgements: DataFrame) -> DataFrame:
    """judgements with version and is_valid: valid under the match's version, from the frame on that showed it."""
    joined = judgements.join(versions_of(judgements), "match_id", "left")
    ok = (F.col("frame") >= F.col("since")) & F.array_contains("valid_under", F.col("version"))
    return joined.withColumn("is_valid", F.coalesce(ok, F.lit(False))).drop("since")
