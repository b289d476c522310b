"""What the boxes found in one kill row mean: roles, ability, critical and environmental flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def roles(heroes: Column, arrow_x: Column) -> Column:
    """Struct (subject, object) of an array of (x, hero): left of the arrow acts; of several the rightmost counts.

    More than two heroes in a row are an error.
    """
    side = lambda left: F.element_at(F.sort_array(F.filter(heroes, lambda h: (h["x"] < arrow_x) == F.lit(left))), -1)["hero"]
    pick = lambda left: F.when(F.exists(heroes, lambda h: (h["x"] < arrow_x) == F.lit(left)), side(left))
    both = F.struct(pick(True).alias("subject"), pick(False).alias("object"))
    return F.when(F.size(heroes) > 2, F.raise_error(F.lit("more than two heroes in a kill row")).cast("struct<subject:string,object:string>")).otherwise(both)


def flags(arrow_x1: Column, arrow_x2: Column, killer_x2: Column, victim_x1: Column, assist_x2: Column, ability_x2: Column, environment: Column) -> Column:
    """Struct (has_assist, has_ability, is_critical, is_environmental) from gaps in widths of the arrow.

    assist_x2 counts from the killer's box, ability_x2 from the end of the assists (or of
    the killer's box); null where none is found. A gap of 2.5 arrow widths on the left holds
    something; 1.5 more after assists, an ability or the critical sign; one width after an
    ability, the critical sign. Two widths on the right may hold an environment's icon.
    """
    width, region = arrow_x2 - arrow_x1, arrow_x1 - killer_x2
    wide = region >= 2.5 * width
    rest = region - F.coalesce(assist_x2, F.lit(0))
    looked = wide & (assist_x2.isNull() | (rest >= 1.5 * width))
    critical = looked & (ability_x2.isNull() | (rest - ability_x2 >= width))
    return F.struct(
        (wide & assist_x2.isNotNull()).alias("has_assist"),
        (looked & ability_x2.isNotNull()).alias("has_ability"),
        F.coalesce(critical, F.lit(False)).alias("is_critical"),
        ((victim_x1 - arrow_x2 >= 2 * width) & environment).alias("is_environmental"),
    )


def sampling_parameters(start: float, end: float, fps: float, game_type: int) -> None:
    """Raise ValueError unless end >= start >= 0, fps > 0 and the game type is 0 or 1."""
    if not end >= start >= 0:
        raise ValueError("end >= start >= 0 is needed")
    if fps <= 0:
        raise ValueError("fps must be positive")
    if game_type not in (0, 1):
        raise ValueError("game type is 0 or 1")
