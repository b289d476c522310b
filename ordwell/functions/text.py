"""Scalar functions on names, times and colours, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordwell.dims import COMMENTS, DISPLAY, OBJECT_HERO


def mapping(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def time_format(seconds: Column, compat: bool = False) -> Column:
    """HH:MM:SS.f with one digit; compat prints the fraction's digits as an integer, so 5.05 gives .5."""
    whole = F.floor(seconds).cast("long")
    if compat:
        digits = F.substring_index(F.round(seconds - F.floor(seconds / 60) * 60, 9).cast("string"), ".", -1)
        part = F.coalesce(digits.try_cast("long"), F.lit(0))
    else:
        part = F.floor((seconds - whole) * 10 + 1e-9).cast("long")
    return F.format_string("%02d:%02d:%02d.%d", F.expr("0") + F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)), part)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero as a double, as in C and DuckDB: 1.005 is below the half, so 1.0; Spark's round() takes its decimal digits, so 1.01."""
    return F.round(x * float(10**digits), 0) / float(10**digits)


def hms_to_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS.f; null where it isn't that."""
    part = lambda k: F.try_element_at(F.split(text, ":"), F.lit(k)).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def display_name(name: Column) -> Column:
    """Exceptions, else the first letter upper-cased and the rest lower-cased; of a letter whose upper case is two (ß) the first is upper."""
    first = F.upper(F.substring(name, 1, 1))
    plain = F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 8)), F.lower(F.substring(name, 2, 1 << 20)))
    return F.coalesce(F.try_element_at(mapping(DISPLAY), name), plain)


def upper_ascii(name: Column) -> Column:
    """Upper-cased where all are ASCII letters or blanks; the empty mark is no name."""
    return F.when(name.isin("empty", "Empty"), "").when(name.rlike("^[A-Za-z ]*$"), F.upper(name)).otherwise(name)


def hex_colour(b: Column, g: Column, r: Column) -> Column:
    """Struct (rgb in hex, whether it is dark: mean below 95)."""
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    return F.struct(F.concat(two(r), two(g), two(b)).alias("rgb"), ((b + g + r) / 3 < 95).alias("is_deep"))


def stem(name: Column) -> Column:
    """Up to the first dot."""
    return F.substring_index(name, ".", 1)


def last_stem(name: Column) -> Column:
    """Without the last suffix."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def category_of(text: Column) -> Column:
    """Ability category by what the text contains."""
    low = F.lower(text)
    return F.when(low.contains("ult"), "ultimate").when(low.contains("pass"), "passive").when(low.contains("weapon"), "weapon").otherwise("ability")


def icon_parts(name: Column) -> Column:
    """Struct (name, category, bind) of name@category@bind."""
    parts = F.split(name, "@")
    return F.struct(parts[0].alias("name"), category_of(F.get(parts, 1)).alias("category"), F.get(parts, 2).alias("bind"))


def owner(obj: Column) -> Column:
    """The hero an object belongs to, or the name itself."""
    return F.coalesce(F.try_element_at(mapping(OBJECT_HERO), obj), obj)


def action(killer_hero: Column, killer_team: Column, victim_hero: Column, victim_team: Column) -> Column:
    """Resurrect, Demech, Suicide or Eliminate, tested in this order; no killer is null or empty."""
    none = killer_hero.isNull() | killer_hero.isin("", "empty")
    return (
        F.when(F.coalesce((killer_hero == "mercy") & (killer_team == victim_team), F.lit(False)), "Resurrect")
        .when(victim_hero == "meka", "Demech")
        .when(none & victim_hero.isNotNull(), "Suicide")
        .otherwise("Eliminate")
    )


def comment(action: Column) -> Column:
    return mapping(COMMENTS)[action]


def arguments(line: Column) -> Column:
    """Map of key=value arguments."""
    return F.str_to_map(line, F.lit(" "), F.lit("="))


def linspace(low: Column, high: Column, n: Column) -> Column:
    """n even steps from low to high; one step is low."""
    return F.when(n == 1, F.array(low)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: low + i * (high - low) / (n - 1)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def correlation(a: Column, b: Column) -> Column:
    """Mean-centred normalised correlation of two arrays; 0 where one is flat."""
    ma, mb = total(a) / F.size(a), total(b) / F.size(b)
    cov = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    var = total(F.transform(a, lambda x: (x - ma) * (x - ma))) * total(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.when(var > 0, cov / F.sqrt(var)).otherwise(0.0)


def binary_iou(a: Column, b: Column, threshold: float = 127.0) -> Column:
    """Shared over united elements above threshold."""
    on = lambda x: x > threshold
    both = total(F.zip_with(a, b, lambda x, y: (on(x) & on(y)).cast("double")))
    either = total(F.zip_with(a, b, lambda x, y: (on(x) | on(y)).cast("double")))
    return both / (either + 1e-6)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def created_at() -> Column:
    """The present time in UTC, as match documents write it."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
