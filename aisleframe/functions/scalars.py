"""Scalar column expressions: distance, dates, paths, shares."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, instead of repeating its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(EARTH_RADIUS_KM * 2) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is empty or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def percent(num: Column, den: Column) -> Column:
    return F.lit(100.0) * ratio(num, den)


def days_ago(ts: Column, as_of: Column) -> Column:
    """Whole elapsed days, negative for the future."""
    micros = F.timestamp_diff("MICROSECOND", ts.cast("timestamp_ntz"), as_of.cast("timestamp_ntz"))
    return F.floor(micros / F.lit(86400000000.0)).cast("long")


def week_index(ts: Column, as_of: Column) -> Column:
    """0 for the seven days before ``as_of``, 1 for the seven before those, and so on."""
    return F.floor(days_ago(ts, as_of) / F.lit(7)).cast("long")


def age_in_days_rounded(ts: Column, as_of: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", ts.cast("timestamp_ntz"), as_of.cast("timestamp_ntz"))
    return F.floor(micros / F.lit(86400000000.0) + F.lit(0.5)).cast("long")


def relative_age(ts: Column, as_of: Column) -> Column:
    """today / yesterday / N days / N weeks / N months."""
    d = age_in_days_rounded(ts, as_of)
    return (
        F.when(d <= 0, F.lit("today"))
        .when(d == 1, F.lit("yesterday"))
        .when(d < 7, F.concat(d.cast("string"), F.lit(" days")))
        .when(d < 30, F.concat(F.floor(d / 7).cast("string"), F.lit(" weeks")))
        .otherwise(F.concat(F.floor(d / 30).cast("string"), F.lit(" months")))
    )


# Leap years of the 33-year cycle by their place in it, and the days before each month.
LEAP_PLACES = (1, 5, 9, 13, 17, 22, 26, 30)
MONTH_STARTS = (0, 31, 62, 93, 124, 155, 186, 216, 246, 276, 306, 336)
# 1 Farvardin 1353, the first day of a cycle, was 21 March 1974.
CYCLE_YEAR, CYCLE_DATE = 1353, date(1974, 3, 21)


def jalali(ts: Column) -> Column:
    """Solar Hijri date as struct<jy, jm, jd>.

    Arithmetic calendar with eight leap years in 33 (Heydari, "A concise review of the Iranian
    calendar", 2004): the year is looked up among the cycle's year starts, the month among the
    month starts.
    """
    lengths = [366 if place in LEAP_PLACES else 365 for place in range(33)]
    starts = [sum(lengths[:place]) for place in range(33)]
    cycle_days = sum(lengths)
    table = lambda values: F.array(*[F.lit(v) for v in values])

    def last_at_most(values, x: Column) -> Column:
        return F.size(F.filter(table(values), lambda v: v <= x))

    day = F.unix_date(ts.cast("date")) - F.lit((CYCLE_DATE - date(1970, 1, 1)).days)
    split = let(day, lambda d: F.struct(
        F.floor(d / cycle_days).cast("int").alias("cycle"), F.pmod(d, F.lit(cycle_days)).alias("rest")
    ))
    year = let(split, lambda s: F.struct(
        s["cycle"].alias("cycle"), s["rest"].alias("rest"), last_at_most(starts, s["rest"]).alias("place")
    ))
    in_year = let(year, lambda y: F.struct(
        (F.lit(CYCLE_YEAR - 1) + F.lit(33) * y["cycle"] + y["place"]).cast("int").alias("jy"),
        (y["rest"] - F.element_at(table(starts), y["place"])).alias("doy"),
    ))
    month = let(in_year, lambda y: F.struct(
        y["jy"].alias("jy"), y["doy"].alias("doy"), last_at_most(MONTH_STARTS, y["doy"]).alias("jm")
    ))
    return let(month, lambda x: F.struct(
        x["jy"].alias("jy"), x["jm"].cast("int").alias("jm"),
        (x["doy"] - F.element_at(table(MONTH_STARTS), x["jm"]) + 1).cast("int").alias("jd"),
    ))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_parent(path: Column) -> Column:
    """Name of the folder that holds the file, '' at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def file_extension(path: Column) -> Column:
    """Last extension with its dot, lower case; '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    at = F.instr(path, base)
    return F.when(at > 0, F.substr(path, at + F.lit(len(base)))).otherwise(path)


def ordered_unique(values: Column, cap: int | None = None) -> Column:
    """Distinct entries in first-seen order, empty entries removed."""
    kept = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    return F.slice(kept, 1, cap) if cap is not None else kept
