"""Scalar column functions used by features, labels and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from turfspark import constants as C


def number(column: Column) -> Column:
    """Coerce to double; what does not parse, and NaN, becomes null."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def whole(column: Column) -> Column:
    return column.try_cast("bigint")


def flag(condition: Column) -> Column:
    """0/1 flag where an unknown comparison counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def distance_bucket(distance: Column) -> Column:
    out = F.when(distance <= 0, F.lit(None))
    for edge in C.DISTANCE_EDGES:
        out = out.when(distance <= edge, F.lit(float(edge)))
    return out.when(distance.isNotNull(), F.lit(float(C.DISTANCE_EDGES[-1])))


def going_bucket(going: Column) -> Column:
    return F.when(going <= 2, F.lit(1.0)).when(going > 2, F.lit(2.0))


def start_seconds(text: Column) -> Column:
    """`HH:MM[:SS]` to seconds of the day; 23:59:00 when absent or unreadable."""
    parts = F.split(F.trim(text), ":")
    second = F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(3)).try_cast("int")).otherwise(0)
    total = (
        F.try_element_at(parts, F.lit(1)).try_cast("int") * 3600
        + F.try_element_at(parts, F.lit(2)).try_cast("int") * 60
        + second
    )
    return F.coalesce(F.when(F.size(parts) >= 2, total), F.lit(C.MISSING_START_SECONDS))


def post_time(race_date: Column, seconds: Column) -> Column:
    """Wall-clock timestamp without a zone: date plus seconds of the day."""
    return race_date.cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )


def epoch_seconds(stamp: Column) -> Column:
    """Seconds since 1970-01-01 of a wall-clock timestamp, free of any time zone."""
    day = F.unix_date(stamp.cast("date")).cast("bigint")
    return day * 86400 + F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)


def whole_days(later: Column, earlier: Column) -> Column:
    """Completed days between two epoch-second columns."""
    return F.floor((later - earlier) / 86400.0).cast("bigint")


def announce_time(announce: Column, race_time: Column) -> Column:
    """`MMDDhhmm` announcement of a race, its year moved when it is over 180 days off."""
    digits = F.lpad(F.coalesce(announce, F.lit("")), 8, "0")
    part = lambda start: F.substring(digits, start, 2).try_cast("int")
    stamp = F.try_make_timestamp_ntz(
        F.year(race_time), part(1), part(3), part(5), part(7), F.lit(0)
    )
    days = F.datediff(stamp.cast("date"), race_time.cast("date"))
    year = F.expr("interval '1' year")
    return (
        F.when(days > C.YEAR_ROLLOVER_DAYS, stamp - year)
        .when(days < -C.YEAR_ROLLOVER_DAYS, stamp + year)
        .otherwise(stamp)
    )


def stamp_time(ymd: Column, hm: Column) -> Column:
    """`YYYYMMDD` and `hhmm` as a wall-clock timestamp, null when they are none."""
    number = lambda text, start, size: F.substring(text, start, size).try_cast("int")
    clock = F.lpad(F.coalesce(hm, F.lit("")), 4, "0")
    valid = F.length(ymd) == 8
    made = F.try_make_timestamp_ntz(
        number(ymd, 1, 4), number(ymd, 5, 2), number(ymd, 7, 2), number(clock, 1, 2),
        number(clock, 3, 2), F.lit(0),
    )
    return F.when(valid, made)


def first_digits(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)", 1).try_cast("bigint")


def age_from_id(race_date: Column, horse_id: Column) -> Column:
    age = F.year(race_date) - F.substring(horse_id.cast("string"), 1, 4).try_cast("int")
    return F.when(age.between(0, 20), age)


def month_angle(race_date: Column) -> Column:
    return F.lit(2.0 * math.pi) * (F.month(race_date) - 1.0) / 12.0


def min_age(columns: dict[str, Column]) -> Column:
    """Lowest admitted age: the first condition code present, youngest first."""
    present = [
        F.when(number(columns[name]) > 0, F.lit(age))
        for name, age in C.MIN_AGE_CODES
        if name in columns
    ]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def target_label(finish: Column) -> Column:
    return F.when(finish == 1, 3).when(finish == 2, 2).when(finish == 3, 1).otherwise(0)


def pair_key(first: Column, second: Column) -> Column:
    return F.format_string("%02d%02d", F.least(first, second), F.greatest(first, second))


def speed_index(base: Column, seconds: Column, distance: Column) -> Column:
    distance = F.when(distance != 0, distance)
    return (base - seconds) * (F.lit(C.BASE_DISTANCE_M) / distance) + 80.0


def shrunk_mean(fine_mean: Column, fine_count: Column, coarse_mean: Column) -> Column:
    count = F.coalesce(fine_count.cast("double"), F.lit(0.0))
    weight = count / (count + C.SHRINKAGE_K)
    return weight * F.coalesce(fine_mean, coarse_mean) + (1.0 - weight) * coarse_mean


def slope3(lag3: Column, lag2: Column, lag1: Column) -> Column:
    """Least-squares slope through three equally spaced values, oldest first."""
    return F.when(lag2.isNotNull(), (lag1 - lag3) / 2.0)


def round_report(value: Column, digits: int) -> Column:
    """Half-even rounding for reports; anything not finite becomes null."""
    value = value.cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.bround(value, digits))


def slug(text: Column) -> Column:
    body = F.regexp_replace(F.lower(F.trim(text.cast("string"))), "[^0-9a-zA-Z]+", "_")
    body = F.btrim(body, F.lit("_"))
    return F.when(body == "", F.lit("group")).otherwise(body)


def surface_word(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*C.TURF_WORDS), "shiba").when(text.isin(*C.DIRT_WORDS), "dirt")


def binary_label(value: Column) -> Column:
    """0/1 from booleans, numbers or the words true/false; null for anything else."""
    text = F.lower(F.trim(value.cast("string")))
    as_number = number(text)
    return (
        F.when(text == "true", 1)
        .when(text == "false", 0)
        .when(as_number.isin(0.0, 1.0), as_number.cast("int"))
    )
