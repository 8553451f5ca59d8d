"""Column functions on the bytes and fields of fixed-width feed records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turfspark import constants as C

CODE_PAGE = "windows-31j"
BLANKS = " \t\r\n\x0b\x0c　"
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
ANY_DIGIT = f"[0-9{FULL_WIDTH_DIGITS}]"


def to_bytes(payload: Column, width: int) -> Column:
    """Bytes of a record in the feed's code page, blank-padded to its nominal width."""
    encoded = F.encode(F.coalesce(payload, F.lit("")), CODE_PAGE)
    return F.rpad(encoded, F.lit(width), F.lit(b" "))


def byte_range(data: Column, start: Column | int, length: int) -> Column:
    begin = start + 1 if isinstance(start, Column) else F.lit(start + 1)
    return F.substring(data, begin, F.lit(length))


def text(data: Column, start: Column | int, length: int) -> Column:
    """Trimmed text of a byte range; empty when the range cuts a character in half.

    Printable ASCII is the same in the code page, so only other bytes are decoded.
    """
    cut = byte_range(data, start, length)
    raw = F.decode(cut, CODE_PAGE)
    decoded = F.when(F.contains(raw, F.lit("�")), F.lit("")).otherwise(F.btrim(raw, F.lit(BLANKS)))
    plain = cut.cast("string")
    return F.when(plain.rlike(r"\A[ -~]*\z"), F.btrim(plain)).otherwise(decoded)


def number(data: Column, start: Column | int, length: int, other: Column, none: int | None = 0) -> Column:
    """The number of a byte range: ASCII digits are read as they are, ASCII without a digit is `none`, the rest is `other`.

    A failing cast makes and catches an exception, thousands of times the work of a comparison.
    """
    raw = byte_range(data, start, length).cast("string")
    return (
        F.when(raw.rlike(r"\A *[0-9]+ *\z"), raw.try_cast("bigint"))
        .when(raw.rlike(r"\A[ -/:-~]*\z"), F.lit(none).cast("bigint"))
        .otherwise(other)
    )


def char_text(payload: Column, start: int, length: int) -> Column:
    """Trimmed text of a character range, for the records cut by characters."""
    return F.btrim(F.substring(F.coalesce(payload, F.lit("")), start + 1, length), F.lit(BLANKS))


def digits(value: Column) -> Column:
    ascii_digits = F.translate(value, FULL_WIDTH_DIGITS, "0123456789")
    return F.regexp_replace(ascii_digits, "[^0-9]", "")


def clean_int(value: Column, default: int | None = 0) -> Column:
    """Digits of a text as a number; `default` when there are none."""
    parsed = F.when(value.rlike(ANY_DIGIT), digits(value).try_cast("bigint"))
    return F.coalesce(parsed, F.lit(default).cast("bigint"))


def maskable_int(value: Column) -> Column:
    """Digits of a text as a number; null when masked with `*` or empty."""
    return F.when(~F.contains(value, F.lit("*")) & value.rlike(ANY_DIGIT), digits(value).try_cast("bigint"))


def signed_int(value: Column) -> Column:
    return F.when(value.rlike("[0-9]"), F.btrim(value).try_cast("int"))


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def strict_date(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]{8}$"), F.try_to_date(value, "yyyyMMdd"))


def strict_time(value: Column) -> Column:
    """`HHMM` as `HH:MM:00`, null when it is no time of day."""
    hour = F.substring(value, 1, 2).try_cast("int")
    minute = F.substring(value, 3, 2).try_cast("int")
    valid = value.rlike("^[0-9]{4}$") & (hour < 24) & (minute < 60)
    return F.when(valid, F.format_string("%02d:%02d:00", hour, minute))


def run_seconds(value: Column) -> Column:
    """`MSSF` or `MMSSF` run time in seconds."""
    width = F.length(value)
    minutes = F.substring(value, F.lit(1), width - 3).try_cast("int")
    seconds = F.substring(value, width - 2, F.lit(2)).try_cast("int")
    tenths = F.substring(value, width, F.lit(1)).try_cast("int")
    usable = value.rlike("^[0-9]{4,5}$")
    return F.when(usable, (minutes * 60 + seconds) + tenths / 10.0)


def forecast_tenths(value: Column) -> Column:
    """`MSSCC` forecast in tenths of a second; null when unknown (99999) or zero."""
    minutes = F.substring(value, 1, 1).try_cast("bigint")
    seconds = F.substring(value, 2, 2).try_cast("bigint")
    hundredths = F.substring(value, 4, 2).try_cast("bigint")
    known = value.rlike("^[0-9]{5}$") & ~value.isin("99999", "00000")
    total = minutes * 600 + seconds * 10 + F.floor(hundredths / 10)
    return F.when(known, total)


def tenths(value: Column) -> Column:
    """Seconds from a count of tenths; null when zero or not a number."""
    parsed = F.when(value.rlike("[0-9]"), F.btrim(value).try_cast("int"))
    return F.when(parsed != 0, parsed / 10.0)


def rescaled_distance(distance: Column) -> Column:
    return F.when((distance > 0) & (distance < 100), distance * 100).otherwise(distance)


def surface_of_track(track_type: Column) -> Column:
    return F.when(track_type.between(23, 29), 2).when(track_type.between(51, 59), 3).otherwise(1)


def grade_number(code: Column) -> Column:
    table = F.create_map(*[F.lit(part) for pair in C.GRADE_CODES.items() for part in pair])
    return F.try_element_at(table, F.upper(F.trim(code)))


def condition_choice(
    race_type: Column, two: Column, three: Column, four: Column, five: Column, lowest: Column
) -> Column:
    """Condition code by race type, then the lowest-age code, then the oldest one given."""
    two, three, four, five, lowest = (positive(c) for c in (two, three, four, five, lowest))
    by_type = (
        F.when(race_type == 11, two)
        .when(race_type.isin(12, 13), three)
        .when(race_type == 14, F.coalesce(four, five))
    )
    return F.coalesce(by_type, lowest, five, four, three, two, F.lit(0))


# --- race identifiers --------------------------------------------------------


def race_id_from_key(key: Column) -> Column:
    """16-character race key (date, track, meeting, day, number) to the numeric id; 0 if broken."""
    number = lambda start, size: F.substring(key, start, size).try_cast("bigint")
    day = number(1, 4) * 10000 + number(5, 2) * 100 + number(7, 2)
    value = day * 10000 + number(9, 2) * 100 + number(15, 2)
    return F.coalesce(F.when(F.length(key) >= 16, value), F.lit(0).cast("bigint"))


def make_race_id(day: Column, track: Column, race_no: Column) -> Column:
    number = (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("bigint")
    return number * 10000 + track * 100 + race_no


def race_id_date(race_id: Column) -> Column:
    day = F.lpad(F.floor(race_id / F.lit(10000)).cast("string"), 8, "0")
    return F.when(race_id > 0, F.try_to_date(day, "yyyyMMdd"))


def race_id_track(race_id: Column) -> Column:
    return F.pmod(F.floor(race_id / F.lit(100)), F.lit(100)).cast("int")


def race_id_number(race_id: Column) -> Column:
    return F.pmod(race_id, F.lit(100)).cast("int")


def in_history_scope(race_id: Column, first: str, last: str | None) -> Column:
    """Central track and a date within the history range, from the id alone."""
    day = race_id_date(race_id)
    inside = day >= F.lit(first).cast("date")
    if last is not None:
        inside = inside & (day <= F.lit(last).cast("date"))
    return F.coalesce(race_id_track(race_id).between(*C.CENTRAL_TRACKS) & inside, F.lit(False))
