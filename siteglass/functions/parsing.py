"""Strict parsers as column expressions: null where a value is not what it claims to be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(x: Column) -> Column:
    """YYYY-MM-DD that is on the calendar."""
    return F.when(F.regexp_like(x, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(x, "yyyy-MM-dd"))


def w3c_datetime(x: Column) -> Column:
    """Whether x is a year, month, day or date and time with a zone, on the calendar. The parts at either side of T are parsed on their own."""
    day, clock = F.substring_index(x, "T", 1), F.when(F.contains(x, F.lit("T")), F.regexp_replace(x, "^[^T]*T", ""))
    n = F.length(day)
    on_calendar = F.when(n == 4, F.regexp_like(day, F.lit(r"^\d+$"))).when(n == 7, strict_date(F.concat(day, F.lit("-01"))).isNotNull()).otherwise(strict_date(day).isNotNull())
    zone = F.regexp_extract(clock, r"(Z|[+-]\d\d:\d\d)$", 1)
    time = F.left(clock, F.length(clock) - F.length(zone))
    hours = lambda t: F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), t), F.lit("yyyy-MM-dd HH:mm")).isNotNull()
    seconds = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), F.regexp_replace(time, r"(?<=:\d\d:\d\d)\.\d+$", "")), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    good_time = F.when(F.length(time) == 5, hours(time)).otherwise(seconds)
    good_zone = F.when(zone == "Z", True).otherwise((zone != "") & hours(F.substring(zone, 2, 5)))
    return F.when(clock.isNull(), on_calendar).otherwise((n == 10) & on_calendar & good_time & good_zone)


def zoned_timestamp(x: Column) -> Column:
    """Whether x is a date and time that names its zone."""
    return F.contains(x, F.lit("T")) & w3c_datetime(x)


def position(x: Column) -> Column:
    """An average position: a plain decimal of 1 or more (0 for what was never shown)."""
    t = F.trim(x)
    return F.when(F.regexp_like(t, F.lit(r"^\d+(\.\d+)?$")), t.try_cast("double"))


def exact_decimal(x: Column) -> Column:
    """A number as an exact decimal: digits, with a sign and a fraction, and nothing else."""
    t = F.trim(x)
    return F.when(F.regexp_like(t, F.lit(r"^[+-]?\d{1,20}(\.\d{1,18})?$")), t.try_cast("decimal(38,18)"))


def grouped_integer(x: Column) -> Column:
    """An integer, with commas between groups of three digits or without any."""
    t = F.trim(x)
    return F.when(F.regexp_like(t, F.lit(r"^(\d+|\d{1,3}(,\d{3})+)$")), F.regexp_replace(t, ",", "").try_cast("long"))


def click_rate(x: Column) -> Column:
    """A percentage such as 2.5% or a fraction from 0 to 1, as a fraction."""
    t = F.trim(x)
    value = F.when(F.endswith(t, F.lit("%")), F.regexp_replace(t, r"\s*%$", "").try_cast("double") / 100).otherwise(t.try_cast("double"))
    return F.when(F.regexp_like(t, F.lit(r"^\d+(\.\d+)?(\s*%)?$")) & value.between(0, 1), value)


def rating(x: Column) -> Column:
    """A number, a percentage or a fraction n/m, as (value, scale); the scale is null for a bare number."""
    t = F.trim(x)
    number = r"\d+(?:\.\d+)?"
    value = F.regexp_extract(t, rf"^({number})", 1).try_cast("double")
    ok = F.regexp_like(t, F.lit(rf"^{number}(\s*%|\s*/\s*{number})?$"))
    scale = F.when(F.endswith(t, F.lit("%")), 100.0).otherwise(F.nullif(F.regexp_extract(t, rf"/\s*({number})$", 1), F.lit("")).try_cast("double"))
    return F.when(ok & (scale.isNull() | (value <= scale)), F.struct(value.alias("value"), scale.alias("scale")))


def price_visible(text: Column, price: Column) -> Column:
    """Whether a whole price stands in a text, with or without thousands commas, and not inside a longer number."""
    plain = price.cast("long").cast("string")
    grouped = F.format_number(price.cast("long"), 0)
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d.,])("), plain, F.lit("|"), grouped, F.lit(r")(?!\d|[.,]\d)")))


def bot_hit(agent: Column, token: str) -> Column:
    """Whether an agent string holds a bot's token on its own."""
    return F.regexp_like(agent, F.lit(rf"(?i)(^|[^A-Za-z0-9-])\Q{token}\E([^A-Za-z0-9-]|$)"))


def terms_hit(terms: list[str], *fields: Column) -> Column:
    """Whether any term of two or more characters is in one of the fields, whatever the case."""
    text = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(False)
    for t in terms:
        if len(t) >= 2:
            out = out | F.contains(text, F.lit(t.lower()))
    return out
