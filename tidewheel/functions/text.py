"""Text expressions: numbers in values, time prefixes, result text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal and hexadecimal float literals, infinities and nan, with no blanks and
#: no type suffix.
_DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_HEX = r"^[+-]?0[xX]([0-9a-fA-F]*)\.?([0-9a-fA-F]*)[pP]([+-]?\d+)$"
_SPECIAL = r"^([+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
_PREFIX = r"^([+-]?\d{1,19})\|"


def number(value: Column) -> Column:
    """The value as a double, or null if it does not parse as a whole or is out
    of range (a finite literal never becomes infinite). A hexadecimal literal
    has an exponent and at most 13 digits that count."""
    plain = F.when(value.rlike(_DECIMAL), value.try_cast("double"))
    plain = F.when(value.rlike(_HEX), _hexadecimal(value)).otherwise(plain)
    finite = F.when(F.abs(plain) < float("inf"), plain)
    special = F.when(F.lower(value).rlike("nan"), F.lit(float("nan"))).otherwise(F.when(value.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.when(value.rlike(_SPECIAL), special).otherwise(finite)


def _hexadecimal(value: Column) -> Column:
    """[sign] 0x digits [. digits] p exponent: the digits as a whole number, times
    a power of two that places the point."""
    part = lambda k: F.regexp_extract(value, _HEX, k)
    digits = F.concat(part(1), part(2))
    counted = F.regexp_replace(digits, "^0+(?=.)", "")
    whole = F.when((F.length(digits) > 0) & (F.length(counted) <= 13), F.conv(counted, 16, 10).cast("double"))
    power = part(3).try_cast("int") - F.length(part(2)) * 4
    # In two steps, since one power alone may leave the range.
    half = (power / 2).cast("int")
    scaled = whole * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
    return F.when(value.startswith("-"), -scaled).otherwise(scaled)


def float_text(x: Column) -> Column:
    """A double as shortest decimal text without an exponent: 3, 0.5, 10000000."""
    plain = x.cast("string")
    parts = F.split(plain, "E")
    digits = F.regexp_replace(F.regexp_replace(parts[0], r"^-", ""), r"\.", "")
    whole = F.length(F.regexp_extract(parts[0], r"^-?(\d+)", 1))
    places = F.element_at(parts, -1).cast("int")
    point = whole + places
    shifted = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    text = F.when(F.size(parts) == 2, F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), shifted)).otherwise(plain)
    return F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("+Inf")).when(x == float("-inf"), F.lit("-Inf")).otherwise(F.regexp_replace(F.when(text.contains("."), F.regexp_replace(text, r"0+$", "")).otherwise(text), r"\.$", ""))


def _prefix(value: Column) -> Column:
    """The leading nanoseconds of `<ns>|payload`, null if there are none."""
    return F.regexp_extract(value, _PREFIX, 1).try_cast("long")


def event_time(value: Column, ts: Column) -> Column:
    """The time a value carries as `<unix nanoseconds>|payload`, else ts.
    Microseconds are kept; what is finer is cut off."""
    ns = _prefix(value)
    us = F.floor(ns / F.lit(1000).cast("decimal(20,0)")).cast("long")
    return F.coalesce(F.timestamp_micros(us).cast("timestamp_ntz"), ts)


def payload(value: Column) -> Column:
    """The value without its time prefix."""
    return F.when(_prefix(value).isNotNull(), F.regexp_replace(value, r"^[^|]*\|", "")).otherwise(value)


def upper_value(value: Column) -> Column:
    return F.upper(value)


def window_text(start: Column, end: Column, result: Column) -> Column:
    """`window[HH:MM:SS~HH:MM:SS) result`."""
    return F.concat(F.lit("window["), F.date_format(start, "HH:mm:ss"), F.lit("~"), F.date_format(end, "HH:mm:ss"), F.lit(") "), result)
