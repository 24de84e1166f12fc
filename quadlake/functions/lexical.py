"""Lexical forms of typed literals: validity and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadlake.vocab import LITERAL, XSD, XSD_STRING

_DIGITS = r"[+-]?[0-9]+"
_TZ = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
_DAY = r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_CLOCK = r"(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"
_MONTH, _DAY_OF_MONTH = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])"
_DAY_TIME = r"(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?"
_FLOAT = r"(?:[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)"

# Fixed patterns: lexical forms of the XML Schema datatypes.
PATTERNS = {
    "boolean": r"(?:true|false|0|1)",
    "decimal": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)",
    "integer": _DIGITS,
    "float": _FLOAT,
    "double": _FLOAT,
    "dateTime": _DAY + "T" + _CLOCK + _TZ,
    "date": _DAY + _TZ,
    "time": _CLOCK + _TZ,
    "gYear": r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})" + _TZ,
    "gYearMonth": r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})-(?:0[1-9]|1[0-2])" + _TZ,
    "gMonth": "--" + _MONTH + _TZ,
    "gDay": "---" + _DAY_OF_MONTH + _TZ,
    "gMonthDay": "--(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)"
                 "|02-(?:0[1-9]|[12][0-9]))" + _TZ,
    "duration": r"-?P(?=[0-9T])(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?" + _DAY_TIME,
    "dayTimeDuration": r"-?P(?=[0-9T])(?:[0-9]+D)?" + _DAY_TIME,
    "yearMonthDuration": r"-?P(?=[0-9])(?:[0-9]+Y)?(?:[0-9]+M)?",
    "base64Binary": r"(?:(?:[A-Za-z0-9+/] ?){4})*+(?:(?:[A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?",
    "hexBinary": r"(?:[0-9A-Fa-f]{2})*+",
}
# Bounds of the derived integer types, None where there is none.
BOUNDS = {
    "long": (-(2 ** 63), 2 ** 63 - 1),
    "int": (-(2 ** 31), 2 ** 31 - 1),
    "short": (-(2 ** 15), 2 ** 15 - 1),
    "byte": (-(2 ** 7), 2 ** 7 - 1),
    "unsignedLong": (0, 2 ** 64 - 1),
    "unsignedInt": (0, 2 ** 32 - 1),
    "unsignedShort": (0, 2 ** 16 - 1),
    "unsignedByte": (0, 2 ** 8 - 1),
    "nonNegativeInteger": (0, None),
    "positiveInteger": (1, None),
    "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1),
}
_NUMBERS = [XSD + t for t in ("integer", "decimal", "float", "double", *BOUNDS)]
_DECIMAL = "decimal(38,12)"


def _full(pattern: str) -> str:
    return f"^{pattern}$"


def _is_day(text: Column) -> Column:
    """Does the month of a date have its day; years may have more than four digits."""
    year, month, day = (F.regexp_extract(text, r"^-?([0-9]{4,})-([0-9]{2})-([0-9]{2})", k) for k in (1, 2, 3))
    # Leap years depend on the last four digits, since 10,000 is a multiple of 400.
    last = F.right(year, F.lit(4)).cast("int")
    leap = (last % 4 == 0) & ((last % 100 != 0) | (last % 400 == 0))
    length = (F.when(month.isin("04", "06", "09", "11"), 30)
              .when(month == "02", F.when(leap, 29).otherwise(28)).otherwise(31))
    return day.cast("int") <= length


def is_valid(text: Column, dt: Column) -> Column:
    """Is the text a lexical form of the datatype; unknown datatypes take any text."""
    checks = F.when(dt.isin(XSD + "dateTime", XSD + "dateTimeStamp"), F.when(
        text.rlike(_full(PATTERNS["dateTime"])),
        _is_day(text) & ((dt == XSD + "dateTime") | text.rlike(r"(?:Z|[+-][0-9]{2}:[0-9]{2})$"))).otherwise(False))
    checks = checks.when(dt == XSD + "date", F.when(text.rlike(_full(PATTERNS["date"])), _is_day(text)).otherwise(False))
    for name, pattern in PATTERNS.items():
        if name not in ("dateTime", "date"):
            checks = checks.when(dt == XSD + name, text.rlike(_full(pattern)))
    for name, (low, high) in BOUNDS.items():
        number = text.try_cast("decimal(38,0)")
        fits = text.rlike(_full(_DIGITS))
        # Integers too long for a decimal lie outside every finite bound.
        huge = number.isNull()
        negative = F.startswith(text, F.lit("-"))
        if low is not None:
            fits = fits & F.when(huge, F.lit(high is None) & ~negative).otherwise(number >= F.lit(str(low)).cast("decimal(38,0)"))
        if high is not None:
            fits = fits & F.when(huge, F.lit(low is None) & negative).otherwise(number <= F.lit(str(high)).cast("decimal(38,0)"))
        checks = checks.when(dt == XSD + name, fits)
    return checks.otherwise(F.lit(True))


def compare_class(text: Column, kind: Column, dt: Column) -> Column:
    """Terms of one class have an order among them; NULL has none."""
    # Casts are laxer than the datatypes: they take suffixes, NaN and bare years.
    plain = text.isin("INF", "+INF", "-INF") | ~text.rlike("[^0-9eE+.-]")
    number = dt.isin(*_NUMBERS) & plain & text.try_cast("double").isNotNull()
    moment = text.try_cast("timestamp").isNotNull() & (F.length(text) >= 10)
    return F.when(kind == LITERAL, (
        F.when(number, "number")
        .when((dt == XSD + "dateTime") & F.contains(text, F.lit("T")) & moment, "dateTime")
        .when((dt == XSD + "date") & ~F.contains(text, F.lit("T")) & moment, "date")
        .when(dt == XSD_STRING, "string")
        .when((dt == XSD + "boolean") & text.isin("true", "false", "0", "1"), "boolean")))


def compare_key(text: Column, dt: Column) -> Column:
    """A struct whose order is the order of the terms within one compare class.

    Numbers compare as decimals, and by their double where those agree or are
    out of range, so both long integers and small doubles keep their order. Integers too
    long for a decimal compare by sign, number of digits and digits.
    """
    number = dt.isin(*_NUMBERS)
    digits = F.regexp_replace(text, "^[+-]?0*", "")
    long = number & text.try_cast(_DECIMAL).isNull() & text.rlike(_full(_DIGITS))
    minus = F.startswith(text, F.lit("-"))
    dec, dbl = text.try_cast(_DECIMAL), text.try_cast("double")
    rank = F.when(number & dec.isNull(), F.when(dbl < 0, -1).otherwise(1)).otherwise(
        F.when(dt == XSD + "boolean", F.when(text.isin("true", "1"), 1).otherwise(0)).otherwise(0))
    moment = F.when(dt.isin(XSD + "dateTime", XSD + "date"), text.try_cast("timestamp"))
    return F.struct(
        rank.alias("rank"), F.when(number, dec).alias("dec"), F.when(number, dbl).alias("dbl"),
        F.when(long, F.when(minus, -F.length(digits)).otherwise(F.length(digits))).alias("digits"),
        F.when(long, F.when(minus, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)).alias("long"),
        moment.alias("moment"), F.when(dt == XSD_STRING, text).alias("text"))
