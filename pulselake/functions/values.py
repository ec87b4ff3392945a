"""Small value mappings: severity, span kind, number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Log level by severity number; every other number is INFO.
SEVERITY_LEVELS = {1: "TRACE", 5: "DEBUG", 9: "INFO", 13: "WARN", 17: "ERROR", 21: "FATAL"}
DEFAULT_LEVEL = "INFO"

# Span kind text by number, from 0; every other number is UNSPECIFIED.
SPAN_KINDS = ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]

# Status codes of a span.
STATUS_OK = 1
STATUS_ERROR = 2


def severity_level(number: Column) -> Column:
    level = F.lit(None).cast("string")
    for code, text in SEVERITY_LEVELS.items():
        level = F.when(number == code, text).otherwise(level)
    return F.coalesce(level, F.lit(DEFAULT_LEVEL))


def span_kind_text(number: Column) -> Column:
    kind = F.lit(None).cast("string")
    for code, text in enumerate(SPAN_KINDS):
        kind = F.when(number == code, text).otherwise(kind)
    return F.coalesce(kind, F.lit(SPAN_KINDS[0]))


def int64(text: Column) -> Column:
    """BIGINT of a number or its text; absent is 0, unreadable is NULL."""
    return F.coalesce(text, F.lit("0")).try_cast("bigint")


def uint64_value(text: Column) -> Column:
    """DOUBLE of an unsigned 64-bit count; absent is 0."""
    return F.coalesce(text.try_cast("decimal(20,0)").cast("double"), F.lit(0.0))


def number_text(x: Column) -> Column:
    """Shortest decimal text of a double: 0.5, 10, 1e+06, 2.5e-05.

    The exponent form is used below 1e-4 and from 1e6 on, with at least two exponent digits.
    """
    size = F.abs(x)
    text = size.cast("string")
    short = F.regexp_replace(text, r"\.0$", "")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1)
    # Between 1e6 and 1e7 the text is plain: seven digits before the point.
    digits = F.regexp_replace(F.replace(text, F.lit("."), F.lit("")), "0+$", "")
    seven = F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substr(digits, F.lit(2))), r"\.$", "")
    plain = (
        F.when(size >= 1e7, F.concat(mantissa, F.lit("e+"), F.lpad(exponent, 2, "0")))
        .when(size >= 1e6, F.concat(seven, F.lit("e+06")))
        .when((size >= 1e-3) | (size == 0), short)
        .when(size >= 1e-4, F.concat(F.lit("0.000"), F.replace(mantissa, F.lit("."), F.lit(""))))
        .otherwise(F.concat(mantissa, F.lit("e-"), F.lpad(F.substr(exponent, F.lit(2)), 2, "0")))
    )
    long_exponent = F.when(size >= 1e100, F.concat(mantissa, F.lit("e+"), exponent)).when(
        (size < 1e-99) & (size > 0), F.concat(mantissa, F.lit("e"), exponent)
    )
    finite = F.concat(F.when(x < 0, "-").otherwise(""), F.coalesce(long_exponent, plain))
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == float("inf"), "+Inf")
        .when(x == float("-inf"), "-Inf")
        .otherwise(finite)
    )
