"""Rounding and number parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The text forms accepted as a floating point number.
DECIMAL_FLOAT = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
HEX_FLOAT = r"[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+"
NAMED_FLOAT = r"[+-]?(?i:inf|infinity)|(?i:nan)"
# "$" would also match before a line break at the end.
FLOAT_TEXT = rf"^({DECIMAL_FLOAT}|{HEX_FLOAT}|{NAMED_FLOAT})\z"

# The largest double below 0.5. Adding it and cutting off the fraction rounds half up
# for every positive double; adding 0.5 itself would raise 0.49999999999999994 to 1.
BELOW_HALF = 0.49999999999999994


def round_half_away(value: Column, precision: int = 0) -> Column:
    """Round half away from zero on the scaled float, never giving -0.0.

    ``F.round(value, 2)`` rounds the decimal text instead, which turns 1.005 into
    1.01. Scaling first gives 1.00. Plain arithmetic stays in generated code,
    where ``F.round`` allocates a BigDecimal per row.
    """
    ratio = F.lit(float(10**precision))
    raised = F.abs(value * ratio) + F.lit(BELOW_HALF)
    rounded = F.signum(value) * (raised - raised % F.lit(1.0)) / ratio
    # An infinity has no fraction to cut off and stays as it is.
    return F.nanvl(rounded, value) + F.lit(0.0)


def parse_float_lenient(text: Column) -> Column:
    """Number in ``text``; 0.0 where it is not one. Overflow gives an infinity."""
    parsed = F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))
    return F.coalesce(parsed, F.lit(0.0))


def parse_float_strict(text: Column) -> Column:
    """Number in ``text``; null where it is not one, is empty or overflows."""
    parsed = text.try_cast("double")
    overflow = (F.abs(parsed) == float("inf")) & ~text.rlike(rf"^({NAMED_FLOAT})\z")
    return F.when(text.rlike(FLOAT_TEXT) & ~overflow, parsed)


def fixed_two(value: Column) -> Column:
    """Two decimals of the exact binary value, ties to even: 0.125 gives 0.12."""
    return F.call_function("format_number", value, F.lit("0.00"))


def json_number(value: Column) -> Column:
    """Shortest JSON text of a finite double: plain digits from 1e-6 up to 1e21.

    Whole numbers have no fraction; other sizes have an exponent such as ``1e-7``.
    """
    text = value.cast("string")
    whole = F.abs(value) < F.lit(1e15)
    mantissa = F.regexp_replace(F.regexp_extract(text, "^([^E]*)", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, "E(-?[0-9]+)$", 1)
    scientific = F.concat(
        mantissa, F.lit("e"), F.when(~exponent.startswith("-"), "+").otherwise(""), exponent
    )
    # Casting a decimal gives plain digits: 22 places hold 17 digits from 1e-6 on.
    small, large = text.cast("decimal(38,28)"), text.cast("decimal(38,16)")
    plain = F.when(F.abs(value) < F.lit(1.0), small.cast("string")).otherwise(large.cast("string"))
    plain = F.regexp_replace(plain, r"\.?0+$", "")
    size = F.abs(value)
    return (
        F.when((value == F.floor(value)) & whole, value.cast("bigint").cast("string"))
        .when((size < F.lit(1e-6)) | (size >= F.lit(1e21)), scientific)
        .when(size >= F.lit(1e15), text.cast("decimal(38,0)").cast("string"))
        .when(F.contains(text, F.lit("E")), plain)
        .otherwise(text)
    )


def marker_radius(count: Column) -> Column:
    """Display radius of a location: its count held within 5..20."""
    return F.greatest(F.lit(5), F.least(F.lit(20), count)).cast("bigint")
