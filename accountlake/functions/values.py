"""Values as a destination wants them, and values as a comparison sees them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from accountlake.functions.text import blank_to_null, col, strip

# Destinations that take checkbox values as the words "true" and "false".
TEXT_BOOLEANS = frozenset(("hubspot",))


def list_text(c: Column | str) -> Column:
    items = F.transform(col(c), lambda x: x.cast("string"))
    return F.when(F.size(items) > 0, F.array_join(items, "; "))


def iso_datetime(c: Column | str) -> Column:
    """ISO-8601 in UTC; the fraction appears only when there is one."""
    c = col(c).cast("timestamp")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.concat(
        whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.date_format(c, "xxx")
    )


def text_value(c: Column | str) -> Column:
    c = col(c).cast("string")
    return F.when(strip(c) != "", c)


def coerce(c: Column, data_type: T.DataType, value_type: str, destination: str) -> Column:
    """One result field as the destination's property value; null means "leave out"."""
    if value_type == "list":
        return list_text(c) if isinstance(data_type, T.ArrayType) else blank_to_null(c.cast("string"))
    if value_type == "boolean":
        flag = c.cast("boolean")
        return flag.cast("string") if destination in TEXT_BOOLEANS else flag
    if value_type == "number":
        return c if isinstance(data_type, T.NumericType) else c.cast("double")
    if value_type == "datetime":
        is_time = isinstance(data_type, (T.TimestampType, T.TimestampNTZType))
        return iso_datetime(c) if is_time else c.cast("string")
    return text_value(c)


def plain_text(decimal: Column) -> Column:
    """Exact digits of a decimal, without zeros at the end of its fraction."""
    digits = decimal.cast("string")
    return F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)


def number_text(c: Column) -> Column:
    """A double the way people write it: no trailing zeros, whole numbers without a point.

    Digits are written out where that keeps the value; other numbers stay as Spark prints them, exponent
    and all. So two different doubles never have the same text.
    """
    whole = F.when(c == F.floor(c), c.try_cast("decimal(38,0)").cast("string"))
    digits = c.cast("string").try_cast("decimal(38,18)")
    return F.coalesce(whole, F.when(digits.cast("double") == c, plain_text(digits)), c.cast("string"))


def comparable(c: Column, data_type: T.DataType) -> Column:
    """Text form in which 78 equals "78", true equals "true", and null equals ''."""
    if isinstance(data_type, T.BooleanType):
        text = c.cast("string")
    elif isinstance(data_type, T.DecimalType):
        text = plain_text(c)
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = number_text(c.cast("double"))
    else:
        text = strip(c.cast("string"))
    return F.coalesce(text, F.lit(""))
