"""Nested columns as JSON text: keys in order at every depth, numbers spelled as Python's json module does, secrets masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = '"<redacted>"'  # fixed value


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def number_text(c: Column) -> Column:
    """A floating-point number as Python spells it: plain from 0.0001 to below 1e16, else with an exponent of two digits or more."""
    text = F.abs(c).cast("double").cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), r"\.", "")
    power = F.when(text.contains("E"), F.substring_index(text, "E", -1)).otherwise("0").cast("int")
    shown = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(digits)
    sign = F.when(power < 0, "-").otherwise("+")
    spelled = F.concat(shown, F.lit("e"), sign, F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    long = F.length(digits) > power + 1
    large = F.when(long, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))).otherwise(F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0")))
    out = F.when(~text.contains("E"), text).when(power.between(-4, -1), small).when(power.between(0, 15), large).otherwise(spelled)
    minus = F.when((c < 0) | c.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(c), "NaN").when(F.abs(c).cast("double") == F.lit(float("inf")), F.concat(minus, F.lit("Infinity"))).otherwise(F.concat(minus, out))


def json_text(c: Column, kind: T.DataType, secret: str | None = None) -> Column:
    """A column of any nested type as compact JSON.

    Fields and map keys stand in order at every depth. Where a key matches ``secret``, the whole value below it is
    masked. Types that JSON lacks (decimals, dates, times) are texts; keys of a map count as texts.
    """
    hidden = lambda key: F.lower(key).rlike(secret) if secret else F.lit(False)
    if isinstance(kind, T.StructType):
        fields = [F.concat(quoted(F.lit(f.name)), F.lit(":"), F.when(hidden(F.lit(f.name)), MASK).otherwise(json_text(c.getField(f.name), f.dataType, secret))) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.MapType):
        key = lambda e: e["key"].cast("string")
        pairs = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(key(e).alias("k"), F.when(hidden(key(e)), MASK).otherwise(json_text(e["value"], kind.valueType, secret)).alias("v"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["k"]), F.lit(":"), p["v"])), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(x, kind.elementType, secret)), ","), F.lit("]"))
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        text = c.cast("string")
    elif isinstance(kind, T.FloatType | T.DoubleType):
        text = number_text(c)
    elif isinstance(kind, T.VariantType):
        text = F.to_json(c)  # keeps its fields in order
    else:
        text = quoted(c.cast("string"))
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("null"))
