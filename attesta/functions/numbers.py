"""Number, measurement and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.functions.text import compact, normalize_quote


def numbers_in(value: Column) -> Column:
    """Number tokens in order, without thousands commas, sign and inner spaces."""
    found = F.regexp_extract_all(value, F.lit("(" + fv.NUMBER_PATTERN + ")"), F.lit(1))

    def clean(token: Column) -> Column:
        token = F.replace(F.regexp_replace(token, r"(?U)\s+", ""), F.lit(","), F.lit(""))
        token = F.replace(F.replace(token, F.lit("−"), F.lit("-")), F.lit("×"), F.lit("x"))
        return F.regexp_replace(token, r"^\++", "")

    return F.filter(F.transform(found, lambda t: F.regexp_replace(clean(t), r"^-+", "")), lambda t: t != "")


def _close(left: Column, right: Column) -> Column:
    return F.abs(left - right) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(left), F.abs(right))


def ungrounded_numbers(text: Column, quotes: Column) -> Column:
    """Sorted distinct numbers of ``text`` that no quote in the array states."""
    quote_numbers = F.flatten(F.transform(quotes, numbers_in))
    haystack = F.replace(normalize_quote(F.array_join(quotes, " ")), F.lit(","), F.lit(""))

    def grounded(number: Column) -> Column:
        value = number.try_cast("double")
        same_value = F.exists(
            quote_numbers,
            lambda other: F.coalesce(_close(value, other.try_cast("double")), F.lit(False)),
        )
        return F.array_contains(quote_numbers, number) | (F.instr(haystack, number) > 0) | same_value

    return F.array_sort(F.array_distinct(F.filter(numbers_in(text), lambda n: ~grounded(n))))


def shares_number(left: Column, right: Column) -> Column:
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def measurements(value: Column) -> Column:
    """``value unit`` strings for the units where a wrong prefix changes the meaning."""
    values = F.regexp_extract_all(value, F.lit(fv.MEASUREMENT_PATTERN), F.lit(1))
    units = F.regexp_extract_all(value, F.lit(fv.MEASUREMENT_PATTERN), F.lit(2))
    return F.zip_with(values, units, lambda v, u: F.concat_ws(" ", v, u))


def ungrounded_measurements(statement: Column, paper_compact: Column) -> Column:
    missing = F.filter(measurements(statement), lambda m: F.instr(paper_compact, compact(m)) == 0)
    return F.array_sort(F.array_distinct(missing))


def strip_numbers(value: Column) -> Column:
    out = F.regexp_replace(F.coalesce(value, F.lit("")), fv.STRIP_NUMBER_PATTERN, "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return F.trim(F.replace(F.replace(out, F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit(".")))


def strip_numbers_if_ungrounded(text: Column, quotes: Column) -> Column:
    return F.when(F.size(ungrounded_numbers(text, quotes)) > 0, strip_numbers(text)).otherwise(text)


def ratio_units(numerator: Column, denominator: Column, places: int = 4) -> Column:
    """Integer number of 10^-places units in an exact integer ratio, ties to even.

    Works on integers only, so the answer never depends on how a quotient such
    as 0.49875 happens to be stored in binary.
    """
    scaled = numerator.cast("bigint") * 10**places
    whole = _div(scaled, denominator)
    rest = scaled - whole * denominator
    up = (rest * 2 > denominator) | ((rest * 2 == denominator) & (whole % 2 == 1))
    return whole + F.when(up, 1).otherwise(0)


def _div(left: Column, right: Column) -> Column:
    return F.call_function("div", left, right.cast("bigint"))


def ratio(numerator: Column, denominator: Column, places: int = 4) -> Column:
    return ratio_units(numerator, denominator, places) / F.lit(float(10**places))
