"""Identifier and record checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import strip


def valid_npi(npi: Column) -> Column:
    """Ten digits beginning with 1 or 2 whose Luhn check holds under the 80840 prefix. False for null."""
    text = strip(npi.cast("string"))
    return F.coalesce(F.when(text.rlike("^[12][0-9]{9}$"), F.call_function("luhn_check", F.concat(F.lit("80840"), text))), F.lit(False))


def luhn_digit(nine: Column) -> Column:
    """The tenth digit that makes nine digits a valid identifier."""
    d = [F.substring(nine, i, 1).cast("int") for i in range(1, 10)]
    doubled = sum((2 * x - F.when(x > 4, 9).otherwise(0) for x in d[0::2]), F.lit(24))
    return (10 - (doubled + sum(d[1::2], F.lit(0))) % 10) % 10


def rejection(npi: Column, name_compare: Column, min_letters: int = 2) -> Column:
    """Why a record can't be taken in; null if it can. The loose registry gate passes min_letters=1."""
    return (F.when(~valid_npi(npi), F.lit("Invalid NPI"))
            .when(F.length(F.replace(F.coalesce(name_compare, F.lit("")), F.lit(" "), F.lit(""))) < min_letters, F.lit("Invalid name (too short / empty)")))


def violations(npi: Column, name: Column, is_active: Column, state: Column, zip5: Column) -> Column:
    """Names of the table constraints that a row breaks."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    checks = {
        "npi": ~F.coalesce(npi.rlike("^[0-9]{10}$"), F.lit(False)),
        "name": blank(strip(name)),
        "is_active": ~F.coalesce(is_active.isin(0, 1), F.lit(False)),
        "state": ~(blank(state) | (F.length(state) == 2)),
        "zip": ~(blank(zip5) | F.coalesce(zip5.rlike("^[0-9]{5}$"), F.lit(False))),
    }
    return F.filter(F.array(*[F.when(bad, F.lit(k)) for k, bad in checks.items()]), lambda x: x.isNotNull())
