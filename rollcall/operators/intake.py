"""Intake: clean records, the validity gate, first-wins inserts, quarantine and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import validate as V

PROVIDER = ["npi", "name", "taxonomy_code", "specialty", "is_active", "phone", "street", "unit", "city", "state", "zip"]
PASSED = "Passed validation"  # fixed value


def _npi(c: Column) -> Column:
    """Without white space at the ends; a missing identifier stays missing."""
    return F.when(c.isNotNull(), N.strip(c))


def clean(df: DataFrame, default_specialty: str = "") -> DataFrame:
    """Raw source rows as directory rows; columns not named here are kept."""
    c = F.col
    made = {
        "npi": _npi(c("npi")), "name": N.name_display(c("name")), "taxonomy_code": F.upper(N.strip(c("taxonomy_code"))),
        "specialty": F.coalesce(F.nullif(N.specialty_display(c("specialty")), F.lit("")), F.lit(default_specialty)), "phone": N.phone_display(c("phone")),
        "_street": N.street_forms(c("street")), "city": N.city_display(c("city")), "state": N.state_code(c("state")), "zip": N.zip5(c("zip"))}
    out = N.derive(df, made).withColumns({"unit": c("_street.unit"), "street": c("_street.display")}).drop("_street")
    return out.select([x for x in PROVIDER if x in out.columns] + [x for x in out.columns if x not in PROVIDER])


def gate(df: DataFrame, min_letters: int = 2, constrained: bool = False) -> DataFrame:
    """df with clean_name and reason: why the row can't be taken in, or null. constrained: also by the table's constraints.

    All that speaks against a row is known before the first row of its identifier is chosen, so a row that can't be stored
    never stands in for a later one that can.
    """
    c = F.col
    df = N.derive(df, {"npi": _npi(c("npi")), "_name": N.name_forms(c("name"))})
    reason = V.rejection(c("npi"), c("_name.compare"), min_letters)
    if constrained:
        reason = F.coalesce(reason, _broken())
    return N.derive(df, {"reason": reason, "clean_name": c("_name.display")}).drop("_name")


def accepted(gated: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """First row (least ordinal) of each identifier among those that may be stored, if the directory doesn't hold it yet.

    Partial aggregates keep one row an identifier, so one that very many rows have is neither sorted nor gathered.
    """
    rest = [x for x in gated.columns if x != "npi"]
    first = gated.filter("reason is null").groupBy("npi").agg(F.min_by(F.struct(*rest), "ordinal").alias("_row")).select("npi", "_row.*").select(gated.columns)
    return first if existing is None else first.join(existing.select("npi"), "npi", "left_anti")


def _broken() -> Column:
    c = F.col
    names = V.violations(c("npi"), c("name"), c("is_active"), c("state"), c("zip"))
    return F.nullif(F.concat(F.lit("Constraint failed: "), F.array_join(names, ",")), F.lit("Constraint failed: "))


def constrain(records: DataFrame) -> DataFrame:
    """Directory rows with reason: the table constraints they break, or null for those that may be stored."""
    return N.derive(records, {"reason": _broken()})


def quarantine(gated: DataFrame, raw: list[str]) -> DataFrame:
    return gated.filter(F.col("reason").isNotNull()).select(
        *[x for x in ("ordinal",) if x in gated.columns], "npi", "name", F.to_json(F.struct(*raw)).alias("raw_record"), F.col("reason").alias("rejection_reason"), F.lit("Rejected").alias("status"))


def audit(gated: DataFrame, existing: DataFrame | None = None, stored: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each stored or quarantined record; later copies leave none. stored: accepted(), if it is at hand; more:
    further columns of gated to keep."""
    stored = accepted(gated, existing) if stored is None else stored
    return stored.select("npi", F.lit("ACCEPTED").alias("action"), F.lit(PASSED).alias("detail"), *more).unionByName(
        gated.filter(F.col("reason").isNotNull()).select("npi", F.lit("QUARANTINED").alias("action"), F.col("reason").alias("detail"), *more))


def counters(gated: DataFrame) -> DataFrame:
    """received, accepted, quarantined and duplicates from one group an identifier, all rejected rows being one group."""
    passed = F.col("reason").isNull()
    groups = gated.groupBy(passed.alias("passed"), F.when(passed, F.col("npi")).alias("npi")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return groups.agg(total("n").alias("received"), F.count_if("passed").alias("accepted"), total(F.when(~F.col("passed"), F.col("n"))).alias("quarantined"),
                      total(F.when(F.col("passed"), F.col("n") - 1)).alias("duplicates"))


def totals(**tables: DataFrame) -> DataFrame:
    """table, n: the rows of each table, one partial count each."""
    each = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def require_rows(df: DataFrame) -> DataFrame:
    """Fail fast on an empty load."""
    if df.isEmpty():
        raise ValueError("no provider was loaded")
    return df
