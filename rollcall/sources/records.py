"""Readers and flatteners of source records, and the writers of results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import strip

REGISTRY = ("number string, enumeration_type string, basic struct<first_name: string, last_name: string, status: string>, "
            "taxonomies array<struct<code: string, desc: string, primary: boolean>>, "
            "addresses array<struct<address_purpose: string, address_1: string, address_2: string, city: string, state: string, "
            "postal_code: string, telephone_number: string>>")
ENROLLMENT = ("npi string, provider_first_name string, provider_last_name string, telephone_number string, adr_ln_1 string, adr_ln_2 string, "
              "ln_2_sprs string, citytown string, state string, zip_code string, pri_spec string")
INTAKE = "npi string, name string, error_type string, expected_valid string"
EXTRACTION = "name string, phone string, street string, city string, state string, zip string, specialty string"
FIELDS = ["name", "phone", "street", "city", "state", "zip", "specialty", "is_active"]


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def read_registry(spark: SparkSession, path: str, taxonomy: str | None = None, state: str | None = None, cities: list[str] | None = None,
                  target: int | None = None) -> DataFrame:
    """Registry records of individuals, by taxonomy description, state and cities of any address; `target` of them at most."""
    df = spark.read.schema(REGISTRY).json(path).filter(F.col("enumeration_type") == "NPI-1")
    if taxonomy:
        df = df.filter(F.exists("taxonomies", lambda t: F.lower(t["desc"]).contains(taxonomy.lower())))
    if state:
        df = df.filter(F.exists("addresses", lambda a: F.upper(a["state"]) == state.upper()))
    if cities:
        df = df.filter(F.exists("addresses", lambda a: F.upper(a["city"]).isin([c.upper() for c in cities])))
    return df if target is None else df.limit(target)


def _first(array: str, *tests: Callable[[Column], Column]) -> Column:
    """The first element that meets the first test that any element meets."""
    return F.coalesce(*[F.get(F.filter(array, t), F.lit(0)) for t in tests])


def flatten_registry(df: DataFrame) -> DataFrame:
    """One wide row a registry record: name, primary (or first) taxonomy, status, phone and practice address."""
    any_ = lambda x: F.lit(True)
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    here = lambda a: F.coalesce(a["address_purpose"] == "LOCATION", F.lit(False))
    tax = _first("taxonomies", lambda t: F.coalesce(t["primary"], F.lit(False)), any_)
    phone = _first("addresses", lambda a: here(a) & full(a["telephone_number"]), lambda a: full(a["telephone_number"]))
    place = _first("addresses", here, any_)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return df.withColumns({"_t": tax, "_p": phone, "_a": place}).select(
        *[c for c in ("ordinal",) if c in df.columns], F.col("number").alias("npi"), strip(F.concat_ws(" ", empty(F.col("basic.first_name")), empty(F.col("basic.last_name")))).alias("name"),
        empty(F.col("_t.code")).alias("taxonomy_code"), empty(F.col("_t.desc")).alias("specialty"),
        F.when(F.upper(F.col("basic.status")) == "D", 0).otherwise(1).alias("is_active"), empty(F.col("_p.telephone_number")).alias("phone"),
        F.concat(empty(F.col("_a.address_1")), F.when(full(F.col("_a.address_2")), F.concat(F.lit(" "), F.col("_a.address_2"))).otherwise("")).alias("street"),
        empty(F.col("_a.city")).alias("city"), empty(F.col("_a.state")).alias("state"), empty(F.col("_a.postal_code")).alias("zip"))


def enrollment_columns(df: DataFrame) -> DataFrame:
    """The columns of ENROLLMENT, by name, of a file that may have more; those it lacks are null, but npi must be there."""
    names = [f.split()[0] for f in ENROLLMENT.split(", ")]
    return df.select("npi", "ordinal", *[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names[1:]])


def enrollment_rows(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Enrollment rows as source rows: one an identifier (the first), no specialty, blanks as null, all-blank rows gone."""
    # Of each identifier the row with the least ordinal, by partial aggregates.
    df = df.groupBy("npi").agg(F.min_by(F.struct(*[c for c in df.columns if c != "npi"]), ordinal).alias("_r")).select("npi", "_r.*")
    street = F.concat_ws(" ", blank_to_null(F.col("adr_ln_1")), F.when(F.upper(strip(F.col("ln_2_sprs"))) != "Y", blank_to_null(F.col("adr_ln_2"))))
    out = df.select(
        "npi", F.lit("cms").alias("source_name"), F.col(ordinal).alias("ordinal"),
        F.nullif(F.concat_ws(" ", blank_to_null(F.col("provider_first_name")), blank_to_null(F.col("provider_last_name"))), F.lit("")).alias("name"),
        blank_to_null(F.col("telephone_number")).alias("phone"), F.nullif(street, F.lit("")).alias("street"),
        blank_to_null(F.col("citytown")).alias("city"), blank_to_null(F.col("state")).alias("state"), blank_to_null(F.col("zip_code")).alias("zip"))
    return out.filter(F.coalesce("name", "phone", "street", "city", "state", "zip").isNotNull())


def extraction_rows(df: DataFrame, json: str = "extraction") -> DataFrame:
    """Extracted JSON as practice-site source rows; blank fields are null and internal keys don't become fields."""
    x = df.withColumn("_x", F.from_json(json, EXTRACTION))
    names = [f.split()[0] for f in EXTRACTION.split(", ")]
    return x.select("npi", F.lit("practice_site").alias("source_name"), "ordinal", *[blank_to_null(F.col(f"_x.{n}")).alias(n) for n in names])


def extract_fields(df: DataFrame, text: str = "text", batch_function=None, schema: str | None = None) -> DataFrame:
    """Directory fields in free text, copied as written ('' where missing).

    The default is regular expressions; batch_function (pandas batches in and out, see mapInPandas) takes its place.
    """
    if batch_function:
        return df.mapInPandas(batch_function, schema)
    take = lambda pattern, i=0: F.regexp_extract(F.coalesce(F.col(text), F.lit("")), pattern, i)
    return df.withColumns({
        "phone": F.trim(take(PHONE)), "zip": take(PLACE, 3), "state": take(PLACE, 2), "city": take(PLACE, 1), "street": take(STREET)})


PHONE = r"\+?1?[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"
PLACE = r"([A-Z][a-z]+(?: [A-Z][a-z]+)?), ([A-Z]{2}) ([0-9]{5})"
STREET = r"[0-9]+ (?:[A-Z][a-z]+ )+(?:St|Ave|Blvd|Rd|Dr|Ln|Street|Avenue)"


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Any number of adapters' rows as one candidate table; an adapter with nothing adds nothing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources.values())


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition: str | None = None) -> None:
    """Parquet; with a partition column, overwriting replaces only the partitions that df has."""
    w = df.write.mode(mode)
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_intake(spark: SparkSession, path: str) -> DataFrame:
    """Intake CSV, all strings: an inferred schema would lose leading zeros."""
    return spark.read.option("header", True).schema(INTAKE).csv(path)
