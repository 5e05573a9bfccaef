"""Directory health: duplicates, shared locations, moves, inactive and stale records.

Identifiers of a cluster are listed in parts of about BLOCK, so that a name or address that very many records share is
never gathered in one task; ordinary clusters are one part. whole=True lists each in one part, whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N

BLOCK = 10000


def keyed(providers: DataFrame, with_unit: bool = False) -> DataFrame:
    """providers with the normalized keys the detectors share, each made once a row.

    A building is one location, whatever the units of those in it; with_unit=True parts it by them.
    """
    c = F.col
    street = F.concat_ws(" ", c("street"), F.when(c("unit") != "", F.concat(F.lit("Unit "), c("unit")))) if with_unit else c("street")
    return N.derive(providers, {"name_cmp": N.name_compare(c("name")), "phone_cmp": N.phone_compare(c("phone")), "location": N.location_key(street, c("city"), c("state"), c("zip"))})


def _listed(rows: DataFrame, clusters: DataFrame, keys: list[str], size: str, whole: bool) -> DataFrame:
    """clusters with part and npis: the distinct identifiers of their rows, sorted, in parts of about BLOCK or in one."""
    sized = rows.select("npi", *keys).join(clusters, keys)
    part = F.lit(0) if whole else F.pmod(F.xxhash64("npi"), F.ceil(F.col(size) / BLOCK)).cast("int")
    return sized.groupBy(*clusters.columns, part.alias("part")).agg(F.sort_array(F.collect_set("npi")).alias("npis"))


def duplicates(keys: DataFrame, lists: bool = True, whole: bool = False) -> DataFrame:
    """reason, name, n_records, part, npis: same name and phone; then same name and address, unless the same set was
    found by phone. lists=False leaves the identifiers out.

    The name is that of the least identifier. Two sets are the same if their sizes and two 64-bit digests are.
    """
    pairs = F.array(F.struct(F.lit("same name + same phone").alias("reason"), F.nullif(F.col("phone_cmp"), F.lit("")).alias("key")),
                    F.struct(F.lit("same name + same address").alias("reason"), F.when(F.replace("location", F.lit("|"), F.lit("")) != "", F.col("location")).alias("key")))
    rows = keys.filter("name_cmp <> ''").select("npi", "name", "name_cmp", F.inline(pairs)).filter("key is not null")
    by = ["reason", "name_cmp", "key"]
    # A repeated identifier counts once: it is one row of the inner aggregate.
    once = rows.groupBy(*by, "npi").agg(F.min("name").alias("name"))
    digest = [F.bit_xor(F.xxhash64("npi")).alias("_a"), F.bit_xor(F.xxhash64("npi", F.lit(7))).alias("_b")]
    found = once.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), F.min_by("name", "npi").alias("name"), F.min("npi").alias("least"), *digest).filter("n_records > 1")
    same = Window.partitionBy("n_records", "_a", "_b")
    kept = found.withColumn("_phone", F.max(F.col("reason") == "same name + same phone").over(same)).filter("reason = 'same name + same phone' or not _phone")
    if not lists:
        return kept.select("reason", "name", "n_records", "least")
    return _listed(rows.drop("name"), kept.select(*by, "n_records", "name"), by, "n_records", whole).select("reason", "name", "n_records", "part", "npis")


def shared_locations(keys: DataFrame, min_providers: int = 2, lists: bool = True, whole: bool = False) -> DataFrame:
    """location_label, n_providers, part, npis: addresses of several records, most records first, then by label.

    lists=False leaves the identifiers out.
    """
    label = F.concat(F.col("street"), F.lit(", "), F.col("city"), F.lit(" "), F.col("state"))
    rows = keys.filter("replace(location, '|', '') <> ''")
    found = rows.groupBy("location").agg(F.btrim(F.min_by(label, F.col("npi")), F.lit(", ")).alias("location_label"), F.count(F.lit(1)).alias("n_providers")).filter(
        F.col("n_providers") >= min_providers)
    if lists:
        found = _listed(rows, found, ["location"], "n_providers", whole).select("location_label", "n_providers", "part", "npis", "location")
    return found.orderBy(F.desc("n_providers"), "location_label", "location", *(["part"] if lists else [])).drop("location")


def _place(street: Column, city: Column, state: Column, postal: Column) -> Column:
    return F.concat_ws("|", N.street_compare(street), F.lower(N.squish(city)), F.lower(N.state_code(state)), N.zip5(postal))


def moved(providers: DataFrame, external: DataFrame) -> DataFrame:
    """Records that a source places elsewhere; another unit of the same address is no move."""
    c = F.col
    place = _place(c("street"), c("city"), c("state"), c("zip"))
    old = N.derive(providers.select("npi", "name", "street", "city", "state", "zip"), {"a": place}).select("npi", "name", "a", F.concat_ws(", ", "street", "city").alias("old"))
    new = N.derive(external.select("npi", "source_name", "ordinal", "street", "city", "state", "zip"), {"b": place}).select("npi", "source_name", "ordinal", "b", F.concat_ws(", ", "street", "city").alias("new"))
    return old.join(new.filter("replace(b, '|', '') <> ''"), "npi").filter("a <> b").select("npi", "name", F.col("source_name").alias("source"), "ordinal", "old", "new")


def inactive(providers: DataFrame, external: DataFrame) -> DataFrame:
    """Marked inactive in the directory, or reported inactive by a source (once a source)."""
    held = providers.filter("is_active = 0").select("npi", "name", F.lit("marked inactive in directory").alias("reason"))
    said = external.filter("is_active = 0").select("npi", "source_name").distinct().join(providers.select("npi", "name"), "npi")
    return held.unionByName(said.select("npi", "name", F.concat(F.lit("reported inactive by "), F.col("source_name")).alias("reason")))


def stale(providers: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """Not updated within so many days of as_of, oldest first."""
    return providers.filter(F.col("updated_at") < as_of - F.make_interval(days=F.lit(days))).select("npi", "name", "updated_at").orderBy("updated_at", "npi")


def counts(parts: dict[str, DataFrame]) -> DataFrame:
    """detector, n: what each detector found."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("detector"), "n") for k, df in parts.items()])


def leading(parts: dict[str, tuple[DataFrame, list[Column], Column]], top: int = 5) -> DataFrame:
    """detector, place (from 1), item: the first `top` rows of each detector; parts: (rows, order, text of a row).

    Sorting with a limit keeps `top` rows of each task; the window that numbers them sees `top` rows in all.
    """
    out = []
    for k, (df, order, item) in parts.items():
        first = df.orderBy(*order).limit(top)
        out.append(first.select(F.lit(k).alias("detector"), F.row_number().over(Window.orderBy(*order)).alias("place"), item.alias("item")))
    return reduce(DataFrame.unionByName, out)


def report(providers: DataFrame, external: DataFrame, as_of: Column, keys: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows of all five detectors; a cluster is one row. keys: keyed(providers), if it is at hand."""
    keys = keyed(providers) if keys is None else keys
    return {"duplicates": duplicates(keys, lists=False), "shared_locations": shared_locations(keys, lists=False), "moved": moved(providers, external),
            "inactive": inactive(providers, external), "stale": stale(providers, as_of)}
