"""The 100-point quality score of a source pull, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["npi", "phone", "city", "state"]
SKETCH = 18  # log2 of a sketch's registers: a standard error of 0.2 %, 256 KB at most


def checks(df: DataFrame, expected: int = 800, approximate: bool = False) -> DataFrame:
    """check, points, full: one row for each of the seven checks. approximate: estimate the distinct identifiers."""
    have = [c for c in KEYS if c in df.columns]
    blank = [F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "") for c in have]
    npi = "npi" in have
    distinct = (F.approx_count_distinct("npi", 0.005) if approximate else F.count_distinct("npi")) if npi else F.lit(0)
    one = df.agg(F.count(F.lit(1)).alias("n"), (distinct + (F.max(F.when(F.col("npi").isNull(), 1).otherwise(0)) if npi else F.lit(0))).alias("d"),
                 sum(blank, F.lit(0)).alias("blank"), (F.count_if(~F.coalesce(F.col("npi").rlike("^[0-9]{10}$"), F.lit(False))) if npi else F.lit(0)).alias("bad"))
    n = F.col("n")
    share = lambda x, of: F.when(of > 0, x / of).otherwise(0.0)
    part = lambda full, x: F.greatest(F.lit(0), F.bround(full * x, 0).cast("int"))
    gaps, twice, bad = share(F.col("blank"), n * len(have)), F.when(n > 0, 1 - F.col("d") / n).otherwise(0.0), share(F.col("bad"), n)
    points = [
        ("no errors", F.when(n > 0, 20).otherwise(0), 20),
        ("row count", F.when(n >= expected, 15).otherwise(part(15, n / expected) if expected else F.lit(0)), 15),
        ("key columns", F.lit(round(15 * len(have) / len(KEYS))), 15),
        ("missing values", F.when(gaps <= 0.05, 15).otherwise(part(15, 1 - gaps)), 15),
        ("duplicates", F.when(twice <= 0.02, 15).otherwise(part(15, 1 - twice)) if npi else F.lit(0), 15),
        ("value format", F.when(bad <= 0.02, 10).otherwise(part(10, 1 - bad)) if npi else F.lit(5), 10),
        ("date", F.lit(10 if "fetched_at" in df.columns else 0), 10),
    ]
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), p.cast("int").alias("points"), F.lit(full).alias("full_points")) for k, p, full in points])))


def verdict(checked: DataFrame) -> DataFrame:
    total = checked.agg(F.sum("points").cast("int").alias("score"))
    return total.select("score", F.when(F.col("score") >= 85, "healthy").when(F.col("score") >= 60, "has notes").otherwise("broken").alias("verdict"))


def sketches(df: DataFrame, *by: str) -> DataFrame:
    """A row for each group of `by` (say source_name and the pull): n rows, and a mergeable sketch of their distinct
    identifiers, to be stored. Null identifiers are in n alone; a group of nothing but them has a null sketch."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.count("npi") > 0, F.hll_sketch_agg("npi", F.lit(SKETCH))).alias("sketch"))


def distinct_identifiers(stored: DataFrame, *by: str) -> DataFrame:
    """n rows and about how many distinct identifiers, over all stored sketches of each group of `by`: pulls are merged
    without reading their rows again, and an identifier that several have counts once."""
    merged = stored.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, "n", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("identifiers"))
