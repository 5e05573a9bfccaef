"""Applying proposed changes, the audit trail and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

ALLOWED = ["phone", "street", "unit", "city", "state", "zip", "specialty", "is_active"]


def blocked() -> Column:
    """High-stakes rows, renaming and deactivating, that are never applied without a human, whatever their decision says."""
    off = (F.col("field") == "is_active") & (F.col("old_value") == "1") & (F.col("new_value") == "0")
    return F.coalesce((F.col("decision") == "AUTO_UPDATE") & ((F.col("field") == "name") | off), F.lit(False))


def route(changes: DataFrame) -> DataFrame:
    """New changes with status applied, pending_review or (a field that may not be set) still new."""
    auto = (F.col("decision") == "AUTO_UPDATE") & ~blocked()
    return changes.filter("status = 'new'").withColumn("blocked", blocked()).withColumn(
        "status", F.when(~auto, "pending_review").when(F.col("field").isin(ALLOWED), "applied").otherwise("new"))


def merge(providers: DataFrame, routed: DataFrame, now: Column) -> DataFrame:
    """The directory with applied changes; of several changes of a field the one with the last id wins. updated_at moves
    for touched rows only. Zips are stored as five digits."""
    value = F.when(F.col("field") == "zip", N.zip5(F.col("new_value"))).otherwise(F.col("new_value"))
    sets = (routed.filter("status = 'applied'").groupBy("npi").pivot("field", ALLOWED)
            .agg(F.max_by(value, F.col("id"))).select("npi", *[F.col(f).alias(f"_{f}") for f in ALLOWED], F.lit(True).alias("_hit")))
    out = providers.join(sets, "npi", "left")
    made = {f: F.coalesce(F.col(f"_{f}").try_cast(providers.schema[f].dataType), F.col(f)) for f in ALLOWED if f in providers.columns}
    return out.withColumns(made | {"updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}).select(providers.columns)


def audit(routed: DataFrame) -> DataFrame:
    detail = F.concat(F.col("field"), F.lit(": '"), F.coalesce("old_value", F.lit("")), F.lit("' → '"), F.col("new_value"), F.lit("' (from "), F.col("source"), F.lit(")"),
                      F.when(F.col("blocked"), " [blocked auto: high-stakes]").otherwise(""))
    return routed.filter("status <> 'new'").select("npi", F.when(F.col("status") == "applied", "AUTO_UPDATED").otherwise("FLAGGED_REVIEW").alias("action"), detail.alias("detail"))


def counts(routed: DataFrame) -> DataFrame:
    return routed.agg(F.count_if(F.col("status") == "applied").alias("applied"), F.count_if(F.col("status") == "pending_review").alias("pending"), F.count_if(F.col("status") == "new").alias("skipped"))


def pending(routed: DataFrame) -> DataFrame:
    """Changes that wait for a human."""
    return routed.filter("status = 'pending_review'")


def review_queue(routed: DataFrame, providers: DataFrame) -> DataFrame:
    """Pending changes, surest first, with the record's name."""
    names = providers.select("npi", "name")
    return (pending(routed).join(names, "npi", "left").withColumn("name", F.coalesce("name", F.lit("(unknown)")))
            .select("id", "npi", "name", "field", "old_value", "new_value", "source", "confidence", "reason").orderBy(F.desc("confidence"), "id"))


def tally(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending, approved and rejected; queue: by id, such as pending() or review_queue(); decisions: id of the change, decision."""
    return queue.join(decisions.select("id", "decision"), "id", "left").groupBy(F.coalesce("decision", F.lit("pending")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))
