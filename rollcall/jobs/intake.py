"""Take records in: python -m rollcall.jobs.intake (--registry JSON | --csv CSV) --out DIR [--existing PROVIDERS] [--run ID] [--as-of TIME]

Adds to the tables below DIR: providers (new identifiers only), providers_quarantine and providers_audit_log (a part a run),
and writes the run's new providers as providers_csv. Records that fail the gate or break a constraint of the table go to
quarantine with the reason; of an identifier the first record that may be stored is. Fails, and writes nothing, if nothing
was loaded. A run's id given again replaces what that run has written; a run that has ended does nothing.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import intake, order, reconcile
from ..sources import records, tables
from . import moment, new_run, providers_table, session, staged, staging, table


def judge(raw: DataFrame, min_letters: int = 2, default_specialty: str = "") -> DataFrame:
    """raw: ordinal and the columns of a source record -> directory rows with clean_name, raw_record and reason."""
    blank = {c: F.lit("") for c in intake.PROVIDER if c not in raw.columns and c not in ("npi", "name", "unit", "is_active")}
    full = raw.withColumns(blank | ({} if "is_active" in raw.columns else {"is_active": F.lit(1)}))
    return intake.gate(intake.clean(full, default_specialty).withColumn("raw_record", F.to_json(F.struct(*full.columns))), min_letters, constrained=True)


def run(spark: SparkSession, raw: DataFrame, out: str, now: Column, run_id: str | None = None, existing: DataFrame | None = None, **options) -> dict[str, DataFrame | dict]:
    """The tables as they are afterwards, and counts: received, accepted, quarantined and duplicates, observed while writing."""
    run_id = run_id or new_run()
    directory, log, bad = providers_table(spark, out), table(spark, out, "providers_audit_log"), table(spark, out, "providers_quarantine")
    counts: dict[str, int] = {}
    if not directory.has_run(run_id):
        with staging(spark, out) as folder:
            seen, stored = Observation(), Observation()
            judged = judge(raw, **options).observe(seen, F.count(F.lit(1)).alias("received"), F.count_if(F.col("reason").isNotNull()).alias("quarantined"))
            judged = staged(judged, folder, "judged")
            held = [d.select("npi") for d in (existing, directory.read() if directory.exists() else None) if d is not None]
            first = intake.accepted(judged, tables.union(held) if held else None).observe(stored, F.count(F.lit(1)).alias("accepted"))
            first = staged(first, folder, "accepted")
            counts = seen.get | stored.get
            if not counts["accepted"]:
                raise ValueError("no provider was loaded")
            counts["duplicates"] = counts["received"] - counts["quarantined"] - counts["accepted"]
            stamp = {"run_id": F.lit(run_id), "timestamp": now}
            bad.replace({run_id: judged.filter("reason is not null").select("ordinal", "npi", "name", "raw_record", F.col("reason").alias("rejection_reason"), F.lit("Rejected").alias("status"),
                                                                              now.alias("created_at"), F.lit(run_id).alias("run_id"))})
            log.replace({run_id: intake.audit(judged, stored=first).withColumns(stamp)})
            new = first.select(*intake.PROVIDER, now.alias("created_at"), now.alias("updated_at"))
            records.write_csv(new, f"{out}/providers_csv")
            directory.add(reconcile.with_digests(new), run_id)  # last: until then the run can be repeated
    return {"providers": directory.read(), "providers_quarantine": bad.read(), "providers_audit_log": log.read(), "counts": counts}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--registry")
    p.add_argument("--csv")
    p.add_argument("--taxonomy")
    p.add_argument("--state")
    p.add_argument("--city", action="append")
    p.add_argument("--target", type=int)
    p.add_argument("--existing")
    p.add_argument("--out", required=True)
    p.add_argument("--run")
    p.add_argument("--as-of")
    a = p.parse_args(argv)
    spark = session("intake")
    place = {"_file": F.input_file_name(), "_start": F.input_file_block_start(), "_row": F.monotonically_increasing_id()}
    if a.registry:
        raw = records.read_registry(spark, a.registry, a.taxonomy, a.state, a.city, a.target).withColumns(place)
    else:
        raw = records.read_intake(spark, a.csv).select("npi", "name").withColumns(place)
    with staging(spark, a.out) as folder:
        raw, _ = order.numbered(raw, list(place), f"{folder}/raw")
        raw = raw.drop(*place)
        existing = tables.read_any(spark, a.existing) if a.existing else None
        done = run(spark, records.flatten_registry(raw) if a.registry else raw, a.out, moment(a.as_of), a.run, existing,
                   min_letters=1 if a.registry else 2, default_specialty=a.taxonomy or "")
    print(done["counts"] or "this run has already ended")


if __name__ == "__main__":
    main()
