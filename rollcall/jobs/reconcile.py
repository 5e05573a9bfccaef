"""Reconcile a directory with its sources:

python -m rollcall.jobs.reconcile --out DIR --source NAME=[KIND:]PATH [--source ...] [--providers DIR] [--run ID] [--as-of TIME] [--least-score N]

The directory is the table DIR/providers; --providers is read instead where DIR has none yet. Kinds of sources are those of
sources.adapters.KINDS (rows, registry, enrollment, ...). Of the tables below DIR it replaces the sources' parts of
external_data, adds the run's part to proposed_changes, source_errors, pull_sketches (rows and mergeable distinct counts of
each source) and providers_audit_log, rewrites the touched buckets
of providers, and writes review_queue (all pending changes of all runs) as JSON lines.

A source that fails contributes nothing and is reported. A pull whose quality score is below the least, and an empty
directory, are refused before anything is written. A run's id given again replaces what that run has written; a run that
has ended does nothing.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import apply, intake, quality, reconcile
from ..sources import adapters, records, tables
from . import moment, new_run, providers_table, session, staged, staging, table


def run(spark: SparkSession, sources: list[adapters.Source], out: str, now: Column, run_id: str | None = None, providers: DataFrame | None = None, least_score: int = 60) -> dict[str, DataFrame | dict]:
    """The tables as they are afterwards, and counts: applied, pending, skipped and conflicts, observed while writing."""
    run_id = run_id or new_run()
    directory = providers_table(spark, out)
    external, changes, errors, log = (table(spark, out, n) for n in ("external_data", "proposed_changes", "source_errors", "providers_audit_log"))
    counts: dict[str, int] = {}
    if not directory.has_run(run_id):
        with staging(spark, out) as folder:
            if not directory.exists():
                if providers is None:
                    raise ValueError("no provider was loaded")
                directory.add(reconcile.with_digests(intake.require_rows(providers)))
            stored = intake.require_rows(directory.colocated())
            stored = stored if "digests" in stored.columns else reconcile.with_digests(stored)
            pulled = adapters.pull(spark, sources, folder, now)
            verdict = quality.verdict(quality.checks(pulled.rows)).first()
            if verdict["score"] < least_score:
                raise ValueError(f"the pull scores {verdict['score']} of 100 ({verdict['verdict']}), below {least_score}")
            # A source that was read without rows has none now; one that failed keeps its part but isn't consulted.
            external.replace({name: pulled.rows.filter(F.col("source_name") == name) for name in pulled.read})
            lost = {s.name for s in sources} - set(pulled.read)
            known = external.read(*[k for k in external.manifest()["parts"] if k not in lost]) if set(external.manifest()["parts"]) - lost else pulled.rows
            table(spark, out, "pull_sketches").replace({run_id: quality.sketches(pulled.rows, "source_name").withColumns({"run_id": F.lit(run_id), "timestamp": now})})
            errors.replace({run_id: pulled.errors.withColumns({"run_id": F.lit(run_id), "timestamp": now})})
            # Of both sides only digests are read, and values of rows that differ: of all rows, if that is most of them.
            some = Observation()
            rows = staged(reconcile.differing(stored, known).observe(some, F.count(F.lit(1)).alias("n")), folder, "differing")
            most = 2 * some.get["n"] > known.count()
            found = reconcile.candidates(stored, known) if most else reconcile.early_candidates(stored, known, found=rows)
            found = reconcile.proposed(reconcile.score(found))
            # Written once: status, audit, queue and merge all start from the same decisions.
            seen = Observation()
            status = lambda s: F.count_if(F.col("status") == s)
            routed = staged(apply.route(found).observe(seen, status("applied").alias("applied"), status("pending_review").alias("pending"), status("new").alias("skipped"),
                                                       F.count_if(F.col("reason").contains("conflict")).alias("conflicts")), folder, "routed")
            counts = seen.get
            changes.replace({run_id: routed.withColumns({"created_at": now, "run_id": F.lit(run_id)})})
            log.replace({run_id: apply.audit(routed).withColumns({"run_id": F.lit(run_id), "timestamp": now})})
            # Last: until then the run can be repeated.
            directory.rewrite(routed.filter("status = 'applied'"), lambda rows: reconcile.with_digests(apply.merge(rows.drop("digests"), routed, now)), run_id)
            records.write_json(apply.review_queue(changes.read(), directory.read()), f"{out}/review_queue")
    return {"external_data": external.read(), "proposed_changes": changes.read(), "source_errors": errors.read(), "providers": directory.read(), "providers_audit_log": log.read(), "counts": counts}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--providers")
    p.add_argument("--source", action="append", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--run")
    p.add_argument("--as-of")
    p.add_argument("--least-score", type=int, default=60)
    a = p.parse_args(argv)
    spark = session("reconcile")
    run_id = a.run or new_run()
    providers = tables.read_any(spark, a.providers) if a.providers else None
    done = run(spark, [adapters.parse(s) for s in a.source], a.out, moment(a.as_of), run_id, providers, a.least_score)
    print(done["counts"] or "this run has already ended")
    done["source_errors"].filter(F.col("run_id") == run_id).groupBy("source_name", "error").count().show()


if __name__ == "__main__":
    main()
