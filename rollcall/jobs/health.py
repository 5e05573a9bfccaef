"""Directory health: python -m rollcall.jobs.health --providers DIR --external DIR --out DIR [--as-of TIME]

Writes each detector's rows as Parquet, and `counts` of them. Keys are made once for all detectors that need them.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from ..sources import records, tables
from . import moment, session, staged, staging


def run(spark: SparkSession, providers: DataFrame, external: DataFrame, out: str, now: Column) -> DataFrame:
    with staging(spark, out) as folder:
        keys = staged(detect.keyed(providers), folder, "keyed")
        found = detect.report(providers, external, now, keys)
        counts = {}
        for name, df in found.items():
            seen = Observation()
            records.write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{out}/{name}")
            counts[name] = seen.get["n"]
    records.write_table(spark.createDataFrame(list(counts.items()), "detector string, n long"), f"{out}/counts")
    return spark.read.parquet(f"{out}/counts")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    for x in ("--providers", "--external", "--out"):
        p.add_argument(x, required=True)
    p.add_argument("--as-of")
    a = p.parse_args(argv)
    spark = session("health")
    run(spark, tables.read_any(spark, a.providers), tables.read_any(spark, a.external), a.out, moment(a.as_of)).show()


if __name__ == "__main__":
    main()
