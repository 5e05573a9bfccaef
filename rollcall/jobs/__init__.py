"""Jobs to submit: each reads tables by path and writes its results below an output path."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables


def session(name: str) -> SparkSession:
    # Plans are built from many small calls; recording each one's place in the source takes longer than the call.
    return (SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())


def moment(text: str | None) -> Column:
    """The given time, or the present one, without a zone."""
    return F.lit(text).cast("timestamp_ntz") if text else F.current_timestamp().cast("timestamp_ntz")


def new_run() -> str:
    """A name for a run. One that is given again (--run) after a failure replaces what it had written, and nothing else."""
    return uuid.uuid4().hex


@contextlib.contextmanager
def staging(spark: SparkSession, out: str) -> Iterator[str]:
    """A folder for tables that only this run needs; it goes when the run ends."""
    folder = f"{out}/_staging-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written once, for all that start from it."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def providers_table(spark: SparkSession, out: str) -> tables.BucketedTable:
    return tables.BucketedTable(spark, f"{out}/providers", "npi")


def table(spark: SparkSession, out: str, name: str) -> tables.Table:
    """proposed_changes, providers_audit_log and providers_quarantine have a part a run, external_data one a source."""
    return tables.Table(spark, f"{out}/{name}")
