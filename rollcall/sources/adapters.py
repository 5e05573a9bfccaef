"""Sources as descriptors, read so that one that fails doesn't end the run.

Each source is read on its own into a staging folder. A source that can't be read at all (no such path, unreadable files,
columns that its shape needs and that aren't there) contributes nothing and is named with its error; a record that doesn't
fit its source's schema becomes an error row with its text, and the source's other records count.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order, reconcile
from . import records, tables

EXTERNAL = ["npi", "source_name", "ordinal", *records.FIELDS]
BAD = "_corrupt_record"
AT_ONCE = 8  # sources read at the same time


@dataclass(frozen=True)
class Source:
    """Where a source's records are and how they become source rows.

    format: parquet, json (lines) or csv (with a header). schema: of its records (json; csv takes the header's names, as
    text). lines: records as text in a column `value`, in place of a path, for json. shape: from records, numbered by a
    column `ordinal`, to rows with npi and any of records.FIELDS.
    """

    name: str
    path: str = ""
    format: str = "parquet"
    schema: str | None = None
    shape: Callable[[DataFrame], DataFrame] | None = None
    options: dict = field(default_factory=dict)
    lines: DataFrame | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        """The records, in BAD those that don't fit the schema; columns _file, _start and _row tell their order."""
        if self.lines is not None:
            made = F.from_json("value", f"{self.schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, **self.options})
            df = self.lines.select("value", made.alias("_r")).select("_r.*", F.col("value").alias("_file"), F.lit(0).cast("long").alias("_start"))
            return df.withColumn("_row", F.lit(0).cast("long"))
        reader = spark.read.options(**self.options)
        if self.format == "json":
            df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).schema(f"{self.schema}, {BAD} string").json(self.path)
        elif self.format == "csv":
            names = reader.option("header", True).csv(self.path).columns
            schema = ", ".join(f"`{n.strip().lower()}` string" for n in names)
            df = reader.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).schema(f"{schema}, {BAD} string").csv(self.path)
        else:
            df = tables.read_any(spark, self.path) if self.format == "parquet" else reader.format(self.format).load(self.path)
            df = df.withColumn(BAD, F.lit(None).cast("string"))
        return df.withColumns({"_file": F.input_file_name(), "_start": F.input_file_block_start(), "_row": F.monotonically_increasing_id()})


@dataclass(frozen=True)
class Pull:
    """rows: EXTERNAL, fetched_at and reconcile.with_digest()'s columns; errors: source_name, error, record; failed: `name(error: KIND)` of the sources that gave
    nothing because of an error; read: names of the others."""

    rows: DataFrame
    errors: DataFrame
    failed: list[str]
    read: list[str]


def kind(e: Exception) -> str:
    """What went wrong, in a word or two."""
    condition = e.getCondition() if isinstance(e, PySparkException) else None
    return condition.split(".")[0] if condition else type(e).__name__


def _rows(df: DataFrame, name: str, now: Column) -> DataFrame:
    kinds = {c: "int" if c == "is_active" else "string" for c in records.FIELDS}
    made = {c: (F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)) for c, t in kinds.items()}
    return df.withColumns(made | {"npi": F.col("npi").cast("string"), "source_name": F.lit(name), "fetched_at": now}).select(*EXTERNAL, "fetched_at")


def pull(spark: SparkSession, sources: list[Source], folder: str, now: Column) -> Pull:
    """Read all sources. Ordinals are one order over all of them: the sources as given, and in each its own `ordinal`, or
    else files by name and records as they stand there. folder: for staging, a new one each time; rows are read from it."""
    def stage(i: int) -> tuple[DataFrame, int] | Exception:
        """The source's records in order, numbered from 0."""
        try:
            df = sources[i].load(spark)
            by = (["ordinal"] if "ordinal" in df.columns else []) + ["_file", "_start", "_row"]
            return order.numbered(df, by, f"{folder}/records-{i}", out="_place")
        except (PySparkException, Py4JJavaError) as e:
            return e

    def shape(i: int, staged: tuple[DataFrame, int], start: int) -> DataFrame | Exception:
        """The source's rows, written, since what its shape does may fail only then."""
        df, _ = staged
        try:
            good = df.filter(F.col(BAD).isNull()).withColumn("ordinal", F.col("_place") + start).drop(BAD, "_file", "_start", "_row", "_place")
            rows = reconcile.with_digest(_rows(sources[i].shape(good) if sources[i].shape else good, sources[i].name, now))
            rows.write.parquet(f"{folder}/rows-{i}")
            return spark.read.schema(rows.schema).parquet(f"{folder}/rows-{i}")
        except (PySparkException, Py4JJavaError) as e:
            return e

    with ThreadPoolExecutor(AT_ONCE) as pool:
        staged = list(pool.map(stage, range(len(sources))))
        starts, n = [], 0
        for s in staged:
            starts.append(n)
            n += 0 if isinstance(s, Exception) else s[1]
        shaped = list(pool.map(lambda i: staged[i] if isinstance(staged[i], Exception) else shape(i, staged[i], starts[i]), range(len(sources))))
    none = ", ".join(f"{c} {'long' if c == 'ordinal' else 'int' if c == 'is_active' else 'string'}" for c in EXTERNAL)
    rows, wrong, failed, read = [reconcile.with_digest(_rows(spark.createDataFrame([], none), "", now)).filter("false")], [], [], []
    said = "source_name string, error string, record string"
    for source, records_, result in zip(sources, staged, shaped, strict=True):
        if isinstance(result, Exception):
            failed.append(f"{source.name}(error: {kind(result)})")
            wrong.append(spark.createDataFrame([(source.name, kind(result), None)], said))
            continue
        rows.append(result)
        read.append(source.name)
        wrong.append(records_[0].filter(F.col(BAD).isNotNull()).select(F.lit(source.name).alias("source_name"), F.lit("BAD_RECORD").alias("error"), F.col(BAD).alias("record")))
    return Pull(tables.union(rows), tables.union([spark.createDataFrame([], said), *wrong]), sorted(failed), read)


#: Known kinds of sources: format, schema, shape, options.
KINDS = {
    "rows": ("parquet", None, None, {}),
    "registry": ("json", records.REGISTRY, lambda df: records.flatten_registry(df.filter("enumeration_type = 'NPI-1'")), {}),
    "enrollment": ("csv", None, lambda df: records.enrollment_rows(records.enrollment_columns(df)), {}),
    "enrollment_json": ("json", records.ENROLLMENT, records.enrollment_rows, {}),
    "extraction": ("json", f"npi string, extraction struct<{records.EXTRACTION.replace(' string', ': string')}>", lambda df: records.extraction_rows(df.withColumn("extraction", F.to_json("extraction"))), {}),
}


def parse(text: str) -> Source:
    """NAME=PATH or NAME=KIND:PATH, with a kind of KINDS."""
    name, place = text.split("=", 1)
    k, _, path = place.partition(":")
    if k not in KINDS:
        k, path = "rows", place
    form, schema, shape, options = KINDS[k]
    return Source(name, path, form, schema, shape, options)
