"""Shared helpers of the training-data operators: scratch tables, distributed ranks, components and byte hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

MASK64 = (1 << 64) - 1


# ---------------------------------------------------------------- scratch tables

def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that is unset, a temporary folder if all of Spark
    is on this machine; on a cluster executors wouldn't see it, so that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("rollcall.scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("rollcall.scratch", root)
    return root


def save(df: DataFrame, free: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage with a copy that outlives executors.

    free: also let Spark delete the shuffle files of plans that are no longer referenced. Tables that nobody drops go when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/rollcall-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    if free:
        for _ in range(2):  # the first pass may come before the listeners have let go of the query
            time.sleep(0.4)
            gc.collect()
            spark._jvm.System.gc()
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that save() wrote, once nothing reads it any more."""
    if df is not None and (path := getattr(df, "_scratch", None)):
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def ready(spark: SparkSession, rows: int = 500) -> None:
    """Before Python runs in tasks: ship this package to the executors once, and bound the rows of an Arrow batch,
    so that batches of long texts fit a Python worker."""
    sc = spark.sparkContext
    if not getattr(sc, "_rollcall_shipped", False):
        top = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="spark-")) / "rollcall.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(to))
        sc._rollcall_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, that df has no column of (Spark doesn't tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str):
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_row(df: DataFrame, name: str) -> DataFrame:
    """df with a column that tells its rows apart, the same in every evaluation: a row's file and its place there.

    df is written first unless it is a plain read of files: anything else (a join, an exploded column, a union) may give
    several rows of one row of a file.
    """
    place = lambda d: d.select("*", F.concat_ws("#", F.hex(F.xxhash64(F.col("_metadata.file_path"))), F.col("_metadata.row_index").cast("string")).alias(name))
    return place(df if _plain_read(df) else save(df))


def _plain_read(df: DataFrame) -> bool:
    """Is df one read of files with nothing but filters and projections on it, and the read's own metadata at hand?"""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return False
    return plan.children().isEmpty() and "Relation" in plan.nodeName()


def schema_with(fields, *made: tuple[str, str]) -> StructType:
    """A schema of these fields (any names and types) and, after them, (name, type) columns."""
    return StructType([StructField(f.name, f.dataType) for f in fields] + [StructField(n, StructType.fromDDL(f"x {t}")[0].dataType) for n, t in made])


def tidy() -> None:
    """Give memory that the driver's Python no longer needs back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- ranks

def ranked(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add a gapless 0-based position of each row within its key, by `order`; no key is gathered in one task.

    Rows are range-partitioned by (key, order), so a hot key spans many tasks; each (task, key) run then gets
    the count of the earlier runs of that key as its offset. df should carry few columns: it is written once.
    """
    spark = df.sparkSession
    laid = (df.repartitionByRange(partitions(spark), *[F.col(c) for c in keys + order])
            .sortWithinPartitions(*keys, *order).withColumn("_mid", F.monotonically_increasing_id()))
    laid = save(laid).withColumn("_pid", F.shiftright("_mid", 33))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    runs = laid.groupBy("_pid", *keys).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    both = laid.alias("a").join(runs.alias("b"), (F.col("a._pid") == F.col("b._pid")) & same("a", "b"))
    return both.select(*[F.col(f"a.{c}") for c in df.columns],
                       (F.col("b._before") + F.col("a._mid") - F.col("b._first")).alias(out))


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, comp): comp is the smallest node reachable. Min-label steps with pointer jumping.

    Every round is written to the shared folder; links and labels never leave the executors.
    """
    both = save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("m"))
        step = (labels.join(near, labels.node == near.a)
                .select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")))
        root = labels.select(F.col("node").alias("r"), F.col("comp").alias("rc"))
        step = step.join(root, step.comp == root.r, "left").select(
            "node", "old", F.least("comp", F.coalesce("rc", "comp")).alias("comp"))
        new = save(step)
        changed = new.filter("comp < old").limit(1).count()
        drop(labels)
        labels = new.select("node", "comp")
        labels._scratch = new._scratch
        if not changed:
            drop(both)
            return labels


# ---------------------------------------------------------------- bytes of Arrow batches

def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) as one array, and its n + 1 offsets."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_binary(arr.type):
        arr = pc.fill_null(arr, "").cast(pa.large_string())
    arr = arr.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0]: off[-1]]
    return data, off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20):
    """Slices of a batch with about `most` bytes of text at most (a longer single row stays whole)."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(size)
    lo = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


_BASE = 0x9E3779B97F4A7C15
_pow = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_pow.get("p", ())) < n:
        m = max(n, 1 << 16)
        for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            x = np.full(m, base, dtype=np.uint64)
            x[0] = 1
            _pow[name] = np.cumprod(x, dtype=np.uint64)
    return _pow["p"][:n], _pow["q"][:n]


_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash depend on all bytes."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Prefix:
    """Polynomial prefix hashes of a byte array: the hash of any [s, e) in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self.q = _powers(n + 1)
        self.s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * p[:n], out=self.s[1:])

    def raw(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.s[e] - self.s[s]) * self.q[s]

    def grams(self, k: int) -> np.ndarray:
        """mix of every k-byte window."""
        n = len(self.s) - k
        return mix((self.s[k:] - self.s[:n]) * self.q[:n]) if n > 0 else np.zeros(0, np.uint64)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[:128] = True
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def words(data: np.ndarray, off: np.ndarray, punct: bool = False, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in text order.

    punct: any ASCII byte but letters and digits parts words. heads: also the first so many bytes of longer words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = _LOWER[data]
    gap = (_PUNCT if punct else _SPACE)[data]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    before = np.r_[True, gap[:-1]] | first[:n]
    after = np.r_[gap[1:], True] | first[1:]
    s = np.flatnonzero(~gap & before)
    e = np.flatnonzero(~gap & after) + 1
    row, prefix = np.searchsorted(off, s, "right") - 1, Prefix(data)
    out = [(row, mix(prefix.raw(s, e)))]
    for k in heads:
        long = e - s > k
        out.append((row[long], mix(prefix.raw(s[long], s[long] + k) + np.uint64(k))))
    return (np.concatenate([r for r, _ in out]), np.concatenate([h for _, h in out])) if heads else out[0]


def byte_share(rows: DataFrame, most: int) -> float:
    """Share of rows whose texts are about `most` bytes together, 1 at most."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    return 1.0 if total <= most else most / total

