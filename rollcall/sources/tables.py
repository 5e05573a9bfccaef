"""Tables that may be read while they are written: parts of a table are replaced or added by one small manifest.

<path>/_parts/<name>/     Parquet files of one write
<path>/_manifests/<n>     which folders make up the parts of version n; the highest n counts

Rows are written to new folders first. Then the next manifest, written under another name, is renamed into place, which
fails if another writer was faster. So a reader sees the old version or the new one, a job may read the table it replaces,
one that is killed half-way leaves the old version, and parts that a write doesn't touch aren't copied. Folders that no
kept version needs any more are deleted after a write. Readers that don't know manifests see no rows, since all names begin
with an underscore.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Table:
    """A table of parts below a path. keep: versions before the last whose files stay, for readers still at them."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 1):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._file("").getFileSystem(self._conf)

    # ------------------------------------------------------------ manifests

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._file("_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """parts: {key: [folder, ...]}, schema, runs (that were committed), version."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": -1, "parts": {}, "schema": None, "runs": []}
            version = known[-1]
        stream = self._fs.open(self._file(f"_manifests/{version}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self.versions())

    def has_run(self, run: str) -> bool:
        return run in self.manifest()["runs"]

    def _swap(self, before: dict, parts: dict, schema: str | None, run: str | None) -> None:
        n = before["version"] + 1
        runs = [r for r in before["runs"] if r != run][-999:] + ([run] if run else [])
        draft, final = self._file(f"_manifests/draft-{uuid.uuid4().hex}"), self._file(f"_manifests/{n}")
        out = self._fs.create(draft)
        out.write(json.dumps({"version": n, "parts": parts, "schema": schema, "runs": runs}).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(self._conf).makeQualified(final).toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            self._fs.delete(draft, False)
            raise
        self._forget(n)

    def _forget(self, last: int) -> None:
        """Delete versions before the kept ones, with the folders that only they need."""
        known = self.versions()
        kept, old = [v for v in known if v >= last - self.keep], [v for v in known if v < last - self.keep]
        needed = {f for v in kept for folders in self.manifest(v)["parts"].values() for f in folders}
        for v in old:
            for folders in self.manifest(v)["parts"].values():
                for f in folders:
                    if f not in needed:
                        self._fs.delete(self._file(f"_parts/{f}"), True)
            self._fs.delete(self._file(f"_manifests/{v}"), False)

    # ------------------------------------------------------------ reading

    def read(self, *keys: str) -> DataFrame:
        """All rows, or those of some parts."""
        m = self.manifest()
        if m["schema"] is None:
            raise ValueError(f"no table at {self.path}")
        schema = StructType.fromJson(json.loads(m["schema"]))
        folders = [f"{self.path}/_parts/{f}" for k, fs in m["parts"].items() if not keys or k in keys for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ writing

    def _write(self, df: DataFrame, by: str | None = None) -> str:
        name = uuid.uuid4().hex
        w = df.write
        (w.partitionBy(by) if by else w).parquet(f"{self.path}/_parts/{name}")
        return name

    @staticmethod
    def _schema(before: dict, dfs: list[DataFrame]) -> str | None:
        """The table's columns and, after them, those it hasn't had yet."""
        known = StructType.fromJson(json.loads(before["schema"])).fields if before["schema"] else []
        for df in dfs:
            for f in df.schema.fields:
                same = [k for k in known if k.name.lower() == f.name.lower()]
                if same and same[0].dataType != f.dataType:
                    raise ValueError(f"column {f.name} is {same[0].dataType.simpleString()} in the table and {f.dataType.simpleString()} in the rows to write")
                known = known if same else [*known, f]
        for f in known:
            f.nullable = True
        return StructType(known).json() if known else None

    def replace(self, parts: dict[str, DataFrame | None], run: str | None = None) -> None:
        """Each key's rows become those of its DataFrame (None: the part goes); other parts stay."""
        before = self.manifest()
        now = {k: f for k, f in before["parts"].items() if k not in parts}
        given = {k: df for k, df in parts.items() if df is not None}
        now |= {k: [self._write(df)] for k, df in given.items()}
        self._swap(before, now, self._schema(before, list(given.values())), run)


class BucketedTable(Table):
    """A table whose parts are buckets of a key's hash: new rows are added to their buckets, changed ones rewrite only the
    buckets they are in.

    The buckets are Spark's own, so that colocated() is joined or grouped by the key without being shuffled.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, keep: int = 1):
        super().__init__(spark, path, keep)
        self.key, self.buckets = key, buckets
        if known := self.manifest()["parts"]:
            self.buckets = int(next(iter(known)).split("/")[1])

    def bucket(self) -> Column:
        """The number that Spark's bucketing gives a key."""
        return F.pmod(F.hash(F.col(self.key)), F.lit(self.buckets))

    def _name(self, b: int) -> str:
        return f"{b}/{self.buckets}"

    def _dealt(self, df: DataFrame, laid: bool = False) -> dict[str, str]:
        """Write df by buckets, sorted by key; the folder of each bucket that has rows. laid: rows lie by bucket already."""
        rows = df.withColumn("_bucket", self.bucket())
        rows = rows if laid else rows.repartition(self.buckets, self.key)
        name, made = uuid.uuid4().hex, f"rollcall_{uuid.uuid4().hex}"
        try:  # only a write of a named table puts bucket numbers into file names; dropping its name leaves the files
            rows.write.partitionBy("_bucket").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/_parts/{name}").saveAsTable(made)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {made}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._file(f"_parts/{name}"))]
        return {self._name(int(x.split("=")[1])): f"{name}/{x}" for x in found if x.startswith("_bucket=")}

    def colocated(self, *keys: str) -> DataFrame:
        """All rows, or those of some buckets, as Spark's bucketed table: the buckets are partitions of a table that this
        session knows by the version's name."""
        m = self.manifest()
        parts = [(i, f) for i, f in enumerate(f for k, fs in m["parts"].items() if not keys or k in keys for f in fs)]
        if not parts:
            return self.read(*keys)
        path = self._fs.makeQualified(self._file("")).toString()
        name = f"rollcall_{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join([path, str(m['version']), *keys])).hex}"
        if not self.spark.catalog.tableExists(name):
            columns = self._jvm.org.apache.spark.sql.types.DataType.fromJson(m["schema"]).toDDL()
            self.spark.sql(f"CREATE TABLE {name} ({columns}, _part INT) USING parquet OPTIONS (path '{path}/_parts') PARTITIONED BY (_part) "
                           f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS")
            self.spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION (_part={i}) LOCATION '{path}/_parts/{f}'" for i, f in parts))
        return self.spark.table(name).drop("_part")

    def add(self, df: DataFrame, run: str | None = None) -> None:
        """More rows, whose keys the table doesn't hold yet."""
        before = self.manifest()
        now = dict(before["parts"])
        for k, f in self._dealt(df).items():
            now[k] = [*now.get(k, []), f]
        self._swap(before, now, self._schema(before, [df]), run)

    def rewrite(self, keys: DataFrame, change, run: str | None = None) -> int:
        """change(rows of the buckets that `keys` are in) in place of those rows; the number of buckets written.

        change should leave rows where they are (as joins and projections do), since each bucket is written where it was
        read. What is collected is bucket numbers, `buckets` of them at most.
        """
        touched = [self._name(r["b"]) for r in keys.select(self.bucket().alias("b")).distinct().collect() if r["b"] is not None]
        before = self.manifest()
        touched = [k for k in touched if k in before["parts"]]
        if touched:
            rows = change(self.colocated(*touched))
            now = {k: f for k, f in before["parts"].items() if k not in touched} | {k: [f] for k, f in self._dealt(rows, laid=True).items()}
            self._swap(before, now, self._schema(before, [rows]), run)
        elif run:
            self._swap(before, before["parts"], before["schema"], run)
        return len(touched)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table of parts at a path, or else its plain Parquet files."""
    table = Table(spark, path)
    return table.read() if table.exists() else spark.read.parquet(path)


def union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
