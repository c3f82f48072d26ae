"""Keyed tables that are merged when they are read (SNK-04, 05, 08, 10; SNK-06, 07).

Rows live in buckets of a key hash. A change writes only its own rows, as one commit folder with a folder for each bucket it touches; nothing
that is stored is rewritten or renamed. A manifest names, for each bucket, the commit that holds its base and the commits that came after. It is written last, under the next version number, and a version can be
created once: it is the commit point. Until then readers see the version before, and a write that fails or loses the race leaves only
files that no manifest names.

Readers merge a key's rows by commit order. Buckets without later commits are read as they are, without an exchange. Compaction rewrites the buckets whose later commits have outgrown a
share of their base.

A row of a change says how it merges: a replacement takes the place of what is stored, an update overwrites fields by its non-null ones, a removal ends the key."""
from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.session import estimated_bytes

REPLACE, UPDATE, REMOVE = 0, 1, 2
#: Input bytes that one bucket stands for, and what a fresh table gets at least and at most.
BUCKET_BYTES, LEAST, MOST = 256 * 1024 * 1024, 8, 1 << 16
#: Later commits of a bucket that compaction allows, and their share of the base's size.
COMMITS, SHARE = 8, 0.5


class Conflict(RuntimeError):
    """Another writer has made the next version; read again and repeat the change."""


@dataclass
class Manifest:
    version: int
    keys: list[str]
    buckets: int
    schema: str
    #: commit -> {bucket: bytes}; the commits of a bucket in order, the base first
    commits: dict[str, dict[int, int]] = field(default_factory=dict)
    live: dict[int, list[str]] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def load(text: str) -> Manifest:
        d = json.loads(text)
        d["commits"] = {c: {int(b): n for b, n in x.items()} for c, x in d["commits"].items()}
        d["live"] = {int(b): c for b, c in d["live"].items()}
        return Manifest(**d)


class MergeTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # ---- manifests ----

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the one asked for."""
        if version is None:
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_manifests"))]
            version = max(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))
        stream = self._fs.open(self._path(f"_manifests/v{version:010d}.json"))
        try:
            return Manifest.load(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, m: Manifest) -> None:
        """Written under a name of its own, then renamed; a rename onto a version that exists fails."""
        own, target = self._path(f"_manifests/.{uuid.uuid4().hex}"), self._path(f"_manifests/v{m.version:010d}.json")
        out = self._fs.create(own, False)
        out.write(bytearray(m.dump().encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(own, target):
            self._fs.delete(own, False)
            raise Conflict(f"version {m.version} exists")

    # ---- writing ----

    @staticmethod
    def create(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> MergeTable:
        """A new table with the rows of ``df``, one row for each key."""
        t = MergeTable(df.sparkSession, path)
        if buckets is None:
            size = estimated_bytes(df)
            buckets = 64 if size >= 1 << 58 else min(MOST, max(LEAST, math.ceil(size / BUCKET_BYTES)))      # larger: Catalyst does not know
        t._fs.mkdirs(t._path("_manifests"))
        m = Manifest(0, keys, buckets, df.schema.json())
        t._commit(m, t._write(df.withColumn("_how", F.lit(REPLACE)), m), base=True)
        return t

    def bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in m.keys]), F.lit(m.buckets)).cast("int")

    def _write(self, rows: DataFrame, m: Manifest) -> str:
        """One commit folder; an exchange by bucket that AQE may split, keys sorted inside the files."""
        commit = f"c{m.version + (1 if m.commits else 0):010d}-{uuid.uuid4().hex[:12]}"
        x = rows.withColumn("_bucket", self.bucket(m)).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *m.keys)
        x.write.partitionBy("_bucket").parquet(f"{self.path}/{commit}")
        return commit

    def _commit(self, m: Manifest, commit: str, base: bool) -> Manifest:
        sizes = {}
        for s in self._fs.listStatus(self._path(commit)):
            name = s.getPath().getName()
            if name.startswith("_bucket="):
                sizes[int(name[8:])] = self._fs.getContentSummary(s.getPath()).getLength()
        new = Manifest(m.version + (1 if m.commits else 0), m.keys, m.buckets, m.schema, {**m.commits, commit: sizes}, dict(m.live))
        for b in sizes:
            new.live[b] = [commit] if base else [*m.live.get(b, []), commit]
        used = {c for names in new.live.values() for c in names} | {commit}
        new.commits = {c: x for c, x in new.commits.items() if c in used}
        self._publish(new)
        return new

    def apply(self, rows: DataFrame, how: int | Column = REPLACE, at: Manifest | None = None) -> Manifest:
        """Add a change: ``rows`` has the keys and any of the table's columns, one row for each key; ``how`` is REPLACE, UPDATE or REMOVE for all rows or a column of them."""
        m = at or self.manifest()
        how = how if isinstance(how, Column) else F.lit(how)
        types = {f.name: f.dataType for f in self._schema(m).fields}
        x = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()], how.cast("int").alias("_how"))
        return self._commit(m, self._write(x, m), base=False)

    def compact(self, commits: int = COMMITS, share: float = SHARE) -> list[int]:
        """Write new bases for buckets with more later commits than ``commits``, or larger ones than ``share`` of their base. Returns these buckets."""
        m = self.manifest()
        size = lambda b, c: m.commits[c].get(b, 0)
        due = sorted(b for b, c in m.live.items() if len(c) > 1 and (len(c) - 1 > commits or sum(size(b, x) for x in c[1:]) > share * size(b, c[0])))
        if due:
            rows = self.read(m, due).withColumn("_how", F.lit(REPLACE))
            self._commit(m, self._write(rows, m), base=True)
        return due

    # ---- reading ----

    def _schema(self, m: Manifest):
        from pyspark.sql.types import StructType
        return StructType.fromJson(json.loads(m.schema))

    def _scan(self, m: Manifest, live: dict[int, list[str]], columns: list[str]) -> DataFrame:
        """The rows of these buckets with _how and, where a bucket has several commits, _at, the place of their commit; only the folders of live buckets are listed."""
        from pyspark.sql.types import IntegerType, StringType, StructField, StructType
        fields = [f for f in self._schema(m).fields if f.name in columns] + [StructField("_how", IntegerType())]
        paths = [f"{self.path}/{c}/_bucket={b}" for b, names in sorted(live.items()) for c in names]
        if not paths:
            return self.spark.createDataFrame([], StructType([*fields, StructField("_at", StringType())]))
        x = self.spark.read.schema(StructType(fields)).option("recursiveFileLookup", "true").parquet(*paths)
        return x if all(len(names) == 1 for names in live.values()) else x.withColumn("_at", F.regexp_extract(F.col("_metadata.file_path"), r"/(c\d{10})-[0-9a-f]{12}/_bucket=", 1))

    def read(self, m: Manifest | None = None, buckets: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The merged rows (of some buckets, of some columns)."""
        m = m or self.manifest()
        names = [f.name for f in self._schema(m).fields]
        wanted = [c for c in names if columns is None or c in columns or c in m.keys]
        live = {b: c for b, c in m.live.items() if buckets is None or b in set(buckets)}
        plain = self._scan(m, {b: c for b, c in live.items() if len(c) == 1}, wanted).where(F.col("_how") != REMOVE).select(*wanted)
        rest = {b: c for b, c in live.items() if len(c) > 1}
        if not rest:
            return plain
        return plain.unionByName(merged(self._scan(m, rest, wanted), m.keys, [c for c in wanted if c not in m.keys]).select(*wanted))


def merged(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key out of its rows in commit order: nothing before the last replacement or removal counts; of each field the last
    non-null value after it. One aggregate, combined before the exchange; it holds a row's order next to each value."""
    at, start = F.col("_at"), F.col("_how") != UPDATE
    # rows that start a key compete with their nulls too, so nothing older than the last of them can win
    best = [F.max(F.when(F.col(c).isNotNull() | start, F.struct(at.alias("at"), F.col(c).isNotNull().alias("has"), F.col(c).alias("v")))).alias(f"_v{i}") for i, c in enumerate(values)]
    x = rows.groupBy(*keys).agg(F.max_by("_how", at).alias("_last"), *best)
    return x.where(F.col("_last") != REMOVE).select(*keys, *[F.when(F.col(f"_v{i}.has"), F.col(f"_v{i}.v")).alias(c) for i, c in enumerate(values)])
