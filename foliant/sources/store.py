"""Tables that change: versions of several tables under one manifest, and a bucketed table that only grows.

Both live in a folder that driver and executors share and are reached through Hadoop's file systems alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a table before and after a change, and the keys that the change may touch.
Change = tuple[DataFrame, Callable[[DataFrame], DataFrame]]


def hadoop(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Conflict(RuntimeError):
    """Another change was committed first."""


class VersionedStore:
    """Tables in hash partitions of a key; a manifest names the folder of each partition.

    A change rewrites the partitions that hold its keys into new folders and leaves all others where they are. The
    manifest of the next version is written last and in one piece, so the tables of a change appear together, and a job
    that is lost before that leaves everything as it was. Older versions stay readable until forget().
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int = 64):
        self.spark, self.folder, self.partitions = spark, folder.rstrip("/"), partitions

    # files

    def _path(self, *names: str):
        return hadoop(self.spark, "/".join([self.folder, *names]))[0]

    def _files(self):
        return hadoop(self.spark, self.folder)[1]

    def _names(self, *names: str) -> list[str]:
        path = self._path(*names)
        return [s.getPath().getName() for s in self._files().listStatus(path)] if self._files().exists(path) else []

    def _manifest(self, version: int) -> dict | None:
        stream = self._files().open(self._path("manifests", f"{version}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:  # of a writer that was lost while it wrote
            return None

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and n[0] != ".")

    def version(self) -> int:
        """The newest complete version; 0 of an empty store."""
        return next((v for v in reversed(self._versions()) if self._manifest(v)), 0)

    def _tables(self, version: int) -> dict:
        return (self._manifest(version) or {}).get("tables", {}) if version else {}

    # reading

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.partitions)).cast("int")

    def read(self, name: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as of a version (the newest by default); only: of these partitions."""
        entry = self._tables(self.version() if version is None else version)[name]
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.folder}/{p}" for b, p in entry["parts"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, name: str, key: str, value) -> DataFrame:
        """Rows of one key; reads the key's partition alone."""
        one = self.spark.range(1).select(self.bucket_of(value, self._tables(self.version())[name]["schema"], key)).first()[0]
        return self.read(name, only=[one]).where(F.col(key) == F.lit(value))

    def bucket_of(self, value, schema: dict, key: str) -> Column:
        kind = StructType.fromJson(schema)[key].dataType
        return F.pmod(F.xxhash64(F.lit(value).cast(kind)), F.lit(self.partitions)).cast("int")

    # changing

    def _put(self, df: DataFrame, name: str, key: str, version: int, spread: bool = True) -> dict[str, str]:
        """Writes rows by partition; the folder of each partition that has rows."""
        own = f"{name}/v{version}-{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self.bucket(key))
        (rows.hint("rebalance", "_bucket") if spread else rows).write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.folder}/{own}")
        return {n.split("=")[1]: f"{own}/{n}" for n in self._names(*own.split("/")) if n.startswith("_bucket=")}

    def _commit(self, version: int, tables: dict) -> int:
        path = self._path("manifests", f"{version}.json")
        try:
            stream = self._files().create(path, False)
        except Exception as e:
            if self._files().exists(path):
                raise Conflict(f"version {version} is there already") from e
            raise
        stream.write(bytearray(json.dumps({"tables": tables}).encode()))
        stream.close()
        return version

    def create(self, tables: dict[str, tuple[DataFrame, str]]) -> int:
        """Adds tables (rows, key) in one version."""
        now = self.version()
        made = dict(self._tables(now))
        new = self._next(now)
        for name, (df, key) in tables.items():
            made[name] = {"key": key, "schema": df.schema.jsonValue(), "parts": self._put(df, name, key, new)}
        return self._commit(new, made)

    def _next(self, now: int) -> int:
        """The number after `now`, past manifests that were never finished."""
        return max([now, *(v for v in self._versions() if v > now and not self._manifest(v))]) + 1

    def change(self, changes: dict[str, Change], spread: bool = True) -> int:
        """Changes tables together: each is given the keys that it touches and what becomes of the rows of their partitions.

        Rows of other keys in these partitions must come through unchanged. Conflict is raised, and nothing changed, if
        another change came first. Without spread each task writes the partitions of the rows that it has, which spares a shuffle
        where the change keeps rows where they were read, as a deletion does.
        """
        now = self.version()
        made, new = dict(self._tables(now)), self._next(now)
        for name, (keys, transform) in changes.items():
            entry = made[name]
            touched = sorted(r[0] for r in keys.select(self.bucket(entry["key"])).distinct().collect())  # at most `partitions`
            if not touched:
                continue
            put = self._put(transform(self.read(name, now, touched)), name, entry["key"], new, spread)
            if strange := set(map(int, put)) - set(touched):
                raise ValueError(f"{name}: rows of keys that the change didn't name, in partitions {sorted(strange)}")
            rest = {b: p for b, p in entry["parts"].items() if int(b) not in touched}
            made[name] = entry | {"parts": rest | put}
        return self._commit(new, made)

    def parts(self, name: str, version: int | None = None) -> dict[str, str]:
        """The folder of each partition of a table."""
        return dict(self._tables(self.version() if version is None else version)[name]["parts"])

    def forget(self, keep: int = 1) -> int:
        """Deletes all versions but the newest `keep` and the folders that only they name; how many folders went."""
        complete = [v for v in self._versions() if self._manifest(v)]
        kept = complete[-keep:] if keep else []
        named = {p.rsplit("/", 1)[0] for v in kept for t in self._tables(v).values() for p in t["parts"].values()}
        gone = 0
        for v in complete[:-keep] if keep else complete:
            self._files().delete(self._path("manifests", f"{v}.json"), False)
        for name in self._names():
            for own in self._names(name) if name != "manifests" else []:
                if f"{name}/{own}" not in named and int(own[1:].split("-")[0]) <= (kept[-1] if kept else 0):
                    self._files().delete(self._path(name, own), True)
                    gone += 1
        return gone


class GrowingTable:
    """A catalogue table bucketed and sorted by its keys, so that a join on them moves the other side alone.

    Rows are appended in versions, each a partition of its own; a version is written once, so an append that is repeated after
    a lost driver adds nothing. Buckets are best as many as the session's shuffle partitions or more.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, schema: str, keys: list[str], buckets: int | None = None):
        self.spark, self.name, self.path, self.keys = spark, name, path, keys
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        columns = ", ".join(f"`{c}`" for c in keys)
        at, files = hadoop(spark, path)
        files.mkdirs(at)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({schema}, version BIGINT) USING parquet PARTITIONED BY (version) "
            f"CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {self.buckets} BUCKETS OPTIONS (compression 'zstd') LOCATION '{path}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {name}")

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows, or those of versions before one."""
        table = self.spark.table(self.name)
        return (table if before is None else table.where(F.col("version") < before)).drop("version")

    def versions(self) -> list[int]:
        return sorted(int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def append(self, df: DataFrame, version: int, dealt: bool = False) -> bool:
        """Adds a version; False, without a write, if it is there already. A task writes whole buckets.

        dealt: df's rows of one key are in one task already, as after joined(), so they aren't moved; if they are not, buckets have more files.
        """
        if version in self.versions():
            return False
        columns = [c for c in self.spark.table(self.name).columns if c != "version"]
        rows = df.select(*columns) if dealt else df.select(*columns).repartition(self.buckets, *self.keys)
        rows = rows.withColumn("version", F.lit(version).cast("long"))
        rows.write.mode("append").format("parquet").partitionBy("version").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)
        return True

    def joined(self, df: DataFrame, how: str, before: int | None = None) -> DataFrame:
        """df joined to the table on its keys, sorted by both sides; the table's side isn't shuffled."""
        return df.join(self.rows(before).hint("merge"), self.keys, how)
