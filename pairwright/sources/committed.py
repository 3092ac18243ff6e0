"""Tables in hash buckets whose versions are published whole.

A version is a manifest that names the files of every bucket of every table. A commit writes the
touched buckets to new folders and then publishes the next manifest under a name that must not
exist yet; so readers see all of a commit or nothing, a writer that came second is told so,
and buckets that a commit does not touch keep their files.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.session import growing, staged


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


class CommittedTables:
    """Tables ``{name: (schema, bucketing column)}`` in ``buckets`` hash buckets each, under ``folder`` on a shared file system.

    A commit lists at most ``buckets`` numbers of a table on the driver and in its manifest. The number of
    buckets is fixed by the first commit; one bucket should be what a task can hold.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, str]], buckets: int = 64):
        self.spark, self.folder, self.tables = spark, folder, tables
        self.manifest = {"version": -1, "buckets": buckets, "notes": {}, "files": {name: {} for name in tables}}
        self.refresh()

    # Versions --------------------------------------------------------------------------

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def refresh(self) -> CommittedTables:
        """Go to the last version that is published."""
        files, path = self._files(), self._path("versions")
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        last = max((int(n) for n in names if n.isdigit()), default=-1)
        if last > self.version:
            stream = files.open(self._path("versions", str(last)))
            try:
                self.manifest = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return self

    def _publish(self, manifest: dict) -> None:
        jvm = self.spark._jvm
        files, draft = self._files(), self._path("versions", f".{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        final = self._path("versions", str(manifest["version"]))
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, options)
        except Exception as error:
            files.delete(draft, False)
            if "FileAlreadyExists" not in str(error):
                raise
            raise Conflict(f"version {manifest['version']} of {self.folder} is there already") from None
        self.manifest = manifest

    # Reading ---------------------------------------------------------------------------

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets of the keys in one-column frames."""
        numbers = union_all([k.select(self.bucket(F.col(k.columns[0])).alias("b")) for k in keys])
        return sorted(numbers.agg(F.collect_set("b").alias("b")).first()["b"])

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as of this version, or some of its buckets: only their files are read."""
        known = self.manifest["files"][name]
        paths = [p for b, p in known.items() if buckets is None or int(b) in set(buckets)]
        schema = self.tables[name][0]
        return growing(self.spark.read.schema(schema).parquet(*paths)) if paths else self.spark.createDataFrame([], schema)

    def matching(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows whose bucketing column is among the one-column ``keys``; only their buckets are read."""
        column = self.tables[name][1]
        return growing(self.read(name, self.touched(keys)).join(keys.toDF(column).distinct(), column, "left_semi"))

    # Writing ---------------------------------------------------------------------------

    def commit(self, changes: dict[str, tuple[list[str] | None, DataFrame, DataFrame | None]], notes: dict | None = None) -> None:
        """Publish a version in which the rows of ``changes`` = {table: (keys, rows, gone)} are in place of those with their keys or with the keys of ``gone``.

        Keys among ``rows`` must be distinct; where ``keys`` is None, the rows are the whole table and nothing is read. Untouched
        buckets are neither read nor written. If another writer has published since this object was refreshed, nothing
        changes and Conflict is raised.
        """
        files = {name: dict(known) for name, known in self.manifest["files"].items()}
        for name, (keys, rows, gone) in changes.items():
            schema, column = self.tables[name]
            rows = rows.select(*[c.split()[0] for c in schema.split(", ")])
            if keys is None:
                files[name] = self._write(name, rows, self.buckets)
                continue
            out = rows.select(*keys) if gone is None else rows.select(*keys).union(gone.select(*keys))
            touched = self.touched(out.select(column))
            if not touched:
                continue
            written = self._write(name, self.read(name, touched).join(out, keys, "left_anti").unionByName(rows), len(touched))
            files[name] = {b: f for b, f in files[name].items() if int(b) not in set(touched)} | written
        self._publish({"version": self.version + 1, "buckets": self.buckets, "notes": self.manifest["notes"] | (notes or {}), "files": files})

    def _write(self, name: str, rows: DataFrame, tasks: int) -> dict[str, str]:
        """Write rows to a new folder; the file folder of each bucket that has any."""
        folder = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows = rows.withColumn("bucket", self.bucket(self.tables[name][1]))
        rows.repartition(min(tasks, self.buckets), "bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(folder)
        listed = self._files().listStatus(self._path(name, folder.rsplit("/", 1)[1]))
        written = [x.getPath().getName().removeprefix("bucket=") for x in listed if x.isDirectory()]
        return {b: f"{folder}/bucket={b}" for b in written if b.isdigit()}

    def append(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Commit new rows; a key that is repeated or there already is an error and changes nothing. ``keys`` must hold the bucketing column."""
        rows = staged(rows, name)
        twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if twice or self.matching(name, rows.select(self.tables[name][1])).join(rows, keys, "left_semi").limit(1).count():
            raise ValueError(f"keys of {name} must be new")
        self.commit({name: (keys, rows, None)})

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Commit rows in place of those with their keys, which must be distinct."""
        self.commit({name: (keys, rows, None)})


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
