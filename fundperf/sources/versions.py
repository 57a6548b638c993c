"""Keyed tables as a log of published versions.

A table is a folder of data files, which never change, and a log. Each entry of the log lists the files of one version,
with the least and greatest key of each, and is published by a rename that fails if the version exists already. So a
reader sees one version or the other and never a part, and of two writers that started from the same version one
fails and can start again from what the other published. Upserts rewrite only the files that hold a key of the batch
and list all others as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundperf.functions.bounds import broadcast_within
from fundperf.operators.keys import keyed_upsert, require_unique
from fundperf.sources.storage import Exists, Folder

LOG = "_versions"
CHANGE = "change"


class StaleVersion(Exception):
    """Another writer has published on top of the version that this one started from."""


@dataclass(frozen=True)
class DataFile:
    """A data file below the table's folder, with its rows and its first and last key as JSON."""

    name: str
    rows: int
    low: str
    high: str


@dataclass(frozen=True)
class Version:
    number: int
    operation: str
    files: tuple[DataFile, ...]
    #: How many files are new in this version; the others are those of the one before.
    written: int
    schema: T.StructType
    keys: tuple[str, ...]
    #: The batch that made the version, if it was named.
    batch: str | None
    published: str

    @property
    def rows(self) -> int:
        return sum(file.rows for file in self.files)

    def to_json(self) -> str:
        values = vars(self) | {"files": [vars(f) for f in self.files], "schema": self.schema.jsonValue()}
        return json.dumps(values, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Version:
        values = json.loads(text)
        values["files"] = tuple(DataFile(**f) for f in values["files"])
        values["schema"] = T.StructType.fromJson(values["schema"])
        return cls(**values | {"keys": tuple(values["keys"])})


def _entry(number: int) -> str:
    return f"{number:020d}.json"


class VersionedTable:
    """The published versions of one keyed table below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._log = Folder(spark, f"{self.path}/{LOG}")

    # Versions

    def numbers(self) -> list[int]:
        """All versions that can be read, oldest first."""
        return [int(name.removesuffix(".json")) for name in self._log.names() if name[0].isdigit()]

    def version(self, number: int | None = None) -> Version:
        """A version by number, by default the latest."""
        known = self.numbers()
        if not known or (number is not None and number not in known):
            raise LookupError(f"{self.path}: no version" + ("" if number is None else f" {number}"))
        return Version.from_json(self._log.read(_entry(known[-1] if number is None else number)))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default of the latest at this moment."""
        version = self.version(number)
        return self._rows(version, version.files)

    def history(self) -> DataFrame:
        """One row per version: its operation, its rows and files, and how many files it wrote."""
        rows = []
        for number in self.numbers():
            v = self.version(number)
            rows.append((v.number, v.operation, v.rows, len(v.files), v.written, v.batch, v.published))
        return self.spark.createDataFrame(
            rows, "version long, operation string, rows long, files int, written int, batch string, published string"
        )

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows that differ between two versions, with what became of them: insert, update or delete.

        Files of both versions are not read. Deleted rows come with their old values, the others with the new ones.
        """
        old, new = self.version(since), self.version(until)
        keys, values = list(old.keys), [name for name in old.schema.names if name not in old.keys]
        before = self._rows(old, set(old.files) - set(new.files))
        after = self._rows(new, set(new.files) - set(old.files))
        before = before.withColumnsRenamed({name: f"_old_{name}" for name in values}).withColumn("_before", F.lit(True))
        joined = before.join(after.withColumn("_after", F.lit(True)), keys, "full")
        same = F.lit(True)
        for name in values:
            same &= F.col(name).eqNullSafe(F.col(f"_old_{name}"))
        change = (
            F.when(F.col("_before").isNull(), "insert")
            .when(F.col("_after").isNull(), "delete")
            .when(~same, "update")
        )
        picked = [F.when(F.col("_after"), F.col(name)).otherwise(F.col(f"_old_{name}")).alias(name) for name in values]
        return joined.select(*keys, *picked, change.alias(CHANGE)).filter(F.col(CHANGE).isNotNull())

    # Writing

    def create(self, rows: DataFrame, keys: Sequence[str], files: int | None = None) -> Version:
        """Version 0, sorted by key into ``files`` files, or as many as Spark finds fit."""
        unique = require_unique(rows, keys, "new table").select(*rows.columns)
        written = self._write(unique, keys, files)
        return self._publish(-1, "create", (), written, rows.schema, keys, None)

    def upsert(
        self,
        updates: DataFrame,
        set_cols: Sequence[str],
        row_bound: int | None = None,
        base: Version | None = None,
        batch: str | None = None,
    ) -> Version:
        """The version after an insert-or-update by key on ``base``, by default the latest.

        Only files that hold a key of the batch are rewritten. Raises StaleVersion if another version came first. A
        named batch that was published already is not applied again: its version is returned.
        """
        done = self._published(batch)
        if done:
            return done
        base = base or self.version()
        keys = list(base.keys)
        given = updates.select(*keys, *set_cols)
        touched = self.touched(given, base, row_bound)
        names = {file.name for file in touched}
        merged = keyed_upsert(self._rows(base, touched), given, keys, set_cols, row_bound).select(*base.schema.names)
        written = self._write(merged, keys, max(1, len(touched)))
        kept = tuple(file for file in base.files if file.name not in names)
        return self._publish(base.number, "upsert", kept, written, base.schema, keys, batch)

    def delete(self, doomed: DataFrame, row_bound: int | None = None, base: Version | None = None) -> Version:
        """The version without the rows of some keys; files without such a key stay as they are."""
        base = base or self.version()
        keys = list(base.keys)
        given = broadcast_within(doomed.select(*keys).distinct(), row_bound)
        touched = self.touched(given, base, row_bound)
        names = {file.name for file in touched}
        left = self._rows(base, touched).join(given, keys, "left_anti").select(*base.schema.names)
        written = self._write(left, keys, max(1, len(touched))) if touched else ()
        kept = tuple(file for file in base.files if file.name not in names)
        return self._publish(base.number, "delete", kept, written, base.schema, keys, None)

    def compact(self, files: int | None = None, base: Version | None = None) -> Version:
        """The same rows in fresh files with disjoint key ranges, after many small upserts."""
        base = base or self.version()
        written = self._write(self._rows(base, base.files), base.keys, files)
        return self._publish(base.number, "compact", (), written, base.schema, base.keys, None)

    def expire(self, keep: int) -> list[str]:
        """Forget all but the latest ``keep`` versions and delete the files that only those used.

        Files of no version, such as those of a writer that has not published yet, stay.
        """
        numbers = self.numbers()
        old, kept = numbers[:-keep] if keep else [], numbers[-keep:] if keep else numbers
        if not old:
            return []
        used = {file.name for number in kept for file in self.version(number).files}
        unused = {file.name for number in old for file in self.version(number).files} - used
        for number in old:
            self._log.delete(_entry(number))
        folder = Folder(self.spark, self.path)
        for name in sorted(unused):
            folder.delete(name)
        return sorted(unused)

    def touched(self, given: DataFrame, base: Version, row_bound: int | None = None) -> tuple[DataFile, ...]:
        """The files of a version that hold a key of ``given``.

        Files whose key range lies beside the batch's are told by the log alone; of the others the keys are read.
        """
        keys = list(base.keys)
        near = self._near(given, base)
        if not near:
            return ()
        batch = broadcast_within(given.select(*keys).distinct(), row_bound)
        name = F.col("_metadata.file_path").alias("_file")
        rows = self.spark.read.schema(base.schema).parquet(*[self._at(f) for f in near]).select(*keys, name)
        hit = {r["_file"].rsplit("/", 2)[-2] + "/" + r["_file"].rsplit("/", 1)[-1] for r in
               rows.join(batch, keys, "left_semi").select("_file").distinct().collect()}  # as many as files
        return tuple(file for file in near if file.name.split("/", 1)[1] in hit)

    def _near(self, given: DataFrame, base: Version) -> list[DataFile]:
        key = _key(base.keys)
        ends = given.agg(F.min(key).alias("low"), F.max(key).alias("high")).select(F.to_json("low"), F.to_json("high")).first()
        if ends[0] is None or not base.files:
            return []
        kind = T.StructType([base.schema[name] for name in base.keys])
        files = self.spark.createDataFrame([(f.name, f.low, f.high) for f in base.files], "name string, low string, high string")
        low, high = F.from_json("low", kind), F.from_json("high", kind)
        beside = (low > F.from_json(F.lit(ends[1]), kind)) | (high < F.from_json(F.lit(ends[0]), kind))
        names = {r["name"] for r in files.filter(~beside).collect()}
        return [file for file in base.files if file.name in names]

    def _at(self, file: DataFile) -> str:
        return f"{self.path}/{file.name}"

    def _rows(self, version: Version, files) -> DataFrame:
        paths = sorted(self._at(file) for file in files)
        if not paths:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*paths)

    def _write(self, rows: DataFrame, keys: Sequence[str], files: int | None) -> tuple[DataFile, ...]:
        """New data files with disjoint key ranges, and their first and last keys."""
        keys = list(keys)
        commit = f"data/{uuid.uuid4().hex}"
        ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
        ranged.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(f"{self.path}/{commit}")
        key = _key(keys)
        found = (
            self.spark.read.schema(rows.schema).parquet(f"{self.path}/{commit}")
            .groupBy(F.col("_metadata.file_name").alias("file"))
            .agg(F.count("*").alias("n"), F.to_json(F.min(key)).alias("low"), F.to_json(F.max(key)).alias("high"))
        )
        return tuple(DataFile(f"{commit}/{r['file']}", r["n"], r["low"], r["high"]) for r in found.orderBy("file").collect())

    def _published(self, batch: str | None) -> Version | None:
        if batch is not None:
            for number in reversed(self.numbers()):
                version = self.version(number)
                if version.batch == batch:
                    return version
        return None

    def _publish(self, base: int, operation, kept, written, schema, keys, batch) -> Version:
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        version = Version(base + 1, operation, (*kept, *written), len(written), schema, tuple(keys), batch, now)
        if base >= 0 and self.numbers()[-1] != base:
            raise StaleVersion(f"{self.path}: version {base} is not the latest any more")
        try:
            self._log.write_new(_entry(version.number), version.to_json())
        except Exists:
            raise StaleVersion(f"{self.path}: version {version.number} was published by another writer") from None
        return version


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*keys)


def is_versioned(spark: SparkSession, path: str) -> bool:
    return bool(VersionedTable(spark, path).numbers())
