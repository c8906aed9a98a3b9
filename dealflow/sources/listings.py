"""The stored listing table: numbered Parquet snapshots under one folder."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from dealflow.operators.upsert import COLLECTOR_UPDATES, as_listings, upsert
from dealflow.schema import LISTING_SCHEMA

# Order of the rows inside a file, so that a look-back window skips most row groups.
FILE_ORDER = "last_seen_date"


class ListingStore:
    """Snapshots ``snapshot=N`` of the listing table.

    A snapshot counts once its ``_SUCCESS`` marker is there, so a lost job leaves the previous one in force, and a
    write never touches the files being read. With ``buckets`` the rows lie in that many buckets by URL, one file each:
    a merge then shuffles the batch only. Every merge writes a whole snapshot. Of two writers the first to claim the next
    number goes on; the other fails and may merge again into what the first has written.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 0):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, version: int) -> str:
        return f"{self.root}/snapshot={version}"

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def versions(self) -> list[int]:
        """Complete snapshots, oldest first."""
        fs, root = self._files(self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"snapshot=(\d+)", n)))
        return [n for n in numbers if self.complete(n)]

    def complete(self, version: int) -> bool:
        fs, marker = self._files(f"{self._path(version)}/_SUCCESS")
        return fs.exists(marker)

    def _name(self, version: int) -> str:
        return f"listing_snapshot_{hashlib.sha256(self.root.encode()).hexdigest()[:12]}_{version}"

    def _bucketed(self, version: int) -> str:
        """Name of the session's table over a bucketed snapshot."""
        name = self._name(version)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LISTING_SCHEMA)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (url) SORTED BY ({FILE_ORDER}) INTO {self.buckets} BUCKETS LOCATION '{self._path(version)}'"
        )
        return name

    def claim(self, version: int) -> None:
        """Reserve a snapshot number by creating its marker, which only one writer can; see ``release``."""
        fs, marker = self._files(f"{self.root}/_claims/{version}")
        fs.mkdirs(marker.getParent())
        if not fs.createNewFile(marker):
            raise ValueError(f"snapshot {version} is being written")

    def release(self, version: int) -> None:
        """Give up a claimed number, as after a lost writer."""
        fs, marker = self._files(f"{self.root}/_claims/{version}")
        fs.delete(marker, False)

    def prune(self, keep: int = 2) -> list[int]:
        """Remove all but the newest ``keep`` snapshots and return the numbers removed. Nothing must be reading them."""
        if keep < 1:
            raise ValueError("the newest snapshot stays")
        old = self.versions()[:-keep]
        for version in old:
            if self.buckets:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version)}")
            fs, path = self._files(self._path(version))
            fs.delete(path, True)
        return old

    def read(self, version: int | None = None) -> DataFrame:
        """The given snapshot, else the newest; an empty table when there is none."""
        if version is None:
            versions = self.versions()
            if not versions:
                return self.spark.createDataFrame([], LISTING_SCHEMA)
            version = versions[-1]
        if self.buckets:
            return self.spark.table(self._bucketed(version))
        return self.spark.read.schema(LISTING_SCHEMA).parquet(self._path(version))

    def write(self, listings: DataFrame, version: int | None = None, by_bucket: bool = False) -> int:
        """Store a new snapshot and return its number; an unfinished one of that number is replaced.

        Columns that ``listings`` lacks are null, absent numbers are derived. ``by_bucket`` says that each task's rows already belong to one bucket or few; otherwise they are shuffled, so
        that a bucket does not become one file per task.
        """
        if version is None:
            version = (self.versions() or [0])[-1] + 1
        if self.complete(version):
            raise ValueError(f"snapshot {version} exists already")
        self.claim(version)
        try:
            rows = as_listings(listings)
            if self.buckets:
                rows = rows if by_bucket else rows.repartition(self.buckets, "url")
                rows.write.insertInto(self._bucketed(version), overwrite=True)
            else:
                rows.sortWithinPartitions(FILE_ORDER).write.mode("overwrite").parquet(self._path(version))
        finally:
            self.release(version)
        return version

    def merge(self, batch: DataFrame, as_of=None, updates: list[str] = COLLECTOR_UPDATES) -> int:
        """Upsert records into the newest snapshot and return the new one's number.

        The next number is taken before the snapshot is read, so a merge that another one has overtaken fails.
        """
        version = (self.versions() or [0])[-1] + 1
        return self.write(upsert(self.read(), batch, as_of, updates), version, by_bucket=bool(self.versions()))
