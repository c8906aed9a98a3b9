"""The listing table in buckets by URL, of which a merge rewrites only those that its batch touches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.operators.upsert import COLLECTOR_UPDATES, as_listings, has_url, known_urls, upsert
from dealflow.schema import LISTING_SCHEMA
from dealflow.session import WorkTables, shuffles_removed
from dealflow.sources.listings import FILE_ORDER

BUCKET = "bucket"
SPREAD = 2  # partitions per touched bucket, so that few buckets share one
PART_ROWS = 200_000  # of a touched bucket and its batch that meet in one partition; a bucket with more is several files
TURN_ROWS, MOST_TURNS = 1_000_000, 16  # of the touched buckets and their batch that are shuffled at once, and how often the batch is read at most


@dataclass
class Manifest:
    """What a snapshot consists of: for each bucket the versions whose files make it up, and the largest id so far."""

    version: int = 0
    largest: int = 0
    buckets: dict[int, list[int]] = field(default_factory=dict)


class BucketStore:
    """Snapshots of the listing table under one folder, in ``buckets`` by URL.

    Version ``N`` writes the buckets it changes to ``data/version=N/bucket=B`` and then a manifest, which names the folders of
    every bucket, changed or not. A snapshot counts once its manifest is there, so a lost job leaves the previous one
    in force, and a write never touches files being read. Of two writers the first to claim the next number goes on. The
    number of buckets is fixed when the table is first written.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ---- files ---------------------------------------------------------------------------------------------------

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def _folder(self, version: int, bucket: int | None = None) -> str:
        top = f"{self.root}/data/version={version}"
        return top if bucket is None else f"{top}/{BUCKET}={bucket}"

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/snapshots/{version}.json"

    def versions(self) -> list[int]:
        """Snapshots, oldest first."""
        fs, folder = self._files(f"{self.root}/snapshots")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The given snapshot's manifest, else the newest one's; an empty one when there is none."""
        versions = self.versions()
        version = version if version is not None else (versions or [0])[-1]
        if version not in versions:
            if version:
                raise ValueError(f"there is no snapshot {version}")
            return Manifest()
        fs, path = self._files(self._manifest_path(version))
        stream = fs.open(path)
        try:
            text = self.spark._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if found["of"] != self.buckets:
            raise ValueError(f"the table has {found['of']} buckets, not {self.buckets}")
        return Manifest(version, found["largest"], {int(b): v for b, v in found["buckets"].items()})

    def _commit(self, manifest: Manifest) -> int:
        """Put the manifest in place by a rename, which a reader sees as a whole or not at all."""
        text = json.dumps({"of": self.buckets, "largest": manifest.largest, "buckets": manifest.buckets})
        fs, path = self._files(self._manifest_path(manifest.version))
        _, draft = self._files(f"{self.root}/snapshots/_{manifest.version}.draft")
        fs.mkdirs(path.getParent())
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(path) or not fs.rename(draft, path):
            raise ValueError(f"snapshot {manifest.version} exists already")
        return manifest.version

    def _claim(self, version: int) -> None:
        fs, marker = self._files(f"{self.root}/claims/{version}")
        fs.mkdirs(marker.getParent())
        if not fs.createNewFile(marker):
            raise ValueError(f"snapshot {version} is being written")

    def release(self, version: int) -> None:
        """Give up a claimed number, as after a lost writer."""
        fs, marker = self._files(f"{self.root}/claims/{version}")
        fs.delete(marker, False)

    def prune(self, keep: int = 2) -> list[str]:
        """Forget all but the newest ``keep`` snapshots and remove the folders that none of these needs; nothing must be
        reading the others. Returns the folders removed."""
        if keep < 1:
            raise ValueError("the newest snapshot stays")
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]
        needed = {(v, b) for k in kept for b, found in self.manifest(k).buckets.items() for v in found}
        named = {(v, b) for k in old for b, found in self.manifest(k).buckets.items() for v in found}
        for version in old:
            fs, path = self._files(self._manifest_path(version))
            fs.delete(path, False)
        gone = [self._folder(v, b) for v, b in sorted(named - needed)]
        for folder in gone:
            fs, path = self._files(folder)
            fs.delete(path, True)
        return gone

    # ---- rows ----------------------------------------------------------------------------------------------------

    def bucket_of(self, url: str | Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        wanted = manifest.buckets if buckets is None else [b for b in buckets if b in manifest.buckets]
        folders = [self._folder(v, b) for b in wanted for v in manifest.buckets[b]]
        if not folders:
            return self.spark.createDataFrame([], LISTING_SCHEMA)
        return self.spark.read.schema(LISTING_SCHEMA).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The given snapshot, else the newest; an empty table when there is none."""
        return self._rows(self.manifest(version))

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of the batch's URLs, in order."""
        found = batch.where(has_url()).select(self.bucket_of("url").alias(BUCKET)).distinct().collect()  # one row per bucket
        return sorted(r[BUCKET] for r in found)

    def rows_for(self, batch: DataFrame) -> DataFrame:
        """The stored rows of the buckets that the batch touches: all that can share a URL with it."""
        return self._rows(self.manifest(), self.touched(batch))

    def existing_urls(self, batch: DataFrame) -> DataFrame:
        """Those URLs of the batch that are stored; only the URL column of the touched buckets is read."""
        return known_urls(self.rows_for(batch), batch)

    def _written(self, version: int) -> list[int]:
        fs, path = self._files(self._folder(version))
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))

    def _store(self, rows: DataFrame, version: int, more: bool = False) -> tuple[list[int], int]:
        """Write ``rows`` with their ``bucket``; the buckets written and the largest id among them. ``more`` adds buckets to a version
        that is being written."""
        earlier = self._written(version) if more else []
        ordered = rows.sortWithinPartitions(BUCKET, FILE_ORDER)
        with shuffles_removed(self.spark):
            writer = ordered.write.mode("append" if more else "overwrite").option("compression", "zstd")
            writer.partitionBy(BUCKET).parquet(self._folder(version))
        written = sorted(set(self._written(version)) - set(earlier))
        if not written:
            return [], 0
        stored = self.spark.read.schema(LISTING_SCHEMA).parquet(*[self._folder(version, b) for b in written])
        return written, stored.agg(F.max("id")).first()[0] or 0

    def _change(self, make, replace: bool, whole: bool = False) -> int:
        """Claim the next number, write what ``make`` gives of the newest manifest, frame after frame of different buckets, and commit."""
        version = (self.versions() or [0])[-1] + 1
        self._claim(version)
        try:
            before = self.manifest()
            written, largest = [], 0
            for turn, rows in enumerate(make(before)):
                buckets, top = self._store(rows, version, more=True) if turn else self._store(rows, version)
                written, largest = written + buckets, max(largest, top)
            kept = {} if whole else dict(before.buckets)
            for bucket in written:
                kept[bucket] = [version] if replace else [*kept.get(bucket, []), version]
            return self._commit(Manifest(version, max(largest, 0 if whole else before.largest), kept))
        finally:
            self.release(version)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """The rows by bucket; Spark divides a large bucket among tasks, each of which writes a file of it."""
        return as_listings(rows).withColumn(BUCKET, self.bucket_of("url")).hint("rebalance", BUCKET)

    def write(self, listings: DataFrame) -> int:
        """Store a whole table as a new snapshot and return its number."""
        return self._change(lambda _: [self._dealt(listings)], replace=True, whole=True)

    def add(self, listings: DataFrame) -> int:
        """Add rows of new URLs, as an upload does: their buckets get a further file, nothing is read or rewritten."""
        return self._change(lambda _: [self._dealt(listings)], replace=False)

    def merge(self, batch: DataFrame, as_of=None, updates: list[str] = COLLECTOR_UPDATES) -> int:
        """Upsert records (with ``seq``) into the newest snapshot and return the new one's number.

        Only the touched buckets are read, joined and written, a large one in parts by URL, each as one file. Their rows and
        the batch are shuffled once, by bucket and part; the join and the files then need no further shuffle. Many rows come in turns
        of some buckets each, whose shuffle files go before the next turn.
        """
        work = WorkTables()
        batch = work.materialise(batch, "batch", compression="zstd")
        name = "spark.sql.requireAllClusterKeysForCoPartition"
        usual = self.spark.conf.get(name)

        def make(before: Manifest) -> Iterator[DataFrame]:
            touched = self.touched(batch)
            # Both counts come out of the files' footers.
            rows = self._rows(before, touched).count() + batch.count()
            pieces = -(-rows // (PART_ROWS * max(1, len(touched)))) or 1
            part_of = lambda url: F.pmod(F.xxhash64(url), F.lit(self.buckets * pieces))
            turns = max(1, min(MOST_TURNS, len(touched), -(-rows // TURN_ROWS)))
            for turn in range(turns):
                buckets = touched[turn::turns]
                here = batch if turns == 1 else batch.where(self.bucket_of("url").isin(buckets))
                parts = max(1, min(self.buckets, SPREAD * len(buckets))) * pieces
                together = (self.bucket_of if pieces == 1 else part_of, parts)
                merged = upsert(self._rows(before, buckets), here, as_of, updates, largest=before.largest, together=together)
                yield merged.withColumn(BUCKET, self.bucket_of("url"))

        try:
            # Rows that lie together by bucket also do by (bucket, URL).
            self.spark.conf.set(name, "false")
            return self._change(make, replace=True)
        finally:
            self.spark.conf.set(name, usual)
            work.drop()
