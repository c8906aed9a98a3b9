"""Counts per day and sketches of distinct values, kept up to date with the bucket store.

The roll-ups of a bucket change only when the bucket does, so after a merge those of the touched buckets are made again
and the others stay. A dashboard then reads days instead of listings.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.functions.text import is_present, moment
from dealflow.operators.dashboard import cash_flow_fit, country_scope, group_counts, margin_fit
from dealflow.sources.buckets import BUCKET, BucketStore

DAY = 86_400
LOG2_REGISTERS = 12  # of a sketch: 4,096 registers
SKETCH_ERROR = 1.04 / 2 ** (LOG2_REGISTERS / 2)  # standard error of an estimate, 1.6%
SKETCHED = ["source", "industry", "title", "listed_by_firm", "city"]
_KEYS = ["source", "industry", "country", "seen_day", "first_day"]
_MEASURES = ["total", "cash_flow", "margin", "both", "has_revenue", "has_ebitda", "has_cash_flow", "has_location"]


def seen() -> Column:
    """When a listing was last seen, else first."""
    return F.coalesce("last_seen_date", "first_seen_date")


def _day(time: Column) -> Column:
    """Days since 1970 in UTC, whatever the session's zone."""
    return F.floor(F.unix_seconds(time) / DAY).cast("int")


def day_counts(listings: DataFrame) -> DataFrame:
    """The counts of a dashboard per source, industry, country and the days a listing was last and first seen."""
    rows = listings.select(
        BUCKET, "source", "industry", F.upper(F.trim(F.coalesce(F.col("country"), F.lit("")))).alias("country"),
        _day(seen()).alias("seen_day"), _day(F.col("first_seen_date")).alias("first_day"),
        F.coalesce(cash_flow_fit(), F.lit(False)).alias("_cash"), margin_fit().alias("_margin"),
        "gross_revenue_num", "ebitda_num", "cash_flow_num", (is_present(F.col("state")) & is_present(F.col("country"))).alias("_place"),
    )
    return rows.groupBy(BUCKET, *_KEYS).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_cash").alias("cash_flow"), F.count_if("_margin").alias("margin"),
        F.count_if(F.col("_cash") & F.col("_margin")).alias("both"), F.count("gross_revenue_num").alias("has_revenue"),
        F.count("ebitda_num").alias("has_ebitda"), F.count("cash_flow_num").alias("has_cash_flow"), F.count_if("_place").alias("has_location"),
    )


def day_sketches(listings: DataFrame) -> DataFrame:
    """Sketches of the different usable values of ``SKETCHED`` per day last seen."""
    sketches = [F.hll_sketch_agg(F.when(is_present(F.col(c)), F.col(c)), F.lit(LOG2_REGISTERS)).alias(c) for c in SKETCHED]
    return listings.withColumn("seen_day", _day(seen())).groupBy(BUCKET, "seen_day").agg(*sketches)


class Rollups:
    """Roll-ups of a ``BucketStore`` under ``root/rollups``, in the same buckets."""

    def __init__(self, store: BucketStore):
        self.store, self.spark = store, store.spark
        self.root = f"{store.root}/rollups"

    def _state(self) -> dict[int, list[int]]:
        """The versions of the files that the roll-ups of each bucket were made of."""
        fs, path = self.store._files(f"{self.root}/state.json")
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            text = self.spark._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def refresh(self) -> list[int]:
        """Bring the roll-ups up to the newest snapshot and return the buckets that were made again.

        Folders are named by the files they were made of, so a refresh that is lost, or done twice, spoils nothing.
        """
        now, before = self.store.manifest().buckets, self._state()
        changed = sorted(b for b, versions in now.items() if before.get(b) != versions)
        if changed:
            rows = self.store._rows(self.store.manifest(), changed).withColumn(BUCKET, self.store.bucket_of("url"))
            version = max(max(now[b]) for b in changed)
            for name, made in (("counts", day_counts(rows)), ("sketches", day_sketches(rows))):
                made.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{name}/version={version}")
        fs, path = self.store._files(f"{self.root}/state.json")
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(json.dumps(now).encode()))
        finally:
            stream.close()
        return changed

    def _read(self, name: str, schema: str) -> DataFrame:
        """The roll-ups of every bucket, from the newest folder that has it."""
        folders = [f"{self.root}/{name}/version={max(v)}/{BUCKET}={b}" for b, v in self._state().items()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def counts(self) -> DataFrame:
        measures = ", ".join(f"{m} long" for m in _MEASURES)
        return self._read("counts", f"source string, industry string, country string, seen_day int, first_day int, {measures}")

    def sketches(self) -> DataFrame:
        return self._read("sketches", "seen_day int, " + ", ".join(f"{c} binary" for c in SKETCHED))

    def _moments(self, as_of, days: int) -> tuple[int, int]:
        """The starts of the look-back window and of the new week, in microseconds."""
        now = moment(as_of)
        starts = [now - F.make_interval(days=F.lit(days)), now - F.expr("INTERVAL 7 DAYS")]
        return tuple(self.spark.range(1).select(*[F.unix_micros(s) for s in starts]).first())

    def group_counts(self, as_of=None, lookback_days: int = 90, scope=None) -> DataFrame:
        """What ``dashboard.group_counts`` gives of the listings, for the same reports.

        Whole days are added up. A window that begins within a day needs the listings of that day; only those are read, by the
        dates that the files are sorted by.
        """
        if lookback_days < 1:
            raise ValueError("lookback_days must be at least 1")
        window, week = self._moments(as_of, lookback_days)
        cut = [start // (DAY * 1_000_000) if start % (DAY * 1_000_000) else None for start in (window, week)]
        first_day = [-(-start // (DAY * 1_000_000)) for start in (window, week)]
        days = self.counts().where(F.col("seen_day") >= first_day[0])
        if cut[1] is not None:
            days = days.where(F.col("first_day").isNull() | (F.col("first_day") != cut[1]))
        local, new = F.col("country").isin(country_scope(scope)), F.coalesce(F.col("first_day") >= first_day[1], F.lit(False))
        total = lambda column, where=None: F.sum(F.when(where, F.col(column)).otherwise(0) if where is not None else F.col(column))
        groups = days.groupBy("source", "industry").agg(
            total("total").alias("total"), total("total", new).alias("new"), total("both", local).alias("qualified"), total("total", local).alias("local"),
            *[total(m).alias(m) for m in ("cash_flow", "margin", "has_revenue", "has_ebitda", "has_cash_flow", "has_location")],
        )
        if cut == [None, None]:
            return groups
        rows = self.store.read()
        within = [_within(seen(), cut[0]), _within(F.col("first_seen_date"), cut[1])]
        rest = group_counts(rows.where(within[0] | within[1]), as_of, lookback_days, scope)
        both = groups.unionByName(rest)
        return both.groupBy("source", "industry").agg(*[F.sum(c).alias(c) for c in groups.columns if c not in ("source", "industry")])

    def distinct_values(self, as_of=None, lookback_days: int = 90) -> DataFrame:
        """Estimated numbers of different usable values per column of ``SKETCHED`` among listings seen on the days of the window,
        a day that it begins within counting as a whole. An estimate's standard error is ``SKETCH_ERROR``."""
        window, _ = self._moments(as_of, lookback_days)
        days = self.sketches().where(F.col("seen_day") >= window // (DAY * 1_000_000))
        found = days.agg(*[F.hll_union_agg(c).alias(c) for c in SKETCHED])
        return found.select(*[F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(c) for c in SKETCHED])


def _within(time: Column, day: int | None) -> Column:
    """Whether a time lies in that day, if there is one."""
    if day is None:
        return F.lit(False)
    return F.coalesce((time >= F.timestamp_seconds(F.lit(day * DAY))) & (time < F.timestamp_seconds(F.lit((day + 1) * DAY))), F.lit(False))
