"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "dealflow") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only for a local master without one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dealflow-"))
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later steps see one fixed result."""
    return stored(df, work_path(df.sparkSession, name))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind, which else stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, path: str, **options) -> DataFrame:
    """Write ``df`` to ``path`` and read it back."""
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class WorkTables:
    """Stored tables that a step needs only until its own result is stored."""

    def __init__(self):
        self.paths = []

    def materialise(self, df: DataFrame, name: str, **options) -> DataFrame:
        self.paths.append((df.sparkSession, work_path(df.sparkSession, name)))
        return stored(df, self.paths[-1][1], **options)

    def release(self, name: str) -> None:
        """Remove the tables of a name, which nothing needs any more, before the others."""
        for spark, path in self.paths:
            if path.rsplit("/", 1)[1].rsplit("-", 1)[0] == name:
                remove(spark, path)

    def drop(self) -> None:
        """Remove the tables; nothing that is still to be computed may read them."""
        for spark, path in self.paths:
            remove(spark, path)
        self.paths = []
