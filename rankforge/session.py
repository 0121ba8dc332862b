"""Session helpers: builder for local use, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "rankforge") -> SparkSession:
    """A session for tests and the benchmark. On a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as the session names it.

    Only a local-mode session without the setting gets a temporary folder; on a
    cluster a missing setting is an error, because a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="rankforge-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read back; also the path, for ``drop_scratch``.

    The schema is handed to the reader, so an empty result needs no file to read. The
    shuffle files of the write go with its end; else they stay on the disks until the
    driver happens to collect its garbage.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a superseded scratch table that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise reliably in the shared folder and forget the plan behind it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame) -> DataFrame:
    """Compute a small aggregate once so that later joins know its real size.

    After the count, Catalyst reads the byte size of the cached relation and
    broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``; above that
    it plans a shuffled join. Lost blocks are recomputed from the plan.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def output_partitions(spark: SparkSession, work: float, per_task: int) -> int:
    """Partitions for a shuffle whose tasks do far more work than their input shows.

    AQE merges small shuffle blocks by input bytes; an explicit number is left alone.
    """
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(base, int(-(-work // per_task)))
