"""Readers and writers: CSV at the edges, Parquet inside."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from rankforge.operators.columns import require_columns
from rankforge.operators.evaluate import metrics_of_sums, rating_sums
from rankforge.operators.score import pending_pairs, verdict_table
from rankforge.schemas import SCALER
from rankforge.session import cut_lineage

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None,
    columns: list[str] | None = None, required: list[str] | None = None, rows: int | None = None,
) -> DataFrame:
    """Header CSV whose quoted texts may hold newlines and doubled quotes.

    With a schema, columns are matched to the header by name and those absent from the
    file are left out; without one all columns are strings. A column list is pruned
    in the scan. ``rows`` stops after the first rows of the file (of a folder: of its files
    in the order of their names; no file behind the last row is read).
    """
    raw = spark.read.options(**_CSV).csv(path)
    reader = spark.read.options(**_CSV)
    if schema is not None:
        known = {f.name: f.dataType for f in schema.fields}
        header = [T.StructField(c, known.get(c, T.StringType())) for c in raw.columns]
        reader = reader.options(enforceSchema=False).schema(T.StructType(header))
        raw = reader.csv(path)
    if required:
        require_columns(raw, required)
    if rows is not None:
        raw = _first_rows(raw, rows, lambda name: reader.csv(name).select(*raw.columns))
    return raw.select(*columns) if columns else raw


def _first_rows(raw: DataFrame, rows: int, read_one) -> DataFrame:
    """The first rows of a table's files: the files stand in the order of their names."""
    files = sorted(unquote(f) for f in raw.inputFiles())
    if len(files) <= 1:
        return raw.limit(rows)
    out, left = raw.limit(0), rows
    for name in files:
        # a file with texts over several lines is one task, so its limit takes its first rows
        part = read_one(name).limit(left)
        out, left = out.unionByName(part), left - part.count()
        if left <= 0:
            break
    return out


def read_parquet(
    spark: SparkSession, path: str, columns: list[str] | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    df = spark.read.parquet(path)
    if required:
        require_columns(df, required)
    return df.select(*columns) if columns else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that owns the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame | None:
    """Parquet table, or None if it is absent, empty of files or lacks a needed column."""
    if not path_exists(spark, path):
        return None
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # a folder without files; anything else is a fault
            raise
        return None
    if required and any(c not in df.columns for c in required):
        return None
    return df


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> str | None:
    """Path of the most recently modified file below a folder; names break ties."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).load(folder).select("path", "modificationTime")
    )
    row = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()
    return row["m"]["path"] if row["m"] else None


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Summary sink; meant for reports of a few rows."""
    df.write.mode(mode).json(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """One folder per key value. AQE sizes the write tasks and splits frequent keys."""
    spread = df.hint("rebalance", *[F.col(k) for k in keys])
    spread.write.mode(mode).option("compression", "snappy").partitionBy(*keys).parquet(path)


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_partitioned(df, path, ["split"], mode)


def write_checked(df: DataFrame, path: str, expected: int | None = None, mode: str = "errorifexists") -> int:
    """Write Parquet and compare rows written, rows read back and the expectation.

    Rows written are observed during the write, so the plan runs once.
    """
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).option(
        "compression", "snappy"
    ).parquet(path)
    written = seen.get["rows"]
    back = df.sparkSession.read.parquet(path).count()
    if mode != "append" and back != written:
        raise RuntimeError(f"{path}: wrote {written} rows, read back {back}")
    if expected is not None and written != expected:
        raise RuntimeError(f"{path}: expected {expected} rows, wrote {written}")
    if back == 0:
        raise RuntimeError(f"{path}: no rows")
    return written


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str, cleaned: DataFrame | None = None) -> DataFrame | None:
    """Stored scaler; else refit from the scores of an earlier cleaned table, if given."""
    if path_exists(spark, path):
        return spark.read.schema(SCALER).parquet(path)
    if cleaned is not None:
        return cleaned.agg(F.min("jrt").alias("data_min"), F.max("jrt").alias("data_max"))
    return None


def extend_verdicts(spark: SparkSession, pairs: DataFrame, path: str, scorer, **options) -> int:
    """Judge only the pairs without a verdict and append them; returns how many.

    A rerun after a crash repeats nothing: Parquet appends commit as a whole.
    """
    known = read_optional(spark, path)
    todo = pairs if known is None else pending_pairs(pairs, known)
    from pyspark.sql import Observation

    seen = Observation()
    fresh = verdict_table(todo, scorer, **options)
    fresh.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return seen.get["rows"]


def refresh_dataset(df: DataFrame, path: str, key: str = "dataset") -> None:
    """Replace only the partitions present in ``df``; other datasets stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def refresh_ratings(ratings: DataFrame, path: str, sums_path: str, by: list[str] = ["item"]) -> None:
    """Replace the ratings of the datasets in ``ratings`` and the sums of their groups.

    ``rating_summary_of`` then covers all datasets without reading the ratings of any.
    """
    kept = cut_lineage(ratings)
    refresh_dataset(kept, path)
    refresh_dataset(rating_sums(kept, ["dataset", *by]), sums_path)


def rating_summary_of(spark: SparkSession, sums_path: str, by: list[str]) -> DataFrame:
    """Rank quality per ``by`` (dataset, dataset and item, or none of them) from stored sums."""
    return metrics_of_sums(spark.read.parquet(sums_path), by)


VERDICT_KEY = ["dataset", "item", "response1_id", "response2_id"]


class VerdictTable:
    """A verdict cache bucketed by pair key, at a path of its own.

    Finding the pairs without a verdict then shuffles the pairs and never the cache, however
    large it has grown: both sides meet bucket by bucket. The catalog entry is only a view of
    the path and is made anew at every start, so nothing but the files has to last.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, key: list[str] = VERDICT_KEY):
        self.spark, self.path, self.buckets, self.key = spark, path, buckets, key
        self.name = "verdicts_" + hashlib.md5(path.encode()).hexdigest()[:16]
        columns = ", ".join(f"`{c}` STRING" for c in key) + ", winner STRING, confidence DOUBLE"
        cut = ", ".join(f"`{c}`" for c in key)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
            f"CLUSTERED BY ({cut}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def pending(self, pairs: DataFrame) -> DataFrame:
        """Pairs without a verdict, by pair key; a key with a null never has one.

        The key columns of ``pairs`` are strings, as in the cache: a cast in the join would
        cost the cache its buckets.
        """
        for c in self.key:
            if pairs.schema[c].dataType != T.StringType():
                pairs = pairs.withColumn(c, F.col(c).cast("string"))
        return pairs.join(self.read().select(*self.key), self.key, "left_anti")

    def extend(self, pairs: DataFrame, scorer, **options) -> int:
        """Judge the pending pairs and append them, one file per bucket; returns how many."""
        from pyspark.sql import Observation

        seen = Observation()
        fresh = verdict_table(self.pending(pairs), scorer, **options)
        columns = [F.col(c).cast("string").alias(c) for c in self.key] + [F.col("winner"), F.col("confidence")]
        dealt = fresh.select(*columns).repartition(self.buckets, *self.key)
        dealt.observe(seen, F.count(F.lit(1)).alias("rows")).write.insertInto(self.name)
        return seen.get["rows"]
