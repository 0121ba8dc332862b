"""Structured Streaming forms: resumable judging, live metrics, votes, live ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rankforge.operators.elo_replay import GROUP
from rankforge.operators.elo_rules import EloParams
from rankforge.operators.elo_sync import start_ratings, sync_step
from rankforge.operators.evaluate import CELLS, cell, confusion_counts, metrics_of_counts
from rankforge.operators.ordering import row_index
from rankforge.operators.score import verdict_detail
from rankforge.schemas import LABELS
from rankforge.sources.tables import path_exists


def table_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100
) -> DataFrame:
    """Parquet folder as a stream of new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _drain(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def stream_verdicts(
    pairs: DataFrame, sink: str, checkpoint: str, scorer, **options
) -> StreamingQuery:
    """Judge all pairs that have arrived and append the detail rows, exactly once.

    The checkpoint records which files are done; a rerun continues behind them.
    """
    detail = verdict_detail(pairs, scorer, **options)
    writer = detail.writeStream.format("parquet").option("path", sink)
    return _drain(
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_metrics(
    detail: DataFrame, sink: str, checkpoint: str, by: list[str] = ["split"], **names
) -> StreamingQuery:
    """Running classification metrics: state is one row of counters per group.

    Every micro-batch replaces the report below ``sink``. The counters stand in versions
    beside the checkpoint, one a batch, so a batch costs one aggregation and a repeated batch
    gives the same version.
    """
    spark = detail.sparkSession
    state = f"{checkpoint.rstrip('/')}-counters"

    def publish(frame: DataFrame, batch: int) -> None:
        total = confusion_counts(frame, by, **names)
        cells = [c for c in total.columns if c not in by]
        if batch:
            before = spark.read.schema(total.schema).parquet(f"{state}/version={batch - 1}")
            total = before.unionByName(total).groupBy(*by).agg(*[F.sum(c).alias(c) for c in cells])
        total.coalesce(1).write.mode("overwrite").parquet(f"{state}/version={batch}")
        now = spark.read.schema(total.schema).parquet(f"{state}/version={batch}")
        now.select(*by, *cells).coalesce(1).write.mode("overwrite").parquet(sink)

    writer = detail.writeStream.foreachBatch(publish)
    return _drain(
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_votes(
    passes: DataFrame, sink: str, checkpoint: str, key: str = "source_row_index"
) -> StreamingQuery:
    """Vote counts per sample as pass rows arrive; ``latest_votes`` adds them up.

    Each micro-batch writes the counts of its own rows to its own folder, so a repeated batch
    overwrites itself, and a batch costs what its rows cost: no sample is kept between batches.
    """
    drawn = F.col("pass_type") == "stochastic"

    def publish(frame: DataFrame, batch: int) -> None:
        votes = frame.groupBy(key).agg(
            F.min("true_winner").alias("true_winner"),
            *[F.count_if(drawn & (F.col("pred_winner") == w)).alias(f"votes_{w}") for w in LABELS],
        )
        votes.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    writer = passes.writeStream.foreachBatch(publish)
    return _drain(
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_votes(spark: SparkSession, sink: str, key: str = "source_row_index") -> DataFrame:
    """The counts per sample so far."""
    all_batches = spark.read.parquet(sink)
    return all_batches.groupBy(key).agg(
        F.min("true_winner").alias("true_winner"), *[F.sum(f"votes_{w}").alias(f"votes_{w}") for w in LABELS]
    )


def stream_running_metrics(
    detail: DataFrame, sink: str, checkpoint: str, every: int, order: list[str],
    by: list[str] = ["split"], truth: str = "winner", predicted: str = "predicted_winner",
) -> StreamingQuery:
    """A metric row at every ``every``-th row of a group, counted on across micro-batches.

    Rows of a micro-batch stand in ``order``, behind those of earlier batches. State is one
    row of counters per group; a batch numbers its rows by a range partitioning, so a group
    that holds most rows is spread over tasks. Each batch writes its own folders of reports
    and state, so a repeated batch overwrites itself.
    """
    spark = detail.sparkSession
    cells = [cell(t, p) for t, p in CELLS]
    sums = ["n", *cells]

    def update(frame: DataFrame, batch: int) -> None:
        numbered = row_index(frame.select(*dict.fromkeys([*by, *order, truth, predicted])), order, by, name="_i")
        seen = confusion_counts(numbered, by, truth, predicted).select(*by, *sums)
        if batch:
            before = spark.read.parquet(f"{sink}/state/version={batch - 1}")
        else:
            before = seen.limit(0)
        carried = before.select(*by, *[F.col(c).alias(f"_{c}") for c in sums])
        placed = numbered.join(carried.select(*by, "_n"), by, "left").withColumn(
            "bucket", F.floor((F.coalesce("_n", F.lit(0)) + F.col("_i")) / F.lit(every)).cast("bigint")
        )
        buckets = confusion_counts(placed, [*by, "bucket"], truth, predicted)
        so_far = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = buckets.join(carried, by, "left").select(
            *by, "bucket", *[(F.sum(c).over(so_far) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]
        )
        # a bucket counts once its last row is there, in this batch or a later one
        full = running.filter(F.col("n") == (F.col("bucket") + 1) * every)
        full.drop("bucket").write.mode("overwrite").parquet(f"{sink}/reports/batch={batch}")
        total = before.unionByName(seen).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
        total.write.mode("overwrite").parquet(f"{sink}/state/version={batch}")

    writer = detail.writeStream.foreachBatch(update)
    return _drain(writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def running_reports(spark: SparkSession, sink: str, by: list[str] = ["split"]) -> DataFrame:
    """All reports so far: the metrics after so many rows (``n_samples``) of a group."""
    return metrics_of_counts(spark.read.parquet(f"{sink}/reports").drop("batch"), by)


#: Versions between two whole rating tables; those between hold changed items only.
SNAPSHOT_EVERY = 20


def stream_ratings(
    verdicts: DataFrame, items: DataFrame, sink: str, checkpoint: str,
    params: EloParams = EloParams(), by: list[str] = GROUP, snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """One synchronous rating update per micro-batch of new verdicts.

    A batch reads the ratings of the items that its verdicts name and writes those that have
    moved, so its cost follows the batch and not the table. Every ``snapshot_every``-th
    version is the whole table, which bounds how many versions a reader looks through.
    Version n depends on the versions before it alone and is overwritten as a whole, so a
    repeated batch gives the same result.
    """
    spark = items.sparkSession

    def update(frame: DataFrame, batch: int) -> None:
        if batch == 0:
            ratings = start_ratings(items, by, params.initial)
        else:
            ratings = ratings_at(spark, sink, batch - 1, by, snapshot_every)
        sides = [frame.select(*by, F.col(f"response{i}_id").cast("string").alias("response_id")) for i in (1, 2)]
        touched = ratings.join(sides[0].unionByName(sides[1]).distinct(), [*by, "response_id"], "left_semi")
        moved = sync_step(frame, touched, by, F.lit(params.k_at(batch))).filter(F.col("games").isNotNull())
        columns = [*by, "response_id", "norm_response", "elo"]
        moved = moved.select(*columns)
        if batch % snapshot_every == 0:
            moved = _newest(
                ratings.select(*columns, F.lit(0).alias("version")).unionByName(moved.withColumn("version", F.lit(1))), by
            )
        moved.write.mode("overwrite").parquet(f"{sink}/version={batch}")

    writer = verdicts.writeStream.foreachBatch(update)
    return _drain(
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _newest(versions: DataFrame, by: list[str]) -> DataFrame:
    """The row of the highest version per item."""
    keys = [*by, "response_id"]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct("norm_response", "elo"), "version").alias("_r"))
    return newest.select(*keys, "_r.*")


def ratings_at(
    spark: SparkSession, sink: str, version: int, by: list[str] = GROUP, snapshot_every: int = SNAPSHOT_EVERY
) -> DataFrame:
    """The rating table as of a version: its last whole table and the changes since."""
    base = version - version % snapshot_every
    parts = [f"{sink}/version={v}" for v in range(base, version + 1)]
    for path in parts:
        if not path_exists(spark, path):
            raise FileNotFoundError(f"the ratings of version {version} need {path}")
    return _newest(spark.read.option("basePath", sink).parquet(*parts), by)


def latest_ratings(
    spark: SparkSession, sink: str, by: list[str] = GROUP, snapshot_every: int = SNAPSHOT_EVERY
) -> DataFrame:
    """The rating table after the last finished micro-batch."""
    version = spark.read.parquet(sink).agg(F.max("version")).first()[0]
    return ratings_at(spark, sink, version, by, snapshot_every)
