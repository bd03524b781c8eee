"""Push events as a stream: each batch is decided against the job and repository tables and its new jobs
are written once, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.operators.ingest import decided, moved_on

EVENTS = "event_id bigint, ts timestamp, type string, container_id string"
JOBS = "id string, container_id string, kind string, status string, triggered_at timestamp, batch bigint"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """New files of events; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(EVENTS).json(folder)


def known_jobs(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(JOBS).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], JOBS)


def start(events: DataFrame, state: DataFrame, jobs_folder: str, checkpoint: str, own_author: str, once: bool = True) -> StreamingQuery:
    """Decide each batch and write its jobs in the partition of its batch; a replay overwrites its own
    partition alone, and its earlier jobs don't count as active against it."""
    spark = events.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        jobs = known_jobs(spark, jobs_folder).where(F.col("batch") != number)
        new = decided(batch, state, jobs, own_author).where("decision = 'enqueue'")
        rows = new.join(batch.select("event_id", "ts"), "event_id").select(
            F.sha1(F.concat_ws("/", "container_id", F.col("event_id").cast("string"))).alias("id"), "container_id", F.lit("ingest").alias("kind"), F.lit("queued").alias("status"), F.col("ts").alias("triggered_at")
        )
        rows.write.mode("overwrite").parquet(f"{jobs_folder.rstrip('/')}/batch={number}")

    writer = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


CHANGES = "id string, status string, at timestamp, error string"
STATES = "id string, container_id string, status string, started_at timestamp, finished_at timestamp, error string, log string"


def job_states(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The latest version of the jobs' states, or the latest one before a version."""
    try:
        rows = spark.read.schema(f"{STATES}, version bigint").parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], STATES)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    latest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == F.lit(latest)).drop("version")


def start_states(changes: DataFrame, jobs_folder: str, states_folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Move jobs on by a stream of CHANGES: each batch writes the next version of all states from the one before
    it and the jobs queued since; a replayed batch writes its own version again. A change of a job that isn't
    known yet is ignored, as one that no rule allows is."""
    spark = changes.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        now = job_states(spark, states_folder, number)
        new = known_jobs(spark, jobs_folder).join(now.select("id"), "id", "left_anti")
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("started_at", "timestamp"), ("finished_at", "timestamp"), ("error", "string"), ("log", "string"))]
        both = now.unionByName(new.select("id", "container_id", "status", *empty))
        moved = moved_on(both.withColumnRenamed("log", "old"), batch)
        whole = F.when(F.coalesce("old", F.lit("[]")) == "[]", F.col("log")).when(F.col("log") == "[]", F.col("old")).otherwise(F.concat(F.expr("substring(old, 1, length(old) - 1)"), F.lit(","), F.expr("substring(log, 2)")))
        moved.withColumn("log", whole).select([f.split(" ")[0] for f in STATES.split(", ")]).write.mode("overwrite").parquet(f"{states_folder.rstrip('/')}/version={number}")

    writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
