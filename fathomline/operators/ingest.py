"""Event-driven ingest: decisions on pushes, fingerprints, the job queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")


def source_key(hashes: Column, config: Column | None = None) -> Column:
    """The fingerprint of a source: the hash of its sorted content hashes, and of the settings if given."""
    parts = F.array_join(F.array_sort(hashes), " ")
    return F.substring(F.sha2(parts if config is None else F.concat_ws(" ", parts, config), 256), 1, 16)


def decision(own_author: str) -> Column:
    """What becomes of a push, of the columns has_repo, has_head, mode, author_email, source_key, built_key,
    active; the first rule that applies."""
    return (
        F.when(~F.coalesce("has_repo", F.lit(False)), "no-repo").when(~F.coalesce("has_head", F.lit(False)), "empty-repo").when(F.col("mode").isNull(), "no-ingest-config")
        .when(~F.col("mode").isin("build", "atomize"), "bad-mode").when(F.col("author_email") == own_author, "own-writeback").when(F.col("source_key").isNull(), "source-path-missing")
        .when(F.col("built_key") == F.col("source_key"), "unchanged-source").when(F.coalesce("active", F.lit(False)), "active-job-exists").otherwise("enqueue")
    )


def valid_container(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)+$"), F.lit(False))


def decided(events: DataFrame, state: DataFrame, jobs: DataFrame, own_author: str) -> DataFrame:
    """(event_id, container_id, source_key, decision) of the pushes among events(event_id, ts, type,
    container_id), as they arrive by time: where a container's first push is enqueued, its later ones find
    that job active."""
    pushes = events.where("type = 'git.push' and container_id is not null")
    active = jobs.where(F.col("status").isin(*ACTIVE)).select("container_id").distinct().withColumn("active", F.lit(True))
    first = pushes.groupBy("container_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first"))
    rows = pushes.join(first, "container_id").join(state, "container_id", "left").join(active, "container_id", "left")
    base = F.when(~valid_container(F.col("container_id")), "bad-id").otherwise(decision(own_author))
    what = F.when((base == "enqueue") & (F.col("event_id") != F.col("first")), "active-job-exists").otherwise(base)
    return rows.select("event_id", "container_id", "source_key", what.alias("decision"))


def without_active(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidates for a job whose container has none queued or running."""
    return candidates.join(jobs.where(F.col("status").isin(*ACTIVE)), "container_id", "left_anti")


def oldest_queued(jobs: DataFrame, by: str) -> DataFrame:
    """The job queued first, per ``by``."""
    return jobs.where("status = 'queued'").groupBy(by).agg(F.min_by("id", F.struct("triggered_at", "id")).alias("id"), F.min("triggered_at").alias("triggered_at"))


def durations(jobs: DataFrame) -> DataFrame:
    """jobs with ``duration_seconds`` from start to end; null while either is open."""
    return jobs.withColumn("duration_seconds", (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6)


def moved_on(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Jobs after changes (id, status, at, error): queued to running, running to sealed or failed, anything
    else is ignored; the first start is kept. The log, a JSON array, has each change that counted."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "status", "error")))
    rows = jobs.join(changes.groupBy("id").agg(ordered.alias("steps")), "id", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<at:timestamp,status:string,error:string>>")))
    first = F.struct(F.col("status").alias("s"), F.col("started_at").alias("a"), F.col("finished_at").alias("f"), F.col("error").alias("e"), F.array().cast("array<struct<at:timestamp,status:string>>").alias("log"))

    def step(a: Column, c: Column) -> Column:
        ok = ((a["s"] == "queued") & (c["status"] == "running")) | ((a["s"] == "running") & c["status"].isin("sealed", "failed"))
        ends = ok & (c["status"] != "running")
        return F.struct(
            F.when(ok, c["status"]).otherwise(a["s"]).alias("s"), F.when(ok & ~ends, F.coalesce(a["a"], c["at"])).otherwise(a["a"]).alias("a"), F.when(ends, c["at"]).otherwise(a["f"]).alias("f"),
            F.when(ends, c["error"]).otherwise(a["e"]).alias("e"), F.when(ok, F.concat(a["log"], F.array(F.struct(c["at"].alias("at"), c["status"].alias("status"))))).otherwise(a["log"]).alias("log"),
        )

    done = rows.withColumn("r", F.aggregate("steps", first, step))
    return done.withColumns({"status": F.col("r.s"), "started_at": F.col("r.a"), "finished_at": F.col("r.f"), "error": F.col("r.e"), "log": F.to_json("r.log")}).drop("r", "steps")


def push_hook(own_author: str) -> Column:
    """What a push starts at once, without a queue, of has_head, mode (of the ingest file, if there is one) and
    author_email: there is no fingerprint, so an unchanged source is taken in again."""
    return (
        F.when(~F.coalesce("has_head", F.lit(False)), "empty-repo").when(F.coalesce("mode", F.lit("")) == "", "no-ingest-config")
        .when(F.col("author_email") == own_author, "own-writeback").otherwise("spawn")
    )


#: Steps of an ingest: its place, its name and when it is taken.
CHAIN = (
    (1, "clone", "has_repo"), (2, "config", "has_branch and mode is not null"), (3, "build", "mode = 'build'"), (4, "quantize", "mode = 'build' and quantize"),
    (5, "drop-raw", "mode = 'build' and quantize and not keep_raw"), (6, "atomize", "mode = 'atomize'"), (7, "marker", "true"), (8, "commit", "dirty"),
)


def chain(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, outcome) of the ingest of each container of configs (container_id, has_repo, has_branch, mode, quantize,
    keep_raw, source_key, built_key): steps (container_id, place, step) in order, and outcome (container_id, status,
    committed, error). Artifacts change, and are committed, unless the marker has the source's key already; a
    missing repository, branch or config and an unknown mode fail before anything is built."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    error = (
        F.when(~flag("has_repo"), "repository not found").when(~flag("has_branch"), "no branch with commits").when(F.col("mode").isNull(), "ingest config missing")
        .when(~F.col("mode").isin("build", "atomize"), F.concat(F.lit("bad ingest mode: "), "mode"))
    )
    rows = configs.withColumns({"error": error, "quantize": flag("quantize"), "keep_raw": flag("keep_raw"), "dirty": ~F.col("built_key").eqNullSafe(F.coalesce("source_key", F.lit("unresolved-source")))})
    taken = F.filter(F.array(*(F.struct(F.lit(n).alias("place"), F.lit(name).alias("step"), F.expr(when).alias("on")) for n, name, when in CHAIN)), lambda s: s["on"])
    steps = rows.where("error is null").select("container_id", F.explode(taken).alias("s")).select("container_id", "s.place", "s.step")
    outcome = rows.select("container_id", F.when(F.col("error").isNull(), "sealed").otherwise("failed").alias("status"), (F.col("error").isNull() & F.col("dirty")).alias("committed"), "error")
    return steps, outcome
