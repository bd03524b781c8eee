"""The catalog: hierarchies of containers, roll-ups, overlays, path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = r"^[A-Za-z0-9._-]+$"


def valid_path(path: Column) -> Column:
    """2 to 12 segments of letters, digits, dots, lines and dashes."""
    parts = F.split(path, "/")
    return F.coalesce(F.size(parts).between(2, 12) & F.forall(parts, lambda p: p.rlike(SEGMENT)), F.lit(False))


def valid_ref(ref: Column) -> Column:
    return F.coalesce(ref.rlike(r"^[A-Za-z0-9._/-]+$") & (F.length(ref) < 256) & ~ref.startswith("-"), F.lit(False))


def valid_file(path: Column) -> Column:
    return F.coalesce((F.length(path) < 1024) & ~F.contains(path, F.lit("..")), F.lit(False))


def parsed_id(ident: Column, prefix: str = "ns:") -> Column:
    """The path of a container id: itself, or the colon form after a namespace's prefix."""
    return F.when(ident.startswith(prefix), F.replace(F.substring(ident, len(prefix) + 1, 4096), F.lit(":"), F.lit("/"))).otherwise(ident)


def clamped_k(k: Column | int | float | str | None) -> Column:
    """1 to 30; 8 for 0 and for what isn't a number."""
    n = F.coalesce(F.nullif((k if isinstance(k, Column) else F.lit(k)).cast("string").try_cast("double"), F.lit(0.0)), F.lit(8.0))
    n = F.when(F.isnan(n), 8.0).otherwise(n)
    return F.least(F.greatest(n, F.lit(1.0)), F.lit(30.0)).cast("int")


def rolled_up(containers: DataFrame) -> DataFrame:
    """(path, parent_path, depth, containers): every ancestor's count of the containers below it. A
    container's own path isn't a project. ``path`` is unique."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = containers.select(F.explode(above).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("containers"))
    depth = F.size(F.split("path", "/"))
    parent = F.when(depth > 1, F.regexp_replace("path", "/[^/]*$", ""))
    return rows.select("path", parent.alias("parent_path"), depth.alias("depth"), "containers")


def tenants(containers: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """(tenant, containers, projects, title): projects counts the top level only; tenants of the overlay
    (tenant, title) without a container have counts of 0."""
    parts = F.split("path", "/")
    rows = containers.select(parts[0].alias("tenant"), F.when(F.size(parts) > 2, parts[1]).alias("project"))
    rows = rows.groupBy("tenant").agg(F.count(F.lit(1)).alias("containers"), F.countDistinct("project").alias("projects"))
    if overlay is None:
        return rows.withColumn("title", F.col("tenant"))
    return rows.join(overlay, "tenant", "full").fillna(0, ["containers", "projects"]).withColumn("title", F.coalesce("title", "tenant"))


def subtree(containers: DataFrame, path: str) -> DataFrame:
    """Containers at or below a path."""
    return containers.where((F.col("path") == path) | F.col("path").startswith(path + "/"))


def upserted(now: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row per key of both; an invalid slug changes nothing."""
    both = now.unionByName(new.where(F.col(key).rlike(r"^[A-Za-z0-9._/-]+$")))
    latest = both.groupBy(key).agg(F.max_by(F.struct(*(c for c in both.columns if c != key)), F.struct(F.col(at).isNotNull(), F.col(at))).alias("__r"))
    return latest.select(key, "__r.*").select(now.columns)


def isolation(value: Column) -> Column:
    return F.when(value == "soft", "soft").otherwise("hard")


#: (kind, path, name, description, type, isolation, created_at): what was told of tenants, projects, containers.
OVERLAY = "kind string, path string, name string, description string, type string, isolation string, created_at timestamp"


def flat(containers: DataFrame) -> DataFrame:
    """(path, tenant, project, id) of each container."""
    parts = F.split("path", "/")
    return containers.select("path", parts[0].alias("tenant"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("project"), F.element_at(parts, -1).alias("id"))


def created(requests: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overlay, answers) after requests (request_id, kind, tenant, path, id, name, description, type, isolation,
    created_at). Each part of a path must fit SEGMENT, else the answer's status is 400 and nothing changes. The
    latest request for a path counts; a project's unknown tenant is added, isolated hard."""
    strip = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit("/ "))
    inner = F.filter(F.split(strip(F.col("path")), "/"), lambda s: s != "")
    tenant, own = F.trim(F.coalesce("tenant", F.lit(""))), F.trim(F.coalesce("id", F.lit("")))
    parts = F.when(F.col("kind") == "tenant", F.array(tenant)).when(F.col("kind") == "project", F.concat(F.array(tenant), inner)).otherwise(F.concat(F.array(tenant), inner, F.array(own)))
    least = F.when(F.col("kind") == "tenant", 1).otherwise(2)
    ok = F.col("kind").isin("tenant", "project", "container") & (F.size("parts") >= least) & (F.size("parts") <= 12) & F.forall("parts", lambda s: s.rlike(SEGMENT))
    rows = requests.withColumn("parts", parts).withColumns({"ok": F.coalesce(ok, F.lit(False)), "full": F.array_join("parts", "/")})
    name = F.when(F.col("kind") == "container", F.col("name")).otherwise(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.element_at("parts", -1)))
    new = rows.where("ok").select("kind", F.col("full").alias("path"), name.alias("name"), "description", "type", F.when(F.col("kind") == "tenant", isolation(F.col("isolation"))).alias("isolation"), "created_at")
    fields, when = [c for c in new.columns if c not in ("kind", "path")], F.struct(F.col("created_at").isNotNull(), "created_at")
    implied = rows.where("ok and kind = 'project'").select(F.lit("tenant").alias("kind"), F.col("parts")[0].alias("path"), F.col("parts")[0].alias("name"), *(F.lit(None).cast("string").alias(c) for c in ("description", "type")), F.lit("hard").alias("isolation"), "created_at")
    told = overlay.select(new.columns).unionByName(new).groupBy("kind", "path").agg(F.max_by(F.struct(*fields), when).alias("r")).select("kind", "path", "r.*")
    implied = implied.groupBy("kind", "path").agg(F.min_by(F.struct(*fields), when).alias("r")).select("kind", "path", "r.*").join(told.select("kind", "path"), ["kind", "path"], "left_anti")
    return told.unionByName(implied), rows.select("request_id", F.when(F.col("ok"), 201).otherwise(400).alias("status"), F.when(F.col("ok"), F.col("full")).alias("path"))


def projects(containers: DataFrame, overlay: DataFrame) -> DataFrame:
    """(path, containers, name, description, type) of all projects: those above some container, and those only
    told of, which have 0; a project without a name has its last part."""
    counts = rolled_up(containers.where(F.size(F.split("path", "/")) > 2)).where("depth > 1").select("path", "containers")
    told = overlay.where("kind = 'project'")
    above = F.transform(F.sequence(F.lit(2), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    empty = told.select(F.explode(above).alias("path"), F.lit(0).cast("long").alias("containers"))
    rows = counts.unionByName(empty).groupBy("path").agg(F.max("containers").alias("containers")).join(told.select("path", "name", "description", "type"), "path", "left")
    return rows.withColumn("name", F.coalesce("name", F.element_at(F.split("path", "/"), -1)))
