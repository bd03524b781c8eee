"""Change history: logs, differences, ranges of revisions, trees, refs, blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import materialize

BLOB_LIMIT = 5 * 1024 * 1024


def log(commits: DataFrame, repo: str, limit: int = 30) -> DataFrame:
    """The latest ``limit`` (at most 200) commits (id, created_at) of each repository, newest first."""
    newest = Window.partitionBy(repo).orderBy(F.desc("created_at"), F.desc("id"))
    return commits.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= max(1, min(limit, 200)))


def diff_totals(stats: DataFrame) -> DataFrame:
    """(commit_id, files, additions, deletions) of (commit_id, path, additions, deletions); null, which is
    binary, adds nothing."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return stats.groupBy("commit_id").agg(F.count(F.lit(1)).alias("files"), total("additions").alias("additions"), total("deletions").alias("deletions"))


def reachable(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, id): everything reachable from heads(root, id) over edges(id, parent), heads included. A
    frontier goes back one generation a round and is written, so lineage stays short."""
    seen = frontier = materialize(heads.distinct())
    while True:
        step = frontier.join(edges, "id").select("root", F.col("parent").alias("id")).where("id is not null").distinct()
        frontier = materialize(step.join(seen, ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = materialize(seen.unionByName(frontier))


def compared(heads_from: DataFrame, heads_to: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, id): commits of ``to`` that aren't reachable from ``from``."""
    return reachable(heads_to, edges).join(reachable(heads_from, edges), ["root", "id"], "left_anti")


def children(files: DataFrame, folder: str) -> DataFrame:
    """(repo, name, type, size): direct children of a folder ('' is the top) among files(repo, path, size);
    trees have no size."""
    below = files if not folder else files.where(F.startswith("path", F.lit(folder + "/")))
    rest = F.substring("path", len(folder) + 2, 4096) if folder else F.col("path")
    rows = below.select("repo", F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), F.contains(rest, F.lit("/")).alias("tree"), "size")
    return rows.groupBy("repo", "name", "tree").agg(F.max("size").alias("size")).select("repo", "name", F.when(F.col("tree"), "tree").otherwise("blob").alias("type"), F.when(~F.col("tree"), F.col("size")).alias("size"))


def refs(branches: DataFrame) -> DataFrame:
    """(repo, name, kind, is_default) of (repo, ref, head): branches and tags by their prefix; the default is
    the head if it exists, else main, master, the first by name."""
    rows = branches.select("repo", "head", F.regexp_replace("ref", "^refs/(heads|tags)/", "").alias("name"), F.when(F.startswith("ref", F.lit("refs/tags/")), "tag").otherwise("branch").alias("kind"))
    turn = F.when(F.col("name") == F.col("head"), 0).when(F.col("name") == "main", 1).when(F.col("name") == "master", 2).otherwise(3)
    first = F.row_number().over(Window.partitionBy("repo", "kind").orderBy(turn, "name")) == 1
    return rows.select("repo", "name", "kind", (first & (F.col("kind") == "branch")).alias("is_default"))


def blob_text(content: Column, size: Column) -> Column:
    """The text of a blob, or a note for one above the limit."""
    return F.when(size <= BLOB_LIMIT, content).otherwise(F.concat(F.lit("too large: "), size.cast("string"), F.lit(" bytes")))


def raw(files: DataFrame, repo: str, path: str) -> DataFrame:
    """(repo, path, content): the bytes of one file of a repository, no row if there is none."""
    return files.where((F.col("repo") == repo) & (F.col("path") == path)).select("repo", "path", F.col("content").cast("binary").alias("content"))


def of_path(commits: DataFrame, stats: DataFrame, path: Column) -> DataFrame:
    """Commits (id) that touch a file for which ``path``, a condition on stats (commit_id, path), holds."""
    return commits.join(stats.where(path).select(F.col("commit_id").alias("id")).distinct(), "id", "left_semi")


def compared_files(heads_from: DataFrame, heads_to: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """(root, path, commits, additions, deletions): per file what the commits of ``to`` that ``from`` lacks
    change; null counts, of binary files, add nothing."""
    rows = compared(heads_from, heads_to, edges).join(stats.withColumnRenamed("commit_id", "id"), "id")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return rows.groupBy("root", "path").agg(F.count(F.lit(1)).alias("commits"), total("additions").alias("additions"), total("deletions").alias("deletions"))
