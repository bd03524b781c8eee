"""Queries: what sinks write as it is read back, catalog requests, ingest chains, changes by file, headers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.operators import catalog, codec, ground, history, ingest
from fathomline.queries import verification
from fathomline.queries.records import _commits, _containers, _events, _state
from fathomline.queries.retrieval import _GOLD, _RANK, _gold_top
from fathomline.session import materialize, shared_folder, table
from fathomline.sources import containers as C
from fathomline.sources import io

LEVELS = [-0.18, -0.06, 0.06, 0.18]


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/container-{uuid.uuid4().hex}"


def _built(spark: SparkSession, folder: str) -> str:
    path = _place(spark)
    chunks = table(spark, folder, "chunks").withColumn("at", F.col("row_id")).drop("pos").withColumnRenamed("at", "pos")
    C.write_container_files(chunks, path, "container:all", "docs", "All chunks", "none", 64, "f32")
    return path


def container_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a container as its JSON lines have them."""
    return io.json_lines(spark, f"{_built(spark, folder)}/{C.CHUNKS}", "row_id bigint, " + io.CHUNK).select("row_id", "id", "doc", "source", "seq", "text")


def container_index(spark: SparkSession, folder: str) -> DataFrame:
    path = _built(spark, folder)
    index = spark.read.schema("model string, dims int, count bigint, store string, kind string").json(f"{path}/{C.INDEX}")
    about = spark.read.schema("id string, type string, doc_count bigint, chunk_count bigint").json(f"{path}/{C.MANIFEST}")
    order = spark.read.schema("pos bigint, id string").json(f"{path}/{C.ORDER}").agg(F.count(F.lit(1)).alias("entries"), F.count("id").alias("ids"))
    return index.join(about).join(order)  # a row each


def raw_vector_file(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written as raw numbers and read back: their places and sums; unusable ones are zeros."""
    path = _place(spark)
    C.write_raw_vectors(table(spark, folder, "vectors").select(F.col("vec_id").alias("pos"), "embedding"), path, 64)
    return io.raw_vectors(spark, path, 64).select("pos", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _store(spark: SparkSession, folder: str) -> str:
    path = _place(spark)
    C.write_store(table(spark, folder, "vectors"), "vec_id", F.col("embedding"), codec.Codebook(2, 64, 0, np.array(LEVELS), np.eye(64)), path)
    return path


def store_card(spark: SparkSession, folder: str) -> DataFrame:
    return C.store_info(spark, _store(spark, folder)).select(F.col("vectors").cast("long").alias("vectors"), "dims", "bits", "codebook", (F.col("bytes") > 0).alias("stored"))


def store_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The signs of the vectors that a store of fixed levels gives back."""
    rows = C.load_store(spark, _store(spark, folder))
    return rows.select(F.col("id").alias("vec_id"), F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "+").otherwise("-")), "").alias("signs"))


def atoms_report(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    C.write_atoms(verification.atom_verdicts(spark, folder), path, "container:atoms", "Atoms", "value in the band of its label")
    report = spark.read.schema("claims bigint, verdicts map<string,bigint>").json(f"{path}/{C.REPORT}")
    return report.select("claims", F.explode("verdicts").alias("verdict", "n"))


def claims_container(spark: SparkSession, folder: str) -> DataFrame:
    """Claims as a container without vectors: equal texts keep their places."""
    path = _place(spark)
    rows = table(spark, folder, "claims_in").select(F.col("row_id").alias("pos"), F.substring(F.sha1(F.concat_ws(" ", "subject", "attribute", "value")), 1, 16).alias("id"), F.lit("claims").alias("doc"))
    C.write_claims_container(rows, path, "container:claims", "Claims")
    return spark.read.schema("pos bigint, id string").json(f"{path}/{C.ORDER}")


def flat_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.flat(_containers(spark, folder))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for tenants, projects and containers made of customers; some names aren't allowed."""
    kind = F.element_at(F.array(*map(F.lit, ("tenant", "project", "container"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    tenant = F.when(F.col("c_custkey") % 10 == 9, "not allowed").otherwise(F.concat(F.lit("t"), (F.col("c_nationkey") % 7).cast("string")))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("request_id"), kind.alias("kind"), tenant.alias("tenant"), F.concat(F.lit("/"), F.lower("c_mktsegment"), F.lit("/p"), (F.col("c_custkey") % 5).cast("string"), F.lit("/")).alias("path"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("description"), F.col("c_mktsegment").alias("type"),
        F.when(F.col("c_custkey") % 2 == 0, "soft").alias("isolation"), F.timestamp_seconds(F.col("c_custkey") * 60).alias("created_at"),
    )


def created_overlay(spark: SparkSession, folder: str) -> DataFrame:
    overlay, _ = catalog.created(_requests(spark, folder), spark.createDataFrame([], catalog.OVERLAY))
    return overlay.select("kind", "path", "name", "type", "isolation")


def creation_answers(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.created(_requests(spark, folder), spark.createDataFrame([], catalog.OVERLAY))[1]


def project_catalog(spark: SparkSession, folder: str) -> DataFrame:
    overlay, _ = catalog.created(_requests(spark, folder), spark.createDataFrame([], catalog.OVERLAY))
    return catalog.projects(_containers(spark, folder), materialize(overlay)).select("path", "containers", "name", "type")


def grounding_headers(spark: SparkSession, folder: str) -> DataFrame:
    gold = table(spark, folder, "gold")
    blocks = _gold_top(spark, folder, 3).groupBy("q_id").agg(F.count(F.lit(1)).alias("passages"))
    return ground.told(gold, blocks)


def push_hooks(spark: SparkSession, folder: str) -> DataFrame:
    pushes = _events(spark, folder).where("type = 'git.push'").select("event_id", "container_id")
    return pushes.join(_state(spark, folder), "container_id").select("event_id", ingest.push_hook("ingest@local").alias("decision"))


def _configs(spark: SparkSession, folder: str) -> DataFrame:
    n = F.regexp_extract("container_id", "([0-9]+)$", 1).cast("long")
    return _state(spark, folder).withColumns({"has_branch": F.col("has_head"), "quantize": n % 2 == 0, "keep_raw": n % 4 == 0})


def chain_steps(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.chain(_configs(spark, folder))[0]


def chain_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.chain(_configs(spark, folder))[1]


def _line_stats(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.col("l_quantity").cast("int")
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("part/"), (F.col("l_partkey") % 100).cast("string")).alias("path"), F.when(F.col("l_returnflag") != "N", whole).alias("additions"), (whole % 7).alias("deletions"))


def commits_of_path(spark: SparkSession, folder: str) -> DataFrame:
    return history.of_path(_commits(spark, folder), _line_stats(spark, folder), F.col("path") == "part/7").select("repo", "id")


def compare_files(spark: SparkSession, folder: str) -> DataFrame:
    """What the newest commit of each repository has and the one before it hasn't, by file; a commit's parent is
    the one before it."""
    order = Window.partitionBy("repo").orderBy("created_at", "id")
    rows = _commits(spark, folder).withColumns({"n": F.row_number().over(order), "size": F.count(F.lit(1)).over(Window.partitionBy("repo")), "parent": F.lag("id").over(order)})
    heads = lambda back: rows.where(F.col("n") == F.col("size") - back).select(F.col("repo").alias("root"), "id")
    return history.compared_files(heads(1), heads(0), rows.where("n > size - 2").select("id", "parent"), _line_stats(spark, folder))


def raw_file(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "fulltext").where("text is not null").select(F.lit("all").alias("repo"), F.col("row_id").cast("string").alias("path"), F.col("text").alias("content"))
    first = files.agg(F.min(F.col("path").cast("long"))).first()[0]
    return history.raw(files, "all", str(first)).select("path", F.octet_length("content").alias("bytes"), F.md5("content").alias("md5"))


QUERIES = {f.__name__: f for f in (
    container_chunks, container_index, raw_vector_file, store_card, store_vectors, atoms_report, claims_container, flat_catalog, created_overlay, creation_answers,
    project_catalog, grounding_headers, push_hooks, chain_steps, chain_outcomes, commits_of_path, compare_files, raw_file,
)}

_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_REQ = """r AS (SELECT c_custkey AS request_id, ['tenant', 'project', 'container'][c_custkey % 3 + 1] AS kind, CASE WHEN c_custkey % 10 = 9 THEN 'not allowed' ELSE 't' || c_nationkey % 7 END AS tenant,
  lower(c_mktsegment) || '/p' || c_custkey % 5 AS inner_, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name, c_mktsegment AS type, CASE WHEN c_custkey % 2 = 0 THEN 'soft' ELSE 'hard' END AS isolation, c_custkey AS asked_at FROM customer),
f AS (SELECT *, tenant || CASE kind WHEN 'tenant' THEN '' WHEN 'project' THEN '/' || inner_ ELSE '/' || inner_ || '/c' || request_id END AS path, tenant <> 'not allowed' AS ok FROM r),
told AS (SELECT kind, path, CASE WHEN kind = 'container' THEN name ELSE coalesce(name, string_split(path, '/')[-1]) END AS name, type, CASE WHEN kind = 'tenant' THEN isolation END AS isolation
  FROM (SELECT *, row_number() OVER (PARTITION BY kind, path ORDER BY asked_at DESC) AS n FROM f WHERE ok) WHERE n = 1),
o AS (SELECT * FROM told UNION ALL SELECT DISTINCT 'tenant', tenant, tenant, NULL, 'hard' FROM f WHERE ok AND kind = 'project' AND tenant NOT IN (SELECT path FROM told WHERE kind = 'tenant'))"""
_CFG = """s AS (SELECT 't/u' || c_custkey AS container_id, c_custkey AS n, c_nationkey <> 3 AS repo, c_nationkey <> 5 AS head, CASE c_mktsegment WHEN 'BUILDING' THEN 'build' WHEN 'MACHINERY' THEN 'atomize' WHEN 'FURNITURE' THEN 'other' WHEN 'HOUSEHOLD' THEN NULL ELSE 'build' END AS mode,
  c_nationkey <> 9 AS has_key, c_custkey % 3 = 0 AS built, CASE WHEN c_nationkey = 7 THEN 'ingest@local' ELSE 'user@local' END AS author FROM customer),
c AS (SELECT *, CASE WHEN NOT repo THEN 'repository not found' WHEN NOT head THEN 'no branch with commits' WHEN mode IS NULL THEN 'ingest config missing' WHEN mode = 'other' THEN 'bad ingest mode: other' END AS error, NOT (has_key AND built) AS dirty FROM s)"""
_CT = "ct AS (SELECT DISTINCT container_id AS path, string_split(container_id, '/') AS p FROM chunks WHERE container_id IS NOT NULL)"
_ST = "st AS (SELECT l_orderkey AS commit_id, 'part/' || l_partkey % 100 AS path, CASE WHEN l_returnflag <> 'N' THEN CAST(trunc(l_quantity) AS INT) ELSE 0 END AS additions, CAST(trunc(l_quantity) AS INT) % 7 AS deletions FROM lineitem)"

ORACLE = {
    "container_chunks": "SELECT row_id, id, doc, source, seq, text FROM chunks",
    "container_index": "SELECT 'none' AS model, 64 AS dims, count(*) AS count, 'f32' AS store, 'docs' AS kind, 'container:all' AS id, 'docs' AS type, count(DISTINCT doc) AS doc_count, count(*) AS chunk_count, count(*) AS entries, count(id) AS ids FROM chunks",
    "raw_vector_file": f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, 64 AS dims, round(CASE WHEN embedding IS NOT NULL AND {_USABLE} THEN list_sum(embedding::DOUBLE[]) ELSE 0 END, 4) AS total FROM vectors",
    "store_card": f"SELECT count(*) AS vectors, 64 AS dims, 2 AS bits, 4 AS codebook, true AS stored FROM vectors WHERE {_USABLE}",
    "store_vectors": f"SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 0 THEN '+' ELSE '-' END), '') AS signs FROM vectors WHERE {_USABLE}",
    "atoms_report": verification.ORACLE["verdict_report"].replace("SELECT verdict, count(*) AS claims FROM atoms GROUP BY 1", "SELECT (SELECT count(*) FROM atoms) AS claims, verdict, count(*) AS n FROM atoms GROUP BY 2"),
    "claims_container": "SELECT row_id AS pos, substr(sha1(concat_ws(' ', subject, attribute, value)), 1, 16) AS id FROM claims_in",
    "flat_catalog": f"WITH {_CT} SELECT path, p[1] AS tenant, array_to_string(p[2:len(p) - 1], '/') AS project, p[-1] AS id FROM ct",
    "created_overlay": f"WITH {_REQ} SELECT kind, path, name, type, isolation FROM o",
    "creation_answers": f"WITH {_REQ} SELECT request_id, CASE WHEN ok THEN 201 ELSE 400 END AS status, CASE WHEN ok THEN path END AS path FROM f",
    "project_catalog": f"""WITH {_REQ}, {_CT}, a AS (SELECT array_to_string(p[1:n], '/') AS path FROM (SELECT p, unnest(range(2, len(p))) AS n FROM ct)), k AS (SELECT path, count(*) AS containers FROM a GROUP BY 1),
e AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS path FROM (SELECT p, unnest(range(2, len(p) + 1)) AS n FROM (SELECT string_split(path, '/') AS p FROM o WHERE kind = 'project')))
SELECT path, coalesce(containers, 0) AS containers, coalesce(o.name, string_split(path, '/')[-1]) AS name, o.type FROM (SELECT path FROM k UNION SELECT path FROM e) x LEFT JOIN k USING (path) LEFT JOIN (SELECT * FROM o WHERE kind = 'project') o USING (path)""",
    "grounding_headers": f"""WITH {_GOLD}, t AS (SELECT q_id, count(*) AS grounded FROM (SELECT *, {_RANK} AS rk FROM s) WHERE rk <= 3 GROUP BY 1)
SELECT gold.q_id, coalesce(grounded, 0) AS grounded, substr(replace(replace(replace(replace(replace(url_encode(coalesce(q, '')), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*'), 1, 400) AS used_query FROM gold LEFT JOIN t ON t.q_id = gold.q_id""",
    "push_hooks": f"WITH {_CFG} SELECT event_id, CASE WHEN NOT head THEN 'empty-repo' WHEN mode IS NULL THEN 'no-ingest-config' WHEN author = 'ingest@local' THEN 'own-writeback' ELSE 'spawn' END AS decision FROM events JOIN c ON container_id = 't/u' || user_id WHERE event_type = 'purchase'",
    "chain_steps": f"""WITH {_CFG}, x AS (SELECT container_id, unnest([{{'place': 1, 'step': 'clone', 'o': true}}, {{'place': 2, 'step': 'config', 'o': true}}, {{'place': 3, 'step': 'build', 'o': mode = 'build'}}, {{'place': 4, 'step': 'quantize', 'o': mode = 'build' AND n % 2 = 0}},
  {{'place': 5, 'step': 'drop-raw', 'o': mode = 'build' AND n % 2 = 0 AND n % 4 <> 0}}, {{'place': 6, 'step': 'atomize', 'o': mode = 'atomize'}}, {{'place': 7, 'step': 'marker', 'o': true}}, {{'place': 8, 'step': 'commit', 'o': dirty}}]) AS s FROM c WHERE error IS NULL)
SELECT container_id, s.place AS place, s.step AS step FROM x WHERE s.o""",
    "chain_outcomes": f"WITH {_CFG} SELECT container_id, CASE WHEN error IS NULL THEN 'sealed' ELSE 'failed' END AS status, error IS NULL AND dirty AS committed, error FROM c",
    "commits_of_path": f"WITH {_ST} SELECT o_custkey AS repo, o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT commit_id FROM st WHERE path = 'part/7')",
    "compare_files": f"""WITH {_ST}, n AS (SELECT o_custkey AS root, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT root, path, count(*) AS commits, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM n JOIN st ON commit_id = id WHERE k = 1 GROUP BY 1, 2""",
    "raw_file": "SELECT CAST(row_id AS VARCHAR) AS path, strlen(text) AS bytes, md5(text) AS md5 FROM fulltext WHERE row_id = (SELECT min(row_id) FROM fulltext WHERE text IS NOT NULL)",
}
