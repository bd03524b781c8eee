"""Queries: catalog, change history, ingest and jobs, conversations, vocabulary, codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.operators import catalog, codec, dense, ground, history, ingest, lexical, lexicon
from fathomline.queries.retrieval import _GOLD, _RANK
from fathomline.session import materialize, table

BOUNDS = [-0.12, 0.0, 0.12]
LEVELS = [-0.18, -0.06, 0.06, 0.18]


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").where("container_id is not null").select(F.col("container_id").alias("path")).distinct()


def catalog_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.rolled_up(_containers(spark, folder))


def catalog_tenants(spark: SparkSession, folder: str) -> DataFrame:
    overlay = table(spark, folder, "nation").select(F.lower("n_name").alias("tenant"), F.col("n_name").alias("title"))
    return catalog.tenants(_containers(spark, folder), overlay)


def project_subtree(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.subtree(_containers(spark, folder), "kontor/bestand")


def path_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").select(F.coalesce("container_id", F.lit("")).alias("path"), "source", "seq").distinct()
    return rows.select("path", "source", "seq", catalog.valid_path(F.col("path")).alias("ok_path"), catalog.valid_ref(F.col("source")).alias("ok_ref"), catalog.valid_file(F.col("source")).alias("ok_file"), catalog.parsed_id(F.concat(F.lit("ns:"), F.replace("path", F.lit("/"), F.lit(":")))).alias("parsed"), catalog.clamped_k(F.col("seq")).alias("k"))


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("title"))


def commit_log(spark: SparkSession, folder: str) -> DataFrame:
    return history.log(_commits(spark, folder), "repo").select("repo", "id", "n")


def commit_diff_totals(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.col("l_quantity").cast("int")
    stats = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").cast("string").alias("path"), F.when(F.col("l_returnflag") != "N", whole).alias("additions"), (whole % 7).alias("deletions"))
    return history.diff_totals(stats)


def compare_range(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository, what its newest commit has and its middle one hasn't; a commit has the two before
    it as parents."""
    order = Window.partitionBy("repo").orderBy("created_at", "id")
    size = F.count(F.lit(1)).over(Window.partitionBy("repo"))
    rows = _commits(spark, folder).withColumns({"n": F.row_number().over(order), "size": size, "p1": F.lag("id", 1).over(order), "p2": F.lag("id", 2).over(order)})
    edges = rows.select("id", F.explode(F.array_compact(F.array("p1", "p2"))).alias("parent"))
    return history.compared(rows.where("n = (size + 1) div 2").select(F.col("repo").alias("root"), "id"), rows.where("n = size").select(F.col("repo").alias("root"), "id"), edges)


def tree_children(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "chunks").where("source is not null").groupBy(F.col("container_id").alias("repo"), F.col("source").alias("path")).agg(F.sum(F.length("text")).alias("size"))
    return history.children(files, "").unionByName(history.children(files, "scan"))


def repo_refs(spark: SparkSession, folder: str) -> DataFrame:
    ref = F.concat(F.when(F.col("o_orderstatus") == "F", "refs/tags/").otherwise("refs/heads/"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")))
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("repo"), ref.alias("ref"), F.when(F.col("o_custkey") % 2 == 0, "medium").alias("head")).distinct()
    return history.refs(rows)


def blob_texts(spark: SparkSession, folder: str) -> DataFrame:
    size = F.octet_length("text").cast("long") * F.when(F.col("doc_id") % 3 == 0, 10000).otherwise(1)
    return table(spark, folder, "documents").select("doc_id", history.blob_text(F.col("text"), size).alias("content"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", F.when(F.col("event_type") == "purchase", "git.push").otherwise(F.col("event_type")).alias("type"), F.concat(F.lit("t/u"), "user_id").alias("container_id"), _k().alias("k"), "value")


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).where("type = 'click'")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "sealed", "failed"))), (F.col("k") % 4 + 1).cast("int"))
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")))
    started = F.when(F.col("k") % 4 > 0, F.timestamp_micros(F.unix_micros(at) + F.col("k") * 1_000_000))
    ended = F.when(F.col("k") % 4 > 1, F.timestamp_micros(F.unix_micros(at) + F.col("k") * 1_000_000 + F.round(F.col("value") * 1000).cast("long") * 1000))
    return rows.select(F.col("event_id").alias("id"), "container_id", status.alias("status"), at.alias("triggered_at"), started.alias("started_at"), ended.alias("finished_at"))


def _state(spark: SparkSession, folder: str) -> DataFrame:
    mode = F.when(F.col("c_mktsegment") == "BUILDING", "build").when(F.col("c_mktsegment") == "MACHINERY", "atomize").when(F.col("c_mktsegment") == "FURNITURE", "other").when(F.col("c_mktsegment") != "HOUSEHOLD", "build")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("t/u"), "c_custkey").alias("container_id"), (F.col("c_nationkey") != 3).alias("has_repo"), (F.col("c_nationkey") != 5).alias("has_head"), mode.alias("mode"),
        F.when(F.col("c_nationkey") == 7, "ingest@local").otherwise("user@local").alias("author_email"),
        F.when(F.col("c_nationkey") != 9, ingest.source_key(F.array(F.sha1(F.col("c_name")), F.sha1(F.col("c_mktsegment"))))).alias("source_key"),
        F.when(F.col("c_custkey") % 3 == 0, ingest.source_key(F.array(F.sha1(F.col("c_mktsegment")), F.sha1(F.col("c_name"))))).alias("built_key"),
    )


def push_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.decided(_events(spark, folder), _state(spark, folder), _jobs(spark, folder), "ingest@local").select("event_id", "container_id", "decision")


def active_job_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.without_active(_state(spark, folder).select("container_id"), _jobs(spark, folder))


def oldest_queued(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.oldest_queued(_jobs(spark, folder), "container_id").select("container_id", "id")


def job_durations(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.durations(_jobs(spark, folder)).select("id", F.round("duration_seconds", 3).alias("duration_seconds"))


def job_states(spark: SparkSession, folder: str) -> DataFrame:
    """All jobs after the changes that views, signups and errors report; a change is about its container's
    latest job before it, and without one about none."""
    jobs = _jobs(spark, folder).withColumn("error", F.lit(None).cast("string"))
    status = F.when(F.col("type") == "view", "running").when(F.col("type") == "signup", "sealed").when(F.col("type") == "error", "failed")
    so_far = Window.partitionBy("container_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    about = F.last(F.when(F.col("type") == "click", F.col("event_id")), ignorenulls=True).over(so_far)
    changes = _events(spark, folder).where("type in ('click', 'view', 'signup', 'error')").select("type", about.alias("id"), F.col("ts").cast("timestamp").alias("at")).where("type <> 'click' and id is not null")
    changes = changes.select("id", status.alias("status"), "at", F.lit(None).cast("string").alias("error"))
    return ingest.moved_on(jobs, changes).select("id", "container_id", "status")


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    role = F.when(F.col("event_type") == "error", "system").when(F.col("event_type").isin("click", "view"), "user").otherwise("assistant")
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    return table(spark, folder, "events").select(F.col("user_id").alias("conv_id"), turn.alias("turn"), role.alias("role"), F.concat_ws(" ", "event_type", "props").alias("text"))


def last_user_turn(spark: SparkSession, folder: str) -> DataFrame:
    return ground.last_user_turns(_messages(spark, folder))


def system_merge(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("conv_id"), F.concat(F.lit("Known: "), "c_name").alias("block"))
    return ground.grounded(_messages(spark, folder), blocks)


def message_parts(spark: SparkSession, folder: str) -> DataFrame:
    part = F.struct(F.when(F.col("event_type") == "error", "image").otherwise("text").alias("type"), F.col("props").alias("text"))
    rows = table(spark, folder, "events").select("event_id", F.array(part, F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text"))).alias("parts"))
    return rows.select("event_id", ground.text_of(F.col("parts")).alias("text"))


def context_block(spark: SparkSession, folder: str) -> DataFrame:
    gold, chunks = table(spark, folder, "gold"), table(spark, folder, "chunks")
    ranked = lexical.bm25_top(chunks, "row_id", F.col("text"), lexical.query_terms(gold, "q_id", F.col("q")), 3)
    matches = ranked.join(chunks.select(F.col("row_id").alias("id"), "container_id", "source", "text"), "id")
    return ground.or_nothing_found(gold, ground.context_blocks(matches))


def lexicon_counts(spark: SparkSession, folder: str) -> DataFrame:
    phrases = table(spark, folder, "claims_in").where("attribute is not null").select(F.col("attribute").alias("phrase")).distinct()
    return lexicon.vocabulary(table(spark, folder, "documents"), F.col("text"), phrases)


def fuzzy_correct(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the gold questions against those of three documents or more."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    known = table(spark, folder, "documents").select("doc_id", words.alias("word")).distinct().groupBy("word").count().where("count >= 3").select("word")
    asked = table(spark, folder, "gold").select(F.explode(F.regexp_extract_all(F.lower("q"), F.lit(r"\p{L}+|[0-9]+"), F.lit(0))).alias("word"))
    return lexicon.corrected(asked, known)


def stratified_holdout(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.held_out(table(spark, folder, "documents").withColumn("doc_type", F.coalesce("doc_type", F.lit("none"))), "doc_id", "doc_type")


def accuracy_by_type(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "reading_labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    rows = labels.groupBy("doc_id", "lang").agg(F.max("grade").alias("best"), F.min("grade").alias("least"), F.round(F.avg("grade")).cast("int").alias("mean"))
    done = lexicon.accuracy(rows.withColumn("lang", F.coalesce("lang", F.lit("none"))), "lang", "best", "least", "mean")
    return done.select("lang", "n", F.round("raw_accuracy", 6).alias("raw_accuracy"), F.round("fixed_accuracy", 6).alias("fixed_accuracy"))


def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").groupBy("p_type").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "p_type").limit(12)


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vectors").where(dense.usable(F.col("embedding"), 64)).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column) -> Column:
    return F.zip_with(v, F.array_repeat(F.sqrt(_dot(v, v)), F.size(v)), lambda x, n: x / n)


def lloyd_encode(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder).select("vec_id", F.array_join(codec.codes(_unit(F.col("v")), BOUNDS), "").alias("codes"))


def cosine_fidelity(spark: SparkSession, folder: str) -> DataFrame:
    unit = _unit(F.col("v"))
    back = F.transform(codec.codes(unit, BOUNDS), lambda c: F.element_at(F.array(*map(F.lit, LEVELS)), c + 1))
    rows = _units(spark, folder).select(unit.alias("u"), back.alias("b"))
    return rows.agg(F.count(F.lit(1)).alias("n_vectors"), F.round(F.avg(_dot(F.col("u"), F.col("b")) / F.sqrt(_dot(F.col("b"), F.col("b")))), 6).alias("cos_fidelity"))


def score_recall10(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed levels' neighbours against the exact ones, by true scores."""
    rows = _units(spark, folder)
    back = materialize(rows.select("vec_id", F.transform(codec.codes(_unit(F.col("v")), BOUNDS), lambda c: F.element_at(F.array(*map(F.lit, LEVELS)), c + 1)).alias("b")))
    units, approx = dense.with_units(rows, "vec_id", F.col("v"), 64), dense.with_units(back, "vec_id", F.col("b"), 64)
    units, approx = materialize(units), materialize(approx)
    exact = dense.exact_nearest(units, units.where("id % 20 = 0"), 64, 10)
    near = dense.exact_nearest(approx, approx.where("id % 20 = 0"), 64, 10)
    return codec.score_recall(exact, near, codec.true_scores(near, units)).select("queries", F.round("score_recall", 6).alias("score_recall"))


def quantization_cards(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "vectors")
    units, out = materialize(dense.with_units(vectors, "vec_id", F.col("embedding"), 64)), None
    bins = codec.histogram(vectors, F.col("embedding"), 64)
    exact = materialize(dense.exact_nearest(units, units.where("id % 20 = 0"), 64, 10))
    for bits in (1, 2, 3, 4):
        book = codec.fit(vectors, "vec_id", F.col("embedding"), 64, bits, bins=bins)
        now = codec.card(units, codec.encoded(vectors, "vec_id", F.col("embedding"), book), book, exact=exact)
        out = now if out is None else out.unionByName(now)
    return out


QUERIES = {f.__name__: f for f in (
    catalog_rollup, catalog_tenants, project_subtree, path_rules, commit_log, commit_diff_totals, compare_range, tree_children, repo_refs, blob_texts,
    push_decisions, active_job_antijoin, oldest_queued, job_durations, job_states, last_user_turn, system_merge, message_parts, context_block,
    lexicon_counts, fuzzy_correct, stratified_holdout, accuracy_by_type, class_counts, lloyd_encode, cosine_fidelity, score_recall10, quantization_cards,
)}

_CT = "c AS (SELECT DISTINCT container_id AS path, string_split(container_id, '/') AS p FROM chunks WHERE container_id IS NOT NULL)"
_JOBS = """j AS (SELECT event_id AS id, 't/u' || user_id AS container_id, ['queued', 'running', 'sealed', 'failed'][CAST(k % 4 AS INT) + 1] AS status, epoch_us(ts) AS t,
  CASE WHEN k % 4 > 0 THEN epoch_us(ts) + k * 1000000 END AS s, CASE WHEN k % 4 > 1 THEN epoch_us(ts) + k * 1000000 + CAST(round(value * 1000) AS BIGINT) * 1000 END AS f
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events) WHERE event_type = 'click')"""
_MSG = """m AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS turn, CASE WHEN event_type = 'error' THEN 'system' WHEN event_type IN ('click', 'view') THEN 'user' ELSE 'assistant' END AS role, event_type || ' ' || props AS text FROM events)"""
_V = f"""v AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)),
q AS (SELECT vec_id, u, list_transform(u, lambda x: CAST(x > {BOUNDS[0]} AS INT) + CAST(x > {BOUNDS[1]} AS INT) + CAST(x > {BOUNDS[2]} AS INT)) AS c FROM v),
d AS (SELECT vec_id, u, c, list_transform(c, lambda k: {LEVELS}[k + 1]::DOUBLE) AS b FROM q)"""

ORACLE = {
    "catalog_rollup": f"WITH {_CT}, x AS (SELECT array_to_string(p[1:n], '/') AS path, n FROM (SELECT p, unnest(range(1, greatest(len(p) - 1, 1) + 1)) AS n FROM c)) SELECT path, CASE WHEN n > 1 THEN regexp_replace(path, '/[^/]*$', '') END AS parent_path, CAST(n AS INT) AS depth, count(*) AS containers FROM x GROUP BY 1, 2, 3",
    "catalog_tenants": f"WITH {_CT}, t AS (SELECT p[1] AS tenant, count(*) AS n, count(DISTINCT CASE WHEN len(p) > 2 THEN p[2] END) AS k FROM c GROUP BY 1) SELECT coalesce(t.tenant, lower(n_name)) AS tenant, coalesce(n, 0) AS containers, coalesce(k, 0) AS projects, coalesce(n_name, t.tenant) AS title FROM t FULL JOIN nation ON t.tenant = lower(n_name)",
    "project_subtree": f"WITH {_CT} SELECT path FROM c WHERE path = 'kontor/bestand' OR starts_with(path, 'kontor/bestand/')",
    "path_rules": r"""SELECT path, source, seq, len(string_split(path, '/')) BETWEEN 2 AND 12 AND len(list_filter(string_split(path, '/'), lambda x: NOT regexp_matches(x, '^[A-Za-z0-9._-]+$'))) = 0 AS ok_path,
  coalesce(regexp_matches(source, '^[A-Za-z0-9._/-]+$') AND length(source) < 256 AND NOT starts_with(source, '-'), false) AS ok_ref, coalesce(length(source) < 1024 AND NOT contains(source, '..'), false) AS ok_file, path AS parsed,
  CAST(least(greatest(CASE WHEN coalesce(seq, 0) = 0 THEN 8 ELSE seq END, 1), 30) AS INT) AS k FROM (SELECT DISTINCT coalesce(container_id, '') AS path, source, seq FROM chunks)""",
    "commit_log": "SELECT repo, id, n FROM (SELECT o_custkey AS repo, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS n FROM orders) WHERE n <= 30",
    "commit_diff_totals": "SELECT l_orderkey AS commit_id, count(*) AS files, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(trunc(l_quantity) AS INT) ELSE 0 END) AS BIGINT) AS additions, CAST(sum(CAST(trunc(l_quantity) AS INT) % 7) AS BIGINT) AS deletions FROM lineitem GROUP BY 1",
    "compare_range": "SELECT o_custkey AS root, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders) WHERE n > (size + 1) // 2",
    "tree_children": """WITH f AS (SELECT container_id AS repo, source AS path, CAST(sum(length(text)) AS BIGINT) AS size FROM chunks WHERE source IS NOT NULL GROUP BY 1, 2),
r AS (SELECT 0 AS k, repo, path AS rest, size FROM f UNION ALL SELECT 1, repo, substr(path, 6), size FROM f WHERE starts_with(path, 'scan/'))
SELECT repo, string_split(rest, '/')[1] AS name, CASE WHEN contains(rest, '/') THEN 'tree' ELSE 'blob' END AS type, CASE WHEN NOT contains(rest, '/') THEN max(size) END AS size FROM r GROUP BY k, repo, string_split(rest, '/')[1], contains(rest, '/')""",
    "repo_refs": """WITH r AS (SELECT DISTINCT o_custkey AS repo, CASE WHEN o_orderstatus = 'F' THEN 'tag' ELSE 'branch' END AS kind, lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS name, CASE WHEN o_custkey % 2 = 0 THEN 'medium' END AS head FROM orders)
SELECT repo, name, kind, kind = 'branch' AND row_number() OVER (PARTITION BY repo, kind ORDER BY CASE WHEN name = head THEN 0 WHEN name = 'main' THEN 1 WHEN name = 'master' THEN 2 ELSE 3 END, name) = 1 AS is_default FROM r""",
    "blob_texts": "SELECT doc_id, CASE WHEN size <= 5242880 THEN text ELSE 'too large: ' || size || ' bytes' END AS content FROM (SELECT doc_id, text, strlen(text) * CASE WHEN doc_id % 3 = 0 THEN 10000 ELSE 1 END AS size FROM documents)",
    "push_decisions": f"""WITH {_JOBS}, p AS (SELECT event_id, 't/u' || user_id AS container_id, event_id = first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events WHERE event_type = 'purchase'),
a AS (SELECT DISTINCT container_id FROM j WHERE status IN ('queued', 'running'))
SELECT event_id, p.container_id, CASE WHEN c_custkey IS NULL OR c_nationkey = 3 THEN 'no-repo' WHEN c_nationkey = 5 THEN 'empty-repo' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'no-ingest-config' WHEN c_mktsegment = 'FURNITURE' THEN 'bad-mode'
  WHEN c_nationkey = 7 THEN 'own-writeback' WHEN c_nationkey = 9 THEN 'source-path-missing' WHEN c_custkey % 3 = 0 THEN 'unchanged-source' WHEN a.container_id IS NOT NULL OR NOT first THEN 'active-job-exists' ELSE 'enqueue' END AS decision
FROM p LEFT JOIN customer ON p.container_id = 't/u' || c_custkey LEFT JOIN a ON a.container_id = p.container_id""",
    "active_job_antijoin": f"WITH {_JOBS} SELECT 't/u' || c_custkey AS container_id FROM customer WHERE 't/u' || c_custkey NOT IN (SELECT container_id FROM j WHERE status IN ('queued', 'running'))",
    "oldest_queued": f"WITH {_JOBS} SELECT container_id, id FROM (SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY t, id) AS n FROM j WHERE status = 'queued') WHERE n = 1",
    "job_durations": f"WITH {_JOBS} SELECT id, round((f - s) / 1000000.0, 3)::DOUBLE AS duration_seconds FROM j",
    "job_states": f"""WITH {_JOBS}, ev AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS job FROM events WHERE event_type IN ('click', 'view', 'signup', 'error')),
ch AS (SELECT job AS id, CASE event_type WHEN 'view' THEN 'running' WHEN 'signup' THEN 'sealed' ELSE 'failed' END AS new, row_number() OVER (PARTITION BY job ORDER BY ts, CASE event_type WHEN 'view' THEN 'running' WHEN 'signup' THEN 'sealed' ELSE 'failed' END) AS n FROM ev WHERE event_type <> 'click' AND job IS NOT NULL),
st AS (SELECT j.id, container_id, status, CASE WHEN status = 'running' THEN 0 WHEN status = 'queued' THEN (SELECT min(n) FROM ch WHERE ch.id = j.id AND new = 'running') END AS began FROM j)
SELECT id, container_id, CASE WHEN status IN ('sealed', 'failed') OR began IS NULL THEN status ELSE coalesce((SELECT min_by(new, n) FROM ch WHERE ch.id = st.id AND n > began AND new <> 'running'), 'running') END AS status FROM st""",
    "context_block": f"""WITH {_GOLD}, m AS (SELECT q_id, rk, score, container_id, source, text FROM (SELECT *, {_RANK} AS rk FROM s) r JOIN chunks ON r.id = row_id WHERE rk <= 3),
b AS (SELECT q_id, string_agg('[' || rk || '] ' || coalesce(container_id, '') || ' / ' || coalesce(source, '') || ' (score ' || CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS VARCHAR) || ')' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rk) AS block, count(*) AS passages FROM m GROUP BY 1)
SELECT gold.q_id, coalesce(block, 'No matching passage was found.') AS block, coalesce(passages, 0) AS passages FROM gold LEFT JOIN b ON b.q_id = gold.q_id""",
    "last_user_turn": f"WITH {_MSG} SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM m WHERE role = 'user') WHERE n = 1",
    "system_merge": f"""WITH {_MSG}, b AS (SELECT c_custkey AS conv_id, 'Known: ' || c_name AS block FROM customer WHERE c_custkey % 2 = 0)
SELECT m.* FROM m WHERE conv_id NOT IN (SELECT conv_id FROM b)
UNION ALL SELECT conv_id, 0, 'system', concat_ws(chr(10) || chr(10), string_agg(CASE WHEN role = 'system' THEN text END, chr(10) || chr(10) ORDER BY turn), any_value(block)) FROM m JOIN b USING (conv_id) GROUP BY 1
UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn), role, text FROM m JOIN b USING (conv_id) WHERE role <> 'system'""",
    "message_parts": "SELECT event_id, CASE WHEN event_type = 'error' THEN event_type ELSE props || ' ' || event_type END AS text FROM events",
    "lexicon_counts": r"""WITH a AS (SELECT DISTINCT lower(attribute) AS t, attribute FROM claims_in WHERE attribute IS NOT NULL),
w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word, 0 AS whole FROM documents UNION ALL SELECT t, 1 FROM a UNION ALL SELECT unnest(regexp_extract_all(t, '\p{L}+')), 0 FROM a)
SELECT word, count(*) AS cnt FROM w WHERE whole = 1 OR length(word) BETWEEN 2 AND 40 GROUP BY 1""",
    "fuzzy_correct": r"""WITH k AS (SELECT word FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 3),
a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(q), '\p{L}+|[0-9]+')) AS word FROM gold),
p AS (SELECT a.word, k.word AS other, CAST(levenshtein(a.word, k.word) AS INT) AS d FROM a JOIN k ON abs(length(a.word) - length(k.word)) <= 2 WHERE regexp_matches(a.word, '^\p{L}+$') AND a.word NOT IN (SELECT word FROM k) AND levenshtein(a.word, k.word) <= 2),
b AS (SELECT word, d, count(*) AS n, min(other) AS other FROM p WHERE d = (SELECT min(d) FROM p x WHERE x.word = p.word) GROUP BY 1, 2)
SELECT a.word, CASE WHEN n = 1 THEN other ELSE a.word END AS corrected, CASE WHEN n = 1 THEN d END AS distance FROM a LEFT JOIN b USING (word)""",
    "stratified_holdout": "WITH r AS (SELECT coalesce(doc_type, 'none') AS doc_type, doc_id, row_number() OVER (PARTITION BY coalesce(doc_type, 'none') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n, count(*) OVER (PARTITION BY coalesce(doc_type, 'none')) AS c FROM documents) SELECT doc_type, doc_id FROM r WHERE n <= greatest(1, round_even(c * 0.15, 0))",
    "accuracy_by_type": """WITH r AS (SELECT doc_id, coalesce(lang, 'none') AS lang, max(grade) AS best, min(grade) AS least, CAST(round(avg(grade)) AS INT) AS mean FROM reading_labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, count(*) AS n, round(avg(CAST(best = least AS INT)), 6) AS raw_accuracy, round(avg(CAST(best = mean AS INT)), 6) AS fixed_accuracy FROM r GROUP BY ROLLUP (lang)""",
    "class_counts": "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "lloyd_encode": f"WITH {_V} SELECT vec_id, array_to_string(c, '') AS codes FROM d",
    "cosine_fidelity": f"WITH {_V} SELECT count(*) AS n_vectors, round(avg(list_cosine_similarity(u, b)), 6) AS cos_fidelity FROM d",
    "score_recall10": f"""WITH {_V}, s AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_cosine_similarity(a.u, b.u), 6) AS e, round(list_cosine_similarity(a.b, b.b), 6) AS x FROM d a JOIN d b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY e DESC, id) AS re, row_number() OVER (PARTITION BY q ORDER BY x DESC, id) AS rx FROM s)
SELECT count(DISTINCT q) AS queries, round(sum(e) FILTER (WHERE rx <= 10) / sum(e) FILTER (WHERE re <= 10), 6) AS score_recall FROM r""",
}
