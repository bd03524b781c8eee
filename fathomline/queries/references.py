"""Queries of the orphan operator over index_order, claims_in and boxes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.keys import plain_key
from fathomline.operators import orphans as O
from fathomline.session import materialize, table


def events(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _events({n: table(spark, folder, n) for n in ("chunks", "index_order", "claims_in", "boxes", "fulltext")})


def _events(of: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All references, and all arrivals and deletions of what they refer to. The scope is the container
    of an index entry, and empty for documents."""
    owner = F.concat(F.lit("in:"), F.col("container_id"))
    claims = of["claims_in"].select("row_id", "made_at", F.explode(F.array_distinct(F.transform("docs", plain_key))).alias("doc"))
    refs = (
        O.references(of["index_order"], "index_order", "row_id", "id", "indexed_at", F.coalesce(owner, F.lit("none")))
        .unionByName(O.references(claims, "claims_in", "row_id", "doc", "made_at"))
        .unionByName(O.references(of["boxes"], "boxes", "row_id", "doc", "read_at"))
    )
    changes = O.parent_changes(of["chunks"], "id", "built_at", "dropped_at", owner).unionByName(O.parent_changes(of["fulltext"], "doc", "received_at", "deleted_at"))
    return refs, changes


def _years(refs: DataFrame) -> list:
    first, last = refs.agg(F.year(F.min("t")), F.year(F.max("t"))).first()
    return [] if first is None else [dt.datetime(y, 1, 1, tzinfo=dt.UTC) for y in range(first + 1, last + 1)]


def history(spark: SparkSession, folder: str) -> tuple[DataFrame, list[O.OrphanState], list]:
    """The history taken in year by year: judged references, states, and the bounds."""
    refs, changes = map(materialize, events(spark, folder))  # every increment reads them
    bounds = _years(refs)
    return (*O.replay(refs, changes, bounds), bounds)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    judged, _, _ = history(spark, folder)
    return judged.where("orphan").select("tab", "row_id", F.col("key").alias("ref_key"))


def p2_by_month(spark: SparkSession, folder: str) -> DataFrame:
    judged, _, _ = history(spark, folder)
    return O.by_month(judged)


def p2_waiting(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot at the end of each year, and of the history: references that then wait for a parent."""
    _, states, bounds = history(spark, folder)
    out = None
    for state, end in zip(states, [*(f"{b:%Y}" for b in bounds), "now"], strict=True):
        now = O.waiting(state).select(F.lit(end).alias("before"), "tab", "waiting")
        out = now if out is None else out.unionByName(now)
    return out


def p2_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """The references of earlier years whose waiting a year's arrivals end, or that its deletions reopen."""
    _, states, bounds = history(spark, folder)
    out = spark.createDataFrame([], "before string, tab string, row_id bigint, ref_key string, change string")
    for state, after, _, high in zip(states[:-1], states[1:], bounds, [*bounds[1:], None], strict=True):
        now = O.transitions(state, after.refs[-1], after.changes[-1])
        out = out.unionByName(now.select(F.lit(f"{high:%Y}" if high else "now").alias("before"), "tab", "row_id", F.col("key").alias("ref_key"), "change"))
    return out


def p2_late(spark: SparkSession, folder: str, blocks: int = 3) -> DataFrame:
    """The orphans when the rows come in the order in which they lie in their tables, in blocks, so that many
    events are late: references are judged again when a late parent touches them, and the last verdict counts."""
    names = {n: table(spark, folder, n) for n in ("chunks", "index_order", "claims_in", "boxes", "fulltext")}
    ends = {n: t.agg(F.max("row_id")).first()[0] or 0 for n, t in names.items()}
    state, verdicts = O.OrphanState.empty(spark), None
    for b in range(blocks):
        part = {n: t.where((F.col("row_id") * blocks > ends[n] * b) & (F.col("row_id") * blocks <= ends[n] * (b + 1)) if b else F.col("row_id") * blocks <= ends[n]) for n, t in names.items()}
        state, judged = O.amend(state, *map(materialize, _events(part)))
        judged = judged.withColumn("block", F.lit(b))
        verdicts = judged if verdicts is None else verdicts.unionByName(judged)
    last = verdicts.groupBy("tab", "row_id", "key").agg(F.max_by("orphan", "block").alias("orphan"))
    return last.where("orphan").select("tab", "row_id", F.col("key").alias("ref_key"))


QUERIES = {f.__name__: f for f in (p2_found, p2_by_month, p2_waiting, p2_transitions, p2_late)}

_BASE = r"""
WITH parents AS (
  SELECT 'in:' || container_id AS scope, lower(regexp_replace(id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS key, built_at AS a, dropped_at AS g FROM chunks
  UNION ALL SELECT '', lower(regexp_replace(doc, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), received_at, deleted_at FROM fulltext),
raw AS (
  SELECT 'index_order' AS tab, row_id, 'in:' || container_id AS scope, id AS ref, indexed_at AS t FROM index_order
  UNION ALL SELECT 'claims_in', row_id, '', unnest(docs), made_at FROM claims_in
  UNION ALL SELECT 'boxes', row_id, '', doc, read_at FROM boxes),
clean AS (SELECT tab, row_id, scope, lower(regexp_replace(ref, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS key, t FROM raw),
keyed AS (SELECT DISTINCT * FROM clean WHERE key <> '' AND t IS NOT NULL),
judged AS (SELECT k.*, NOT EXISTS (SELECT 1 FROM parents p WHERE p.scope = k.scope AND p.key = k.key AND p.a <= k.t AND (p.g IS NULL OR p.g > k.t)) AS orphan FROM keyed k)
"""
_WAITING = """, ends AS (SELECT DISTINCT year(make_timestamp(epoch_us(t))) AS y FROM keyed),
marks AS (SELECT CAST(y AS VARCHAR) AS before, epoch_us(make_timestamp(y, 1, 1, 0, 0, 0)) AS at FROM (SELECT unnest(range(min(y) + 1, max(y) + 1)) AS y FROM ends)
  UNION ALL SELECT 'now', 9000000000000000)
SELECT m.before, k.tab, CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.scope = k.scope AND p.key = k.key AND epoch_us(p.a) < m.at AND (p.g IS NULL OR epoch_us(p.g) >= m.at))) AS BIGINT) AS waiting
FROM marks m JOIN keyed k ON epoch_us(k.t) < m.at GROUP BY 1, 2"""

_CHANGES = """, ends AS (SELECT DISTINCT year(make_timestamp(epoch_us(t))) AS y FROM keyed),
marks AS (SELECT y, epoch_us(make_timestamp(y, 1, 1, 0, 0, 0)) AS low, CASE WHEN y = (SELECT max(y) FROM ends) THEN 9000000000000000 ELSE epoch_us(make_timestamp(y + 1, 1, 1, 0, 0, 0)) END AS high,
  CASE WHEN y = (SELECT max(y) FROM ends) THEN 'now' ELSE CAST(y + 1 AS VARCHAR) END AS before FROM (SELECT unnest(range(min(y) + 1, max(y) + 1)) AS y FROM ends)),
st AS (SELECT m.before, k.tab, k.row_id, k.key, EXISTS (SELECT 1 FROM parents p WHERE p.scope = k.scope AND p.key = k.key AND epoch_us(p.a) < m.low AND (p.g IS NULL OR (p.g > p.a AND epoch_us(p.g) >= m.low))) AS was,
  EXISTS (SELECT 1 FROM parents p WHERE p.scope = k.scope AND p.key = k.key AND epoch_us(p.a) < m.high AND (p.g IS NULL OR (p.g > p.a AND epoch_us(p.g) >= m.high))) AS now FROM marks m JOIN keyed k ON epoch_us(k.t) < m.low)
SELECT before, tab, row_id, key AS ref_key, CASE WHEN now THEN 'resolved' ELSE 'reopened' END AS change FROM st WHERE was <> now"""

ORACLE = {
    "p2_transitions": _BASE.rstrip() + _CHANGES,
    "p2_late": _BASE + "SELECT tab, row_id, key AS ref_key FROM judged WHERE orphan",
    "p2_found": _BASE + "SELECT tab, row_id, key AS ref_key FROM judged WHERE orphan",
    "p2_by_month": _BASE + "SELECT tab, strftime(make_timestamp(epoch_us(t)), '%Y-%m') AS month, count(*) AS refs, count(*) FILTER (WHERE orphan) AS orphans FROM judged GROUP BY 1, 2",
    "p2_waiting": _BASE.rstrip() + _WAITING,
}
