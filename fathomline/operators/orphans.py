"""Orphan references: keyed state of parents and of references that wait for one.

Parents arrive and are deleted, references come in; each is an event of a key at a time. A reference
is an orphan if no parent of its key is alive at its own time: one that arrived at that time counts,
one deleted at it doesn't. The state per key is how many of its parents are alive and how many
references each table made to it; the references of a key wait while nothing is alive, an arrival
resolves them, the last deletion reopens them.

A key's events are cut into days, and each day begins with what the days before it left (a sum over
days, small and pre-aggregated), so the events of one hot key spread over as many tasks as it has days. A
day in which a key has more than HOT events is cut again: its changes, added up by time, by time of day, and
its references by their row, each part with the changes it needs.

The state is kept in layers, one per increment: what the increment changed per key, and its references. An
increment reads of them only the keys it touches and rewrites nothing; MOST_LAYERS layers are added up to one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.keys import col, plain_key, utc_month
from fathomline.session import broadcast_below, materialize

#: (scope, key, t, step): a parent arrives (+1) or is deleted (-1).
CHANGES = "scope string, key string, t timestamp, step bigint"
#: (tab, row_id, scope, key, t): a reference.
REFERENCES = "tab string, row_id bigint, scope string, key string, t timestamp"
DAY = 86_400_000_000
#: Events of a key in a day that one task takes, and layers of the state that are added up to one.
HOT, MOST_LAYERS = 100_000, 16
#: Bytes of a table of keys that is broadcast at most.
BROADCAST_BYTES = 8 << 20


def parent_changes(rows: DataFrame, key, arrived, gone, scope=None) -> DataFrame:
    """Arrivals and deletions of a parent table. Null and blank keys, rows that never arrived and
    rows deleted no later than they arrived are none; a duplicate row is a parent of its own."""
    base = rows.select((F.lit("") if scope is None else col(scope)).alias("scope"), plain_key(key).alias("key"), col(arrived).alias("a"), col(gone).alias("g"))
    base = base.where("scope is not null and key is not null and a is not null and (g is null or g > a)")
    steps = F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).cast("long").alias("step")), F.struct(F.col("g").alias("t"), F.lit(-1).cast("long").alias("step"))))
    return base.select("scope", "key", steps.alias("s")).select("scope", "key", "s.t", "s.step").where("t is not null")


def references(rows: DataFrame, tab: str, row_id, key, t, scope=None) -> DataFrame:
    """References of a table; null and blank keys, and rows without a time, are none. A null scope
    matches no parent."""
    return rows.select(F.lit(tab).alias("tab"), col(row_id).cast("long").alias("row_id"), (F.lit("") if scope is None else col(scope)).alias("scope"), plain_key(key).alias("key"), col(t).alias("t")).where("key is not null and t is not null")


def _day(t) -> F.Column:
    return F.floor(F.unix_micros(t) / F.lit(DAY))


@dataclass
class OrphanState:
    """What is kept between increments, in written layers: steps (scope, key, step), the change of the parents
    alive per key; made (scope, key, tab, refs), the references made per key and table; and the events
    themselves, of which transitions and late events read the keys they touch."""

    steps: list[DataFrame]
    made: list[DataFrame]
    changes: list[DataFrame]
    refs: list[DataFrame]

    @classmethod
    def empty(cls, spark: SparkSession) -> OrphanState:
        return cls([spark.createDataFrame([], "scope string, key string, step bigint")], [spark.createDataFrame([], "scope string, key string, tab string, refs bigint")], [], [])

    def alive(self, keys: DataFrame | None = None) -> DataFrame:
        """(scope, key, alive) of the keys with parents alive; of the given keys only."""
        parts = [d if keys is None else d.join(keys, ["scope", "key"], "left_semi") for d in self.steps]
        return _union(parts).groupBy("scope", "key").agg(F.sum("step").alias("alive")).where("alive <> 0")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _touched(*events: DataFrame) -> DataFrame:
    """The keys of events, written; broadcast where they are few."""
    return broadcast_below(materialize(_union([e.select("scope", "key") for e in events]).distinct()), BROADCAST_BYTES)


def judge(refs: DataFrame, changes: DataFrame, alive: DataFrame | None = None, hot: int | None = None) -> DataFrame:
    """refs with ``orphan``: whether nothing was alive under their key at their time. ``alive`` has the
    keys' parents alive before the first of these events."""
    none, key, hot = F.lit(None), ["scope", "key"], hot or HOT
    steps = changes.select(*key, "t", F.when(F.col("step") > 0, 0).otherwise(1).alias("turn"), "step").groupBy(*key, "t", "turn").agg(F.sum("step").alias("step"))
    steps = steps.withColumns({"day": _day(F.col("t")), "tab": none.cast("string"), "row_id": none.cast("long")})
    asked = refs.select(*key, "t", F.lit(2).alias("turn"), F.lit(0).cast("long").alias("step"), _day(F.col("t")).alias("day"), "tab", "row_id")
    sizes = steps.select(*key, "day", F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(asked.select(*key, "day", F.lit(0).alias("c"), F.lit(1).alias("r")))
    sizes = sizes.groupBy(*key, "day").agg(F.sum("c").alias("c"), F.sum("r").alias("r")).where(F.col("c") + F.col("r") > hot)
    sizes = sizes.select(*key, "day", F.ceil(F.col("c") / hot).cast("int").alias("times"), F.ceil(F.col("r") / hot).cast("int").alias("rows"))
    if sizes.isEmpty():
        steps, asked = (x.withColumns({"part": F.lit(0), "times": F.lit(1)}) for x in (steps, asked))
    else:
        sizes = broadcast_below(materialize(sizes), BROADCAST_BYTES)
        parts = lambda x: x.join(sizes, [*key, "day"], "left").fillna(1, ["times", "rows"])
        steps = parts(steps).withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("rows"), F.lit(1)) - 1))).drop("rows")
        asked = parts(asked).withColumn("part", F.pmod(F.xxhash64("tab", "row_id"), F.greatest(F.col("rows"), F.lit(1))).cast("int")).drop("rows")
    events = steps.unionByName(asked)
    within = F.floor(F.pmod(F.unix_micros("t"), F.lit(DAY)) * F.greatest(F.col("times"), F.lit(1)) / F.lit(DAY)).cast("long")
    events = events.withColumn("slice", F.col("day") * 1_000_000 + within).drop("day", "times")
    slices = events.groupBy(*key, "slice").agg(F.sum(F.when(F.col("part") == 0, F.col("step")).otherwise(0)).alias("step"), F.max("part").alias("last"))
    if alive is not None:
        slices = slices.unionByName(alive.select(*key, F.lit(-(2**62)).cast("long").alias("slice"), F.col("alive").alias("step"), F.lit(0).alias("last")))
    before = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("step", F.coalesce(F.sum("step").over(before), F.lit(0))).where("step <> 0").withColumn("part", F.explode(F.sequence(F.lit(0), "last")))
    events = events.unionByName(carried.select(*key, none.cast("timestamp").alias("t"), F.lit(-1).alias("turn"), "step", none.cast("string").alias("tab"), none.cast("long").alias("row_id"), "part", "slice"))
    so_far = Window.partitionBy(*key, "part", "slice").orderBy(F.col("t").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("alive", F.sum("step").over(so_far)).where("turn = 2").select("tab", "row_id", *key, "t", (F.col("alive") <= 0).alias("orphan"))


def advance(state: OrphanState, refs: DataFrame, changes: DataFrame) -> tuple[OrphanState, DataFrame]:
    """Take in the events of an increment, none older than those before: (new state, judged refs)."""
    steps = materialize(changes.groupBy("scope", "key").agg(F.sum("step").alias("step")))
    made = materialize(refs.groupBy("scope", "key", "tab").agg(F.count(F.lit(1)).alias("refs")))
    touched = broadcast_below(_union([steps.select("scope", "key"), made.select("scope", "key")]), BROADCAST_BYTES)
    judged = judge(refs, changes, state.alive(touched) if state.changes else None)
    layers, counts = [*state.steps, steps], [*state.made, made]
    if len(layers) > MOST_LAYERS:
        layers = [materialize(_union(layers).groupBy("scope", "key").agg(F.sum("step").alias("step")).where("step <> 0"))]
        counts = [materialize(_union(counts).groupBy("scope", "key", "tab").agg(F.sum("refs").alias("refs")))]
    return OrphanState(layers, counts, [*state.changes, changes], [*state.refs, refs]), judged


def transitions(state: OrphanState, refs: DataFrame, changes: DataFrame) -> DataFrame:
    """(tab, row_id, scope, key, change) of the references made before an increment: those whose waiting the
    increment's arrivals end ('resolved') and those that its deletions leave waiting again ('reopened'), as
    the state stands before and after it. Only keys with changes are read."""
    touched = _touched(changes)
    step = changes.groupBy("scope", "key").agg(F.sum("step").alias("step"))
    both = step.join(state.alive(touched), ["scope", "key"], "left").select("scope", "key", F.coalesce("alive", F.lit(0)).alias("was"), (F.coalesce("alive", F.lit(0)) + F.col("step")).alias("now"))
    flips = both.withColumn("change", F.when((F.col("was") <= 0) & (F.col("now") > 0), "resolved").when((F.col("was") > 0) & (F.col("now") <= 0), "reopened")).where("change is not null")
    flips = broadcast_below(materialize(flips.select("scope", "key", "change")), BROADCAST_BYTES)
    old = _union(state.refs) if state.refs else refs.where("false")
    return old.join(flips, ["scope", "key"]).select("tab", "row_id", "scope", "key", "change")


def amend(state: OrphanState, refs: DataFrame, changes: DataFrame) -> tuple[OrphanState, DataFrame]:
    """Take in late events: (new state, the new and the touched old references judged again). Old
    references of keys without a late change keep their verdict; of the history only keys of these events
    are read."""
    late = _touched(changes)
    todo = _union([refs, *(old.join(late, ["scope", "key"], "left_semi") for old in state.refs)])
    wanted = _touched(refs, changes)
    judged = judge(todo, _union([changes, *(old.join(wanted, ["scope", "key"], "left_semi") for old in state.changes)]))
    new, _ = advance(state, refs, changes)
    return new, judged


def waiting(state: OrphanState) -> DataFrame:
    """(tab, waiting): the references of each table that wait for a parent as the state stands."""
    made = _union(state.made).groupBy("scope", "key", "tab").agg(F.sum("refs").alias("refs"))
    return made.join(state.alive(), ["scope", "key"], "left").groupBy("tab").agg(F.sum(F.when(F.coalesce("alive", F.lit(0)) <= 0, F.col("refs")).otherwise(0)).alias("waiting"))


def replay(refs: DataFrame, changes: DataFrame, bounds: list) -> tuple[DataFrame, list[OrphanState]]:
    """All judged references of a history taken in by increments that end at ``bounds`` (sorted
    timestamps), and the state after each; a last increment has the events from the last bound on."""
    state, judged, states = OrphanState.empty(refs.sparkSession), None, []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        within = F.lit(True)
        if low is not None:
            within &= F.col("t") >= F.lit(low)
        if high is not None:
            within &= F.col("t") < F.lit(high)
        state, now = advance(state, refs.where(within), changes.where(within))
        judged = now if judged is None else judged.unionByName(now)
        states.append(state)
    return judged, states


def by_month(judged: DataFrame) -> DataFrame:
    """(tab, month, refs, orphans)."""
    return judged.groupBy("tab", utc_month("t").alias("month")).agg(F.count(F.lit(1)).alias("refs"), F.count_if("orphan").alias("orphans"))
