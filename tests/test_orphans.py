import datetime as dt
import random

from pyspark.sql import functions as F

from fathomline.operators import orphans as O

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


PARENTS = [
    (1, " Doc-A ", 10, 20, "x"), (2, "doc-a", 40, None, "x"), (3, "b", 5, 5, "x"), (4, "b", 9, 3, "x"), (5, None, 1, None, "x"), (6, "  ", 1, None, "x"), (7, "c", None, None, "x"),
    (8, "d", 1, 30, "x"), (9, "d", 1, 30, "x"), (10, "d", 20, 60, "x"),
]
REFS = [(1, "DOC-A", 9), (2, "doc-a", 10), (3, "doc-a", 19), (4, "doc-a", 20), (5, "doc-a", 40), (6, "b", 7), (7, "c", 100), (8, None, 3), (9, " ", 3), (10, "d", 30), (11, "d", 60), (12, "nowhere", 1), (13, "d", None)]
ORPHANS = [(1, "doc-a"), (4, "doc-a"), (6, "b"), (7, "c"), (11, "d"), (12, "nowhere")]


def frames(spark, refs=REFS, parents=PARENTS):
    p = spark.createDataFrame([(i, k, at(a), at(g), x) for i, k, a, g, x in parents], "row_id bigint, doc string, a timestamp, g timestamp, alive string")
    r = spark.createDataFrame([(i, k, at(t), "y") for i, k, t in refs], "row_id bigint, doc string, t timestamp, orphan string")
    return O.references(r, "boxes", "row_id", "doc", "t"), O.parent_changes(p, "doc", "a", "g")


def orphans(df):
    return sorted((r.row_id, r.key) for r in df.where("orphan").collect())


def test_alive_at_its_own_time(spark):
    assert orphans(O.judge(*frames(spark))) == ORPHANS


def test_increments_give_the_same_and_states_wait(spark):
    refs, changes = frames(spark)
    judged, states = O.replay(refs, changes, [at(15), at(25), at(50)])
    assert orphans(judged) == ORPHANS
    counts = [{r.tab: r.waiting for r in O.waiting(s).collect()} for s in states]
    # 15: b, nowhere wait; 25: doc-a is deleted and reopens its four; 50: doc-a is back; end: c and d wait too
    assert [c["boxes"] for c in counts] == [2, 6, 2, 5]


def test_late_events_amend(spark):
    refs, changes = frames(spark)
    state, _ = O.advance(O.OrphanState.empty(spark), refs, changes)
    late_refs, late = frames(spark, [(50, "doc-a", 8)], [(20, "doc-a", 7, None, "x"), (21, "b", 1, 2, "x")])
    state, judged = O.amend(state, late_refs, late)
    got = {r.row_id: r.orphan for r in judged.collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True, 50: False}


def test_against_brute_force_with_a_hot_key(spark, monkeypatch):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot", "k1", "k2", "k3"])
    parents = [(i, key(), a, rng.choice([None, a + rng.randrange(1, 300)]), "x") for i in range(120) for a in [rng.randrange(0, 900)]]
    refs = [(i, "hot" if i % 3 == 0 else key(), rng.randrange(0, 1000)) for i in range(900)]
    want = sorted((i, k) for i, k, t in refs if not any(k == p and a <= t and (g is None or g > t) for _, p, a, g, _ in parents))
    r, c = frames(spark, refs, parents)
    assert orphans(O.judge(r, c)) == want
    assert orphans(O.replay(r, c, [at(200), at(201), at(700)])[0]) == want
    for hot in (3, 10, 40):  # a key's days are cut again
        assert orphans(O.judge(r, c, hot=hot)) == want
    monkeypatch.setattr(O, "MOST_LAYERS", 2)
    monkeypatch.setattr(O, "HOT", 5)
    judged, states = O.replay(r, c, [at(h) for h in (100, 200, 300, 500, 700)])
    assert orphans(judged) == want and len(states[-1].steps) <= 3
    late = F.col("t") < F.lit(at(400))
    state, first = O.advance(O.OrphanState.empty(spark), r.where(~late), c.where(~late))
    _, again = O.amend(state, r.where(late), c.where(late))
    verdict = {(x.row_id, x.key): x.orphan for x in first.collect()} | {(x.row_id, x.key): x.orphan for x in again.collect()}
    assert sorted(k for k, o in verdict.items() if o) == want


def test_transitions(spark):
    refs, changes = frames(spark)
    early, late = F.col("t") < F.lit(at(15)), F.col("t") >= F.lit(at(15))
    state, _ = O.advance(O.OrphanState.empty(spark), refs.where(early), changes.where(early))
    got = lambda low, high: sorted((r.row_id, r.key, r.change) for r in O.transitions(state, refs.where("false"), changes.where(late & (F.col("t") >= F.lit(at(low))) & (F.col("t") < F.lit(at(high))))).collect())
    assert got(15, 25) == [(1, "doc-a", "reopened"), (2, "doc-a", "reopened")]
    state, _ = O.advance(state, refs.where(late & (F.col("t") < F.lit(at(25)))), changes.where(late & (F.col("t") < F.lit(at(25)))))
    assert got(25, 50) == [(n, "doc-a", "resolved") for n in (1, 2, 3, 4)]
    assert O.transitions(O.OrphanState.empty(spark), refs, changes).count() == 0


def test_empty_tables(spark):
    r, c = frames(spark, [], PARENTS)
    assert O.judge(r, c).count() == 0
    r, c = frames(spark, REFS, [])
    assert len(orphans(O.judge(r, c))) == 10
    assert O.by_month(O.judge(r, c)).select(F.sum("refs")).first()[0] == 10
