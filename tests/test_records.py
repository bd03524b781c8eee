import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import catalog, claims, codec, dense, ground, history, ingest, layout, lexicon, verify


def ts(n):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=n)


def test_catalog(spark):
    c = spark.createDataFrame([("t/a/b/c",), ("t/x",), ("u/a/z",)], "path string")
    got = {r.path: r.containers for r in catalog.rolled_up(c).collect()}
    assert got == {"t": 2, "t/a": 1, "t/a/b": 1, "u": 1, "u/a": 1}
    over = spark.createDataFrame([("t", "Tee"), ("w", "Weh")], "tenant string, title string")
    assert {r.tenant: (r.containers, r.projects, r.title) for r in catalog.tenants(c, over).collect()} == {"t": (2, 1, "Tee"), "u": (1, 1, "u"), "w": (0, 0, "Weh")}
    ks = spark.createDataFrame([("0",), ("-5",), ("99",), ("x",), (None,), ("7",)], "k string")
    assert [r[0] for r in ks.select(catalog.clamped_k(F.col("k"))).collect()] == [8, 1, 30, 8, 8, 7]
    p = spark.createDataFrame([("a/b",), ("a",), ("a//b",), (None,), ("ns:a:b:c",)], "p string")
    assert [r[0] for r in p.select(catalog.valid_path(F.col("p"))).collect()] == [True, False, False, False, False]
    assert p.where("p like 'ns:%'").select(catalog.parsed_id(F.col("p"))).first()[0] == "a/b/c"
    now = spark.createDataFrame([("a", 1, "x")], "slug string, at int, title string")
    new = spark.createDataFrame([("a", 2, "y"), ("b c", 3, "z"), ("d", 3, "w")], "slug string, at int, title string")
    assert sorted((r.slug, r.title) for r in catalog.upserted(now, new, "slug", "at").collect()) == [("a", "y"), ("d", "w")]


def test_history(spark):
    edges = spark.createDataFrame([(3, 1), (3, 2), (2, 1), (4, 3), (5, 2), (1, None)], "id bigint, parent bigint")
    heads = lambda *h: spark.createDataFrame([("r", x) for x in h], "root string, id bigint")
    assert sorted(r.id for r in history.compared(heads(5), heads(4), edges).collect()) == [3, 4]
    assert history.compared(heads(4), heads(4), edges).count() == 0
    stats = spark.createDataFrame([(1, "a", 3, 1), (1, "b", None, None)], "commit_id int, path string, additions int, deletions int")
    assert tuple(history.diff_totals(stats).first()) == (1, 2, 3, 1)
    files = spark.createDataFrame([("r", "a/b.txt", 3), ("r", "a/c/d", 4), ("r", "e", 5)], "repo string, path string, size bigint")
    assert sorted((r.name, r.type, r.size) for r in history.children(files, "").collect()) == [("a", "tree", None), ("e", "blob", 5)]
    assert sorted((r.name, r.type, r.size) for r in history.children(files, "a").collect()) == [("b.txt", "blob", 3), ("c", "tree", None)]
    branches = spark.createDataFrame([("r", "refs/heads/dev", "gone"), ("r", "refs/heads/master", "gone"), ("r", "refs/tags/v1", "gone")], "repo string, ref string, head string")
    assert {r.name for r in history.refs(branches).where("is_default").collect()} == {"master"}


def test_ingest(spark):
    schema = "container_id string, has_repo boolean, has_head boolean, mode string, author_email string, source_key string, built_key string"
    state = spark.createDataFrame(
        [("t/a", True, True, "build", "u", "k1", "k0"), ("t/b", True, True, "build", "me", "k", None), ("t/c", True, True, "build", "u", "k", "k"), ("t/d", True, True, "build", "u", "k", None), ("t/e", True, False, "build", "u", "k", None),
         ("t/f", True, True, "dance", "u", "k", None), ("t/g", True, True, None, "u", "k", None), ("t/h", True, True, "build", "u", None, None)], schema,
    )
    names = ["t/a", "t/b", "t/c", "t/d", "t/e", "t/f", "t/g", "t/h", "t/none", "bad", "t/a"]
    events = spark.createDataFrame([(i, ts(i), "git.push", c) for i, c in enumerate(names)] + [(50, ts(0), "other", "t/a"), (51, ts(0), "git.push", None)], "event_id bigint, ts timestamp, type string, container_id string")
    jobs = spark.createDataFrame([("1", "t/d", "running"), ("2", "t/a", "sealed")], "id string, container_id string, status string")
    got = {r.event_id: r.decision for r in ingest.decided(events, state, jobs, "me").collect()}
    assert got == dict(enumerate(["enqueue", "own-writeback", "unchanged-source", "active-job-exists", "empty-repo", "bad-mode", "no-ingest-config", "source-path-missing", "no-repo", "bad-id", "active-job-exists"]))
    queue = spark.createDataFrame([("a", "queued", None, None, None), ("b", "queued", None, None, None)], "id string, status string, started_at timestamp, finished_at timestamp, error string")
    changes = spark.createDataFrame([("a", "running", ts(1), None), ("a", "running", ts(2), None), ("a", "failed", ts(9), "boom"), ("a", "sealed", ts(10), None), ("b", "sealed", ts(3), None)], "id string, status string, at timestamp, error string")
    rows = {r.id: r for r in ingest.durations(ingest.moved_on(queue, changes)).collect()}
    assert (rows["a"].status, rows["a"].error, rows["a"].duration_seconds) == ("failed", "boom", 8.0) and rows["a"].log.count("status") == 2
    assert rows["b"].status == "queued" and rows["b"].duration_seconds is None


def test_stream_is_idempotent(spark, tmp_path):
    from fathomline.streaming import ingest as S

    state = spark.createDataFrame([(c, True, True, "build", "u", "k", None) for c in ("t/a", "t/b")], "container_id string, has_repo boolean, has_head boolean, mode string, author_email string, source_key string, built_key string")
    inbox, jobs, check = str(tmp_path / "in"), str(tmp_path / "jobs"), str(tmp_path / "check")

    def push(n, *cs):
        spark.createDataFrame([(n * 10 + i, ts(n), "git.push", c) for i, c in enumerate(cs)], S.EVENTS).coalesce(1).write.mode("append").json(inbox)
        S.start(S.read_events(spark, inbox), state, jobs, check, "me").awaitTermination()
        return sorted(r.container_id for r in S.known_jobs(spark, jobs).collect())

    assert push(1, "t/a", "t/a") == ["t/a"]
    assert push(2, "t/a", "t/b") == ["t/a", "t/b"]
    assert push(3, "t/b") == ["t/a", "t/b"]


def test_grounding(spark):
    m = spark.createDataFrame([(1, 0, "system", "A"), (1, 1, "user", "hi"), (1, 2, "system", "B"), (2, 0, "user", "x"), (3, 0, "assistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    blocks = spark.createDataFrame([(1, "G"), (3, "H")], "conv_id bigint, block string")
    assert sorted(map(tuple, ground.grounded(m, blocks).collect())) == [(1, 0, "system", "A\n\nB\n\nG"), (1, 1, "user", "hi"), (2, 0, "user", "x"), (3, 0, "system", "H"), (3, 1, "assistant", "y")]
    assert sorted(map(tuple, ground.last_user_turns(m).collect())) == [(1, 1, "hi"), (2, 0, "x")]
    q = spark.createDataFrame([(1,), (2,)], "q_id int")
    matches = spark.createDataFrame([(1, 2, "c", "s", 0.5, "zwei"), (1, 1, "c", None, 0.75, "eins")], "q_id int, rk int, container_id string, source string, score double, text string")
    got = {r.q_id: r for r in ground.or_nothing_found(q, ground.context_blocks(matches)).collect()}
    assert got[1].block == "[1] c /  (score 0.7500)\neins\n\n[2] c / s (score 0.5000)\nzwei" and got[2].passages == 0


def test_lexicon(spark):
    known = spark.createDataFrame([(w,) for w in ("kitten", "mitten", "cat", "hat", "größe")], "word string")
    asked = spark.createDataFrame([(w,) for w in ("kittn", "bat", "cat", "grösse", "a1", "zzzzzzzz", None)], "word string")
    got = {r.word: r.corrected for r in lexicon.corrected(asked, known).collect()}
    assert got == {"kittn": "kitten", "bat": "bat", "cat": "cat", "grösse": "größe", "a1": "a1", "zzzzzzzz": "zzzzzzzz"}
    docs = spark.createDataFrame([(i, "a" if i < 20 else None) for i in range(23)], "doc bigint, kind string")
    out = [r.kind for r in lexicon.held_out(docs, "doc", "kind").collect()]
    assert out.count("a") == 3 and out.count(None) == 1
    words = lexicon.vocabulary(spark.createDataFrame([("Ab ab x",), (None,)], "t string"), F.col("t"), spark.createDataFrame([("ab cd",)], "phrase string"))
    assert {r.word: r.cnt for r in words.collect()} == {"ab": 3, "cd": 1, "ab cd": 1}


def test_codec(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.standard_normal((400, 32)))] + [(999, None)], "id bigint, e array<float>")
    units = dense.with_units(v, "id", F.col("e"), 32)
    cards = []
    for bits in (1, 2, 4):
        book = codec.fit(v, "id", F.col("e"), 32, bits)
        assert np.allclose(book.turn @ book.turn.T, np.eye(32)) and len(book.levels) == 2**bits
        cards.append(codec.card(units, codec.encoded(v, "id", F.col("e"), book), book).first())
    assert cards[0].cos_fidelity < cards[1].cos_fidelity < cards[2].cos_fidelity and cards[2].cos_fidelity > 0.98
    assert all(0.5 < c.score_recall_at_10 <= 1.000001 and c.n_vectors == 400 for c in cards)
    one = spark.createDataFrame([([0.0, 0.1, -0.5],)], "v array<double>")
    assert one.select(codec.codes(F.col("v"), [0.0])).first()[0] == [0, 1, 0]


GLYPH = "doc string, page int, seq int, label string, x double, y double, w double, h double, wpos int"


def test_bands_and_tables(spark):
    spans = spark.createDataFrame([("d", 1, i, "x", 0.0, float(y), 5.0, float(h), None) for i, (y, h) in enumerate([(0, 10), (11, 9), (25, 5)])], GLYPH)
    assert layout.y_bands(spans).count() == 2
    cells = [("Name", 0, 0), ("Wert", 300, 0), ("Druck", 0, 30), ("12,5", 300, 30), ("Kraft", 0, 60), ("7", 300, 60)]
    page = spark.createDataFrame([("d", 1, i, t, float(x), float(y), 20.0, 10.0, None) for i, (t, x, y) in enumerate(cells)], GLYPH)
    assert [r.text for r in layout.table_rows(page).orderBy("band").collect()] == ["Name | Wert", "Druck | 12,5", "Kraft | 7"]
    assert layout.table_rows(page.limit(2)).count() == 0


LINES = "doc string, page int, line_seq int, text string, x double, y double, x2 double"


def lines(spark, *rows):
    return spark.createDataFrame([("d", 1, i, *r) for i, r in enumerate(rows)], LINES)


def test_pairings(spark):
    codes = spark.createDataFrame([(3, "A"), (4, "B"), (5, "C")], "number int, code string")
    got = claims.row_anchors(lines(spark, ("3. Brutto", 0.0, 100.0, 50.0), ("1,00", 200.0, 110.0, 230.0), ("4. Steuer", 0.0, 200.0, 50.0), ("2,00", 200.0, 200.0, 230.0), ("3,00", 260.0, 200.0, 290.0), ("5. Satz 7,00", 0.0, 300.0, 50.0)), codes)
    assert sorted((r.code, r.raw) for r in got.collect()) == [("A", "1,00"), ("C", "7,00")]
    none = spark.createDataFrame([], claims.VALUES)
    table = lines(spark, ("3. A", 0.0, 100.0, 9.0), ("4. B", 0.0, 150.0, 9.0), ("5. C", 0.0, 200.0, 9.0), ("1,00", 400.0, 120.0, 430.0), ("2,00", 400.0, 140.0, 430.0), ("3,00", 400.0, 260.0, 430.0), ("9,99", 100.0, 100.0, 130.0))
    got = claims.greedy_pairs(table, none, {3: "A", 4: "B", 5: "C"}, [])
    assert sorted((r.code, r.raw) for r in got.collect()) == [("A", "1,00"), ("B", "2,00"), ("C", "3,00")]
    got = claims.greedy_pairs(lines(spark, ("Brutto lohn", 0.0, 100.0, 9.0), ("5,00", 200.0, 160.0, 9.0), ("6,00", 200.0, 105.0, 9.0)), none, {}, [("K", ("bruttolohn",), ()), ("L", ("brutto",), ("lohn",))])
    assert [(r.code, r.raw) for r in got.collect()] == [("K", "6,00")]
    got = claims.joined_cents(lines(spark, ("1.234", 0.0, 100.0, 40.0), ("56", 60.0, 104.0, 70.0), ("7", 0.0, 200.0, 5.0)))
    assert [r.text for r in got.orderBy("line_seq").collect()] == ["1.234,56", "", "7"]


def test_witnesses(spark):
    schema = "doc string, witness_rank int, source string, code string, raw string, page int, y double"
    values = spark.createDataFrame([("d", 1, "a", "X", "1.234,56", 1, 0.0), ("d", 2, "b", "X", "234,56", 1, 0.0), ("d", 3, "c", "X", "56", 1, 0.0), ("d", 2, "b", "Y", "9,00", 2, 0.0)], schema)
    got = {r.code: r for r in claims.merged_witnesses(values).collect()}
    assert (got["X"].value, got["X"].witnesses, got["X"].sources) == ("1.234,56", 2, ["a", "b"]) and got["Y"].witnesses == 1


def test_verdicts(spark):
    claim = "row_id bigint, attribute string, value string, value2 string, unit string, kind string, docs array<string>"
    rows = [
        (1, "Druck", "12,5", None, None, "N", ["d2", "d1"]), (2, "Druck", "0,0", None, None, "N", ["d1"]), (3, "Druck", "0", None, None, "L", ["d1"]), (4, "Druck", "7", None, None, None, [None, " "]),
        (5, "Länge", "7", None, None, "N", ["d1"]), (6, "Druck", "99", None, None, "N", ["d1", "d2"]), (7, "Druck", "5", None, "bar", "N", ["d3"]), (8, "Druck", "5", None, None, "N", ["d3"]), (9, None, None, None, None, None, None),
    ]
    box = "row_id bigint, doc string, box_seq int, page int, x0 double, y0 double, x1 double, y1 double, text string"
    boxes = spark.createDataFrame(
        [(1, "D1 ", 1, 1, 0.0, 100.0, 40.0, 110.0, "Druck:"), (2, "d1", 2, 1, 50.0, 130.0, 80.0, 140.0, "12,5"), (2, "d1", 2, 1, 50.0, 130.0, 80.0, 140.0, "12,5"), (3, "d3", 1, 1, 0.0, 10.0, 40.0, 20.0, "Druck"),
         (4, "d3", 2, 1, 300.0, 12.0, 310.0, 20.0, "5"), (5, "d3", 3, 1, 320.0, 12.0, 340.0, 20.0, "bar"), (6, "d2", 1, 1, 0.0, 10.0, 40.0, 20.0, "Druck"), (7, "d2", 2, 1, 50.0, 41.0, 40.0, 60.0, "12,5")], box,
    )
    got = {r.row_id: r for r in verify.atomized(spark.createDataFrame(rows, claim), boxes).collect()}
    want = {1: "verified", 2: "value-null-suspect", 3: "unverifiable-text", 4: "no-evidence-doc", 5: "not-in-doc", 6: "value-not-at-label", 7: "verified", 8: "in-text-not-in-line", 9: "no-evidence-doc"}
    assert {k: r.verdict for k, r in got.items()} == want and got[1].proof_doc == "d1"
    ids = verify.atom_ids(spark.createDataFrame(rows, claim), ["attribute", "value", "unit"])
    assert ids.select("atom_id").distinct().count() == 9 and ids.union(ids).select("atom_id").distinct().count() == 9


def test_documents(spark):
    from fathomline.operators import documents as D

    rows = [("Name des Arbeitgebers", 0.0, 10.0, 9.0), ("Anschrift des Arbeitgebers", 0.0, 20.0, 9.0), ("12 Zahl", 0.0, 30.0, 9.0), ("Muster GmbH, 12345 Ort", 0.0, 40.0, 9.0), ("Fern AG", 0.0, 400.0, 9.0)]
    assert D.employers(lines(spark, *rows)).first().employer == "Muster GmbH"
    assert D.employers(lines(spark, *rows[2:3], *rows[4:])).first().employer == "Zahl\nFern AG"  # a name may run over lines
    assert D.employers(lines(spark, ("12 zahl", 0.0, 30.0, 9.0), *rows[4:])).first().employer == "Fern AG"
    assert D.employers(lines(spark, ("Bayer AG Leverkusen / 51373 Leverkusen", 0.0, 30.0, 9.0))).first().employer == "Bayer AG Leverkusen"
    assert D.employers(lines(spark, ("Name des Arbeitgebers: Werk 12345 GmbH", 0.0, 600.0, 9.0))).first().employer == "Werk 12345 GmbH"
    assert D.employers(lines(spark, ("nichts", 0.0, 0.0, 1.0))).first().employer is None
    ink = spark.createDataFrame([(1, 5.0, 5.0, 0), (2, 5.0, 5.0, 1), (3, 0.5, 5.0, 0), (4, 5.0, 5.0, None)], "seq int, w double, h double, ink_sum int")
    assert sorted(r.seq for r in D.visible(ink).collect()) == [2, 3]
    codes = spark.createDataFrame([(3, "A")], "number int, code string")
    table = spark.createDataFrame([("d", 1, 5, ["", "3. Brutto", "11.111,11 ", "2,00"]), ("d", 1, 9, ["3. Brutto", "7,00"]), ("d", 2, 1, ["x", "1,00"])], "doc string, page int, y int, cells array<string>")
    assert [tuple(r) for r in D.table_witness(table, codes).collect()] == [("d", "A", "11.111,11", 1, 5)]
    cells = [("Name", 0, 0), ("Wert", 300, 0), ("Druck", 0, 30), ("12,5", 300, 30), ("Druck", 0, 60), ("12,5", 300, 60)]
    page = spark.createDataFrame([("d", 1, i, t, float(x), float(y), 20.0, 10.0, None) for i, (t, x, y) in enumerate(cells)], GLYPH)
    files = spark.createDataFrame([("d", "a/x_77-1.pdf", "Pumpe"), ("e", "b.pdf", None)], "doc string, source string, prefix string")
    assert [(r.doc, r.text) for r in D.row_chunks(page, files).orderBy("doc", "at", "win").collect()] == [
        ("d", "Datenblatt SNR 77 · Pumpe"), ("d", "Pumpe — Name | Wert"), ("d", "Pumpe — Druck | 12,5"), ("e", "Datenblatt SNR b"),
    ]


def test_streamed_job_states(spark, tmp_path):
    from fathomline.streaming import ingest as S

    jobs, states, inbox, check = (str(tmp_path / n) for n in ("jobs", "states", "in", "check"))
    spark.createDataFrame([("a", "t/a", "ingest", "queued", ts(0), 0), ("b", "t/b", "ingest", "queued", ts(0), 0)], S.JOBS).drop("batch").write.parquet(f"{jobs}/batch=0")

    def change(*rows):
        spark.createDataFrame(rows, S.CHANGES).coalesce(1).write.mode("append").json(inbox)
        S.start_states(spark.readStream.schema(S.CHANGES).json(inbox), jobs, states, check).awaitTermination()
        return {r.id: (r.status, r.log.count("status")) for r in S.job_states(spark, states).collect()}

    assert change(("a", "running", ts(1), None), ("zz", "running", ts(1), None)) == {"a": ("running", 1), "b": ("queued", 0)}
    assert change(("a", "failed", ts(5), "boom"), ("b", "sealed", ts(6), None)) == {"a": ("failed", 2), "b": ("queued", 0)}
    assert change(("b", "running", ts(7), None)) == {"a": ("failed", 2), "b": ("running", 1)}


def test_models_are_optional(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "q_id int, q string")
    out = lambda model: [r.q for r in ground.with_model(rows, "q", model, 2).orderBy("q_id").collect()]
    assert out(None) == ["a", None, "c"] == out(lambda ts_: 1 / 0)
    assert out(lambda ts_: [t and t.upper() for t in ts_]) == ["A", None, "C"]


def test_joined_cents_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["12", "34", "1.234", "5", "99", "123456", "a", None, "7,10"]
    data = [("d", int(p), i, texts[rng.integers(len(texts))], float(rng.integers(0, 200)), float(rng.integers(0, 30)), None if rng.random() < 0.3 else 0.0) for p in range(6) for i in range(25)]
    data = [(d, p, i, t, x, y, None if x2 is None else x + 10) for d, p, i, t, x, y, x2 in data]
    want = {}
    for p in range(6):
        on = [list(r) for r in data if r[1] == p]
        text, used, made = {r[2]: (r[3] or "").strip() for r in on}, set(), set()
        for e in on:
            if e[2] in used or not re.fullmatch(claims.EUROS.strip("^$"), text[e[2]]):
                continue
            for c in on:
                gap_ok = e[6] is None or 0 < c[4] - e[6] <= 130
                if c is not e and c[2] not in used and c[2] not in made and re.fullmatch("[0-9]{2}", text[c[2]]) and c[4] > e[4] and abs(c[5] - e[5]) <= 8 and gap_ok:
                    text[e[2]], text[c[2]] = f"{text[e[2]]},{text[c[2]]}", ""
                    used.add(c[2])
                    made.add(e[2])
                    break
        want |= {(p, k): v for k, v in text.items()}
    got = claims.joined_cents(spark.createDataFrame(data, claims.LINES))
    assert {(r.page, r.line_seq): r.text for r in got.collect()} == want
    assert any("," in v and v != "7,10" for v in want.values())


def test_glyph_vectors(spark):
    ring = np.zeros((9, 7), np.uint8)
    ring[1:8, 1:6] = 255
    ring[2:4, 2:5] = ring[5:7, 2:5] = 0
    corner = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], np.uint8)
    rows = [(1, 9, 7, ring.tobytes()), (2, 3, 3, corner.tobytes()), (3, 2, 2, bytes(4)), (4, 2, 2, None), (5, 3, 3, b"xx")]
    got = {r.id: r for r in layout.glyph_vectors(spark.createDataFrame(rows, "id int, height int, width int, pixels binary")).collect()}
    assert set(got) == {1, 2, 3} and [got[i].holes for i in (1, 2, 3)] == [2, 1, 0] and got[3].fitted is None
    fit = np.array(got[1].fitted).reshape(24, 16)
    ys, xs = np.nonzero(fit)
    assert (ys.min(), ys.max(), xs.min(), xs.max()) == (1, 22, 0, 15)
    assert max(got[1].scaled) == pytest.approx(1, abs=1e-5) and min(got[1].scaled) == 0
