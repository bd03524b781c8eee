import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.sources import io


def test_json_lines_and_index(spark, tmp_path):
    lines = [{"id": "a", "text": "old"}, {"id": "b", "text": "b"}, {"id": "a", "text": "new"}, {"id": "z", "text": "left"}]
    (tmp_path / "c.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n \n")
    chunks = io.chunks_by_id(io.json_lines(spark, str(tmp_path / "c.jsonl"), io.CHUNK))
    assert {r.id: r.text for r in chunks.collect()} == {"a": "new", "b": "b", "z": "left"}
    (tmp_path / "i.json").write_text(json.dumps({"dims": 2, "store": "tq-b2", "order": ["b", "gone", "a", "b"]}, indent=1))
    order = io.index_entries(spark, str(tmp_path / "i.json"))
    rows = io.ordered_chunks(order, chunks, leftovers=True).orderBy("pos").collect()
    assert [r.text for r in rows] == ["b", "", "new", "b", "left"]
    assert io.stored_kind(order.first().store) == "quantized" and io.stored_kind(None) == "f32"


def test_vectors_and_texts(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    x.tofile(tmp_path / "v.f32")
    np.save(tmp_path / "w.npy", x[:, :2])
    assert [r.embedding for r in io.raw_vectors(spark, str(tmp_path / "v.f32"), 3).orderBy("pos").collect()] == x.tolist()
    assert [r.embedding for r in io.raw_vectors(spark, str(tmp_path / "w.npy"), 9).orderBy("pos").collect()] == x[:, :2].tolist()
    (tmp_path / "t" / "u").mkdir(parents=True)
    (tmp_path / "t" / "u" / "a.md").write_text("eins\nzwei")
    (tmp_path / "t" / "b.txt").write_text("drei")
    assert [r.text for r in io.whole_texts(spark, str(tmp_path / "t")).collect()] == ["eins\nzwei"]
    assert io.found_files(spark, str(tmp_path / "t"), "**/*.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        io.found_files(spark, str(tmp_path / "t"), "**/*.pdf")


def test_repositories(spark):
    paths = spark.createDataFrame([("t/p/q/r.git/HEAD",), ("t/p/q/r.git/refs/x",), ("t/s.git",), ("t/plain/file",)], "path string")
    assert sorted((r.path, r.tenant, r.project, r.id) for r in io.repositories(paths).collect()) == [("t/p/q/r", "t", ["p", "q"], "r"), ("t/s", "t", [], "s")]


def test_versions_and_embedding(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "d", "x"), ("b", "d", "y"), ("b", "e", "y")], "id string, doc string, text string")
    path = str(tmp_path / "container")
    assert io.write_container(chunks, path, 1) and not io.write_container(chunks.orderBy(F.desc("id")), path, 2)
    assert io.write_container(chunks.limit(2), path, 2)
    m = io.manifest(chunks, "c", "docs", "Title").first()
    assert (m.doc_count, m.chunk_count, m.dims) == (2, 3, 0)
    got = io.embedded(chunks, "id", "text", lambda ts: [[len(t), 0.0] for t in ts], 2, batch=2).collect()
    assert all(r.embedding == pytest.approx([1, 0]) for r in got) and len(got) == 3


def test_raw_files_in_ranges_and_back(spark, tmp_path, monkeypatch):
    from fathomline.sources import containers as C

    monkeypatch.setattr(io, "RANGE", 40)
    x = np.random.default_rng(0).standard_normal((101, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(101, None, "x"), (102, [1.0], "x")], "pos bigint, embedding array<float>, file string")
    assert C.write_raw_vectors(rows.repartition(5), str(tmp_path / "v.f32"), 4) == 103
    got = [r.embedding for r in io.raw_vectors(spark, str(tmp_path / "v.f32"), 4).orderBy("pos").collect()]
    assert got[:101] == x.tolist() and got[101:] == [[0.0] * 4] * 2
    np.save(tmp_path / "w.npy", x)
    assert [r.embedding for r in io.raw_vectors(spark, str(tmp_path / "w.npy"), 9).orderBy("pos").collect()] == x.tolist()


def test_containers_fall_back(spark, tmp_path):
    from fathomline.operators import codec
    from fathomline.sources import containers as C

    path = str(tmp_path / "c")
    x = np.random.default_rng(1).standard_normal((50, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "pos bigint, embedding array<float>")
    assert C.container_vectors(spark, path, "tq-b2", 8).count() == 0
    chunks = spark.createDataFrame([(1, "a", "d"), (0, "a", "d"), (2, None, "e")], "pos bigint, id string, doc string")
    C.write_container_files(chunks, path, "c", "docs", "Title", "m", 8, "f32", rows)
    assert C.container_vectors(spark, path, "tq-b2", 8).count() == 50  # no store: the raw vectors
    order = spark.read.json(f"{path}/{C.ORDER}").orderBy("pos").collect()
    assert [r["id"] for r in order] == ["a", "a", None]
    book = codec.fit(rows, "pos", F.col("embedding"), 8, bits=4)
    C.write_store(rows, "pos", F.col("embedding"), book, f"{path}/{C.STORE}")
    got = np.array([r.embedding for r in C.container_vectors(spark, path, "tq-b4", 8).orderBy("pos").collect()])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert ((got * u).sum(1) > 0.97).all() and np.allclose(np.linalg.norm(got, axis=1), 1, atol=2e-3)
    info = C.store_info(spark, f"{path}/{C.STORE}").first()
    assert (info.vectors, info.dims, info.bits, info.codebook) == (50, 8, 4, 16) and info.bytes > 0


def test_readers_and_field_catalog(spark, tmp_path):
    from fathomline.sources import containers as C

    files = spark.createDataFrame([("a", b"x\fy\f "), ("b", b"")], "path string, content binary")
    lines = io.read_lines(files, lambda path, content: [(1, n, t, 0.0, float(n), None) for n, t in enumerate(content.decode().split("\f"))] if content else None)
    assert sorted((r.doc, r.line_seq, r.text, r.x2) for r in lines.collect()) == [("a", 0, "x", None), ("a", 1, "y", None), ("a", 2, " ", None)]
    blocks = io.read_blocks(files, lambda path, content: content.decode().split("\f"))
    assert sorted(map(tuple, blocks.collect())) == [("a", 0, "x"), ("a", 1, "y")]
    (tmp_path / "f.json").write_text(json.dumps({"E1": {"datentyp": "currency", "anlage": "N", "zeile": 3}, "E2": {"enum": [["1", "ja"], ["2", "nein"]]}}))
    got = {r.code: r for r in C.field_catalog(spark, str(tmp_path / "f.json")).collect()}
    assert got["E1"].section == "N" and got["E1"].row == "3" and got["E2"].enum == ["1", "2"]
    assert C.field_catalog(spark, None) is None and C.field_catalog(spark, str(tmp_path / "none.json")) is None


def test_overlay_is_kept(spark, tmp_path):
    from fathomline.operators import catalog
    from fathomline.sources import containers as C

    path = str(tmp_path / "overlay.json")
    ask = lambda n, kind, tenant, p, i: spark.createDataFrame([(n, kind, tenant, p, i, None, None, None, "soft", None)], "request_id int, kind string, tenant string, path string, id string, name string, description string, type string, isolation string, created_at timestamp")
    for n, request in enumerate((("project", "t", "/a/b/", None), ("container", "t", "a/b", "c"), ("tenant", "no good", None, None), ("tenant", "u", None, None))):
        overlay, answers = catalog.created(ask(n, *request), C.load_overlay(spark, path))
        assert answers.first().status == (400 if n == 2 else 201)
        C.save_overlay(overlay, path)
    got = sorted((r.kind, r.path, r["name"], r.isolation) for r in C.load_overlay(spark, path).collect())
    assert got == [("container", "t/a/b/c", None, None), ("project", "t/a/b", "b", None), ("tenant", "t", "t", "hard"), ("tenant", "u", "u", "soft")]
    there = spark.createDataFrame([("t/a/x/1",), ("v/2",)], "path string")
    assert sorted((r.path, r.containers) for r in catalog.projects(there, C.load_overlay(spark, path)).collect()) == [("t/a", 1), ("t/a/b", 0), ("t/a/x", 1)]
