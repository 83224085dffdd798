"""Files, stores and streams."""

import os

from pyspark.sql import functions as F

from lexmill.plans.audit import scan
from lexmill.plans.ingest import ingest
from lexmill.sources import files, store
from lexmill.streaming import ingest as streaming


def lay_out(root):
    for path, data in {"a.py": b"def f():\n" + b"    return 1\n" * 10, "docs/b.md": "# Ä\nsome words here to keep this one long enough\n".encode(), "bad.txt": b"\xff\xfe words and more words to be long enough here", "blank.md": b" \n\t\n", "x.bin": b"x", ".git/c.md": b"hidden text", "node_modules/d.js": b"let x = 1", ".env": b"A=1"}.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_bytes(data)


def test_directories(spark, tmp_path):
    lay_out(tmp_path)
    got = {r.filepath: r for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "docs/b.md", "bad.txt"}
    assert got["a.py"].language == "python" and got["bad.txt"].language == "text" and "�" in got["bad.txt"].content
    assert files.load_documents(spark, str(tmp_path / "none")).count() == 0
    assert files.load_file(spark, str(tmp_path / "blank.md")).count() == 1


def test_ingest_and_store(spark, tmp_path):
    lay_out(tmp_path / "in") if (tmp_path / "in").mkdir() is None else None
    s = store.Store(spark, str(tmp_path / "chunks"), "chunk_id")
    assert s.read() is None
    first = ingest(spark, str(tmp_path / "in"), s)
    n = first.count()
    assert n == 3 and all(len(r.embedding) == 64 for r in first.collect())
    assert ingest(spark, str(tmp_path / "in"), s).count() == n and s.version() == 2
    assert s.delete(F.col("document_path") == "a.py") == 1 and s.read().count() == n - 1
    s.clear()
    assert s.read().count() == 0


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert {(r.k, r.v) for r in store.upsert(old, new, "k", "o").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    kept = store.delete_session(old.withColumnRenamed("k", "session_id"), old.withColumnRenamed("k", "session_id"), spark.createDataFrame([(1,)], "session_id int"))
    assert [t.count() for t in kept] == [1, 1]


def test_logs_keep_nested_values_as_json(spark, tmp_path):
    store.append(spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>"), str(tmp_path / "log"))
    store.append(spark.createDataFrame([(2, [])], "id int, tags array<string>"), str(tmp_path / "log"))
    assert {(r.id, r.tags) for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {(1, '["a","b"]'), (2, "[]")}


def test_trees_leave_out_broken_lines(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"doc_id": "a", "title": "x"}\n{broken\n{"doc_id": "b", "title": "y"}\n')
    assert files.load_trees(spark, str(tmp_path / "t.json")).count() == 2
    assert files.load_trees(spark, str(tmp_path / "t.json"), "b").first().title == "y"


def test_watching_a_directory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lay_out(tmp_path / "in")
    s = store.Store(spark, str(tmp_path / "chunks"), "chunk_id")
    for _ in range(2):
        streaming.watch(spark, str(tmp_path / "in"), s, str(tmp_path / "cp")).awaitTermination(120)
        assert s.read().count() == 3


def test_turn_counter_keeps_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    turns = spark.readStream.schema("user int, text string").json(str(tmp_path / "in"))
    out = []
    for part in (["a", "b"], ["c", "d", "e", "f"]):
        (tmp_path / "in" / f"{len(part)}.json").write_text("".join(f'{{"user": 1, "text": "{t}"}}\n' for t in part))
        q = streaming.every_nth_turn(turns, "user").writeStream.foreachBatch(lambda b, _: out.extend(r.turn_number for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(out) == [3, 6]


def test_audit(spark, tables):
    parts = scan(spark.read.parquet(f"{tables}/documents.parquet"))
    assert parts["health"].count() == 1 and 1 <= parts["recommendations"].count() <= 6 and parts["issues"].count() <= 50 and parts["fingerprints"].count() == 20
