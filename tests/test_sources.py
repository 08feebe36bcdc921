import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlens.functions import hashing
from recordlens.sources import files
from recordlens.streaming import order


def test_jsonl_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x"}\n\n[1]\nnot json\n{"id": "y"}\n')
    got = [(r["line"], r["is_object"]) for r in files.read_jsonl(spark, str(p)).orderBy("line").collect()]
    assert got == [(1, True), (3, False), (4, False), (5, True)]
    with pytest.raises(files.SourceInvalid, match="line 3"):
        files.jsonl_objects(spark, str(p), "id string")
    p.write_text('{"id": "x"}\n{"id": "x"}\n')
    with pytest.raises(files.SourceInvalid, match="repeated"):
        files.jsonl_objects(spark, str(p), "id string", "id")


def test_line_numbers_over_splits(spark, tmp_path):
    """One split or fifty: every line has the number it has in its file."""
    for name, n in (("a", 700), ("b", 300)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join("" if i % 7 == 0 else json.dumps({"file": name, "line": i, "x": "é" * (i % 50)}) for i in range(1, n + 1)))
    want = sorted((name, i) for name, n in (("a", 700), ("b", 300)) for i in range(1, n + 1) if i % 7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "1000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = files.read_jsonl(spark, str(tmp_path))
            assert lines.rdd.getNumPartitions() >= 1 and lines.select("is_object").distinct().count() == 1
            rows = lines.select("line", F.get_json_object("value", "$.file").alias("f"), F.get_json_object("value", "$.line").cast("long").alias("l")).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert all(r["line"] == r["l"] for r in rows) and sorted((r["f"], r["l"]) for r in rows) == want


def test_packed_vectors_of_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 4000)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(5000, 4)).astype("<f2").astype(float)
    rows = spark.createDataFrame([(int(i), m[i].tolist()) for i in rng.permutation(5000)], "vector_index int, embedding array<double>").repartition(7)
    files.write_vectors(rows, str(tmp_path / "v.f16"))
    assert (tmp_path / "v.f16").read_bytes() == m.astype("<f2").tobytes()
    back = files.read_vectors(spark, str(tmp_path / "v.f16"), 4, 2001)
    assert back.rdd.getNumPartitions() == 20
    assert [list(r["embedding"]) for r in back.orderBy("vector_index").collect()] == m.tolist()
    with pytest.raises(files.SourceInvalid, match="whole vectors"):
        files.read_vectors(spark, str(tmp_path / "v.f16"), 3)


def test_ordered_digests_are_streams(spark):
    rows = [(i % 5 if i % 5 else None, (i * 37) % 101, None if i % 11 == 0 else f"line {i % 3} é\n") for i in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, t string").repartition(6)
    place = lambda r: (r[1], r[2] is not None, r[2] or "")
    digest = lambda some: hashlib.sha256("".join(r[2] or "" for r in sorted(some, key=place)).encode()).hexdigest()
    assert hashing.ordered_hash(df, ["k"], F.col("t")).first()["digest"] == digest(rows)
    got = {r["g"]: r["d"] for r in hashing.ordered_hash(df, ["k"], F.col("t"), ["g"], "d").collect()}
    assert got == {g: digest([r for r in rows if r[0] == g]) for g in (None, 1, 2, 3, 4)}
    assert hashing.ordered_hash(df.limit(0), ["k"], F.col("t")).first()["digest"] == hashlib.sha256().hexdigest()
    assert hashing.ordered_hash(df.limit(0), ["k"], F.col("t"), ["g"]).collect() == []


def test_json_documents(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"records": [{"id": "a"}, {"id": "b"}], "more": [{"id": "c"}]}))
    df = files.read_json(spark, str(p), "records array<struct<id:string>>, more array<struct<id:string>>")
    got = [(r["collection"], r["ordinal"], r["record"]["id"]) for r in files.explode_collections(df, ["records", "more"]).collect()]
    assert got == [("records", 0, "a"), ("records", 1, "b"), ("more", 0, "c")]
    assert files.read_document(spark, str(p))["more"] == [{"id": "c"}]
    p.write_text("{")
    with pytest.raises(files.SourceInvalid):
        files.read_document(spark, str(p))


def test_vectors_capsules_and_sinks(spark, tmp_path):
    m = np.arange(6).reshape(2, 3).astype("<f2")
    (tmp_path / "v.f16").write_bytes(m.tobytes())
    got = files.read_vectors(spark, str(tmp_path / "v.f16"), 3).orderBy("vector_index").collect()
    assert [list(r["embedding"]) for r in got] == m.astype(float).tolist()
    (tmp_path / "c.txt").write_text('HEAD\nITEM\tterm\tt.json\t{"a":"x\\ty"}\nBOUNDARY\tid\tG != H\n')
    items, guards = files.read_capsule(spark, str(tmp_path / "c.txt"))
    assert items.first()["payload"] == '{"a":"x\\ty"}' and guards.first()["guard"] == "G != H"
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    files.write_jsonl(rows, str(tmp_path / "out"), ["k"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"k":1,"v":"a"}', '{"k":2,"v":"b"}']
    files.publish(spark, str(tmp_path / "out"), str(tmp_path / "final"))
    with pytest.raises(files.SourceInvalid):
        files.publish(spark, str(tmp_path / "c.txt"), str(tmp_path / "final"))
    assert files.markdown_table(rows.orderBy("k")).splitlines()[2] == "| 1 | a |"


def test_items_and_guards(spark):
    records = spark.createDataFrame([("t.json", 0, "term:a", "term", "{}"), ("e.jsonl", 3, None, "event", '{"b":1,"a":2}')], "path string, ordinal int, id string, record_type string, payload string")
    got = {r["item_id"]: (r["kind"], r["priority"], r["payload"]) for r in files.unified_items(records).collect()}
    assert got == {"term:a": ("term", 0, "{}"), "event:e.jsonl:000003": ("event", 2, '{"a":2,"b":1}')}
    df = spark.createDataFrame(
        [("project", "p", ["Satire", "lean4"], None, None), ("wrapper", "projects/index.json", None, "selective", None), ("organization", "o", None, None, "not_asserted_by_substrate"), ("term", "t", ["satire"], None, None)],
        "kind string, path string, tags array<string>, completeness string, status string",
    )
    guards = df.select(files.boundary_guards(F.col("kind"), F.col("path"), F.col("tags"), F.col("completeness"), F.col("status")).alias("g"))
    assert [len(r["g"]) for r in guards.collect()] == [2, 1, 1, 0]


def run(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_streaming(spark, tmp_path):
    schema = "ts timestamp, kind string, id long"
    spark.sql(
        "select timestamp'2024-01-01 10:00:00' ts, 'a' kind, 1L id union all select timestamp'2024-01-01 11:00:00', 'a', 2L"
        " union all select timestamp'2024-01-01 11:00:00', 'a', 2L union all select timestamp'2024-01-03 11:00:00', 'b', 3L"
    ).write.parquet(str(tmp_path / "in"))
    run(order.windowed_counts(order.read_events(spark, str(tmp_path / "in"), schema), "ts", "kind"), "counts")
    assert [(r["kind"], r["n"]) for r in spark.table("counts").collect()] == [("a", 3)]
    run(order.distinct_events(order.read_events(spark, str(tmp_path / "in"), schema), "ts", "id"), "once")
    assert sorted(r["id"] for r in spark.table("once").collect()) == [1, 2, 3]


def test_lines_in_ordered_parts(spark, tmp_path):
    """Tasks write ranges of their own, and numbers run on over the parts; one file stays one file."""
    rows = spark.range(5000).select(((F.col("id") * 37) % 5000).alias("k")).repartition(6)
    line = F.when(F.col("k") % 5 == 0, " ").otherwise(F.format_string('{"k": %d}', "k"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_parts(rows, str(tmp_path / "parts"), ["k"], line)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "parts").glob("part-*"))) == 4
    got = files.read_jsonl(spark, str(tmp_path / "parts"), parts=True).collect()
    assert sorted((r["line"], r["value"]) for r in got) == sorted((k + 1, f'{{"k": {k}}}') for k in range(5000) if k % 5)
    assert files.jsonl_objects(spark, str(tmp_path / "parts"), "k long", "k", parts=True).where("line = k + 1").count() == 4000
