"""Reports, statistics, segments, amplification and op execution on small hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from kvstrata.functions import statistics
from kvstrata.operators import compaction, index, reads, views, workload, writes
from kvstrata.plans import reports
from kvstrata.schema import checked


def test_result_files_and_pivots(spark, tmp_path):
    line = "{},{},16,120,4,100,uniform,seek,2e9,1000,{},1,2,3000,{},0,0,0,0,0,0,0,0"
    (tmp_path / "db.csv").write_text("\n".join(line.format(s, m, ops, b) for s, m, ops, b in [("x", "16G", 5000.0, 1024_000), ("x", "32G", 7000.0, 0), ("y", "16G", 1000.0, 2048_000)]))
    df = reports.read_results(spark, str(tmp_path / "db.csv"), reports.DB_COLUMNS)
    assert {tuple(r) for r in reports.throughput(df, ["16G", "32G"]).collect()} == {("x", 5.0, 7.0), ("y", 1.0, None)}
    assert {tuple(r) for r in reports.read_io(df, ["16G"]).collect()} == {("x", 1.0), ("y", 2.0)}
    assert {r["sysname"]: r["16G"] for r in reports.load_io(df, ["16G"]).collect()} == {"x": 1027_000 / 1e12, "y": 2051_000 / 1e12}
    assert reports.ops_per_second(df).first()["ops"] == 500.0
    (tmp_path / "y.csv").write_text("a,A,16G,16,120,uniform,1e9,100,4000.0,1,2,3,4\nb,A,16G,16,120,uniform,1e9,100,2000.0,1,2,3,4")
    ycsb = reports.read_results(spark, str(tmp_path / "y.csv"), reports.YCSB_COLUMNS)
    assert tuple(reports.ycsb_throughput(ycsb, ["a", "b"]).first()) == ("A", 4.0, 2.0)


def test_trace_metadata_joins_the_sweep(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "t1.meta").write_text("trace_file = t1\nnum_ops = 50\nnote\n")
    meta = reports.metadata_table(reports.read_metadata(spark, str(tmp_path / "m")), ["trace_file", "num_ops"])
    sweep = spark.createDataFrame([("t1", 65536, 25, 75, 100), ("t2", 8, 1, 1, 2)], reports.LRU_COLUMNS)
    assert [tuple(r) for r in reports.io_per_query(sweep, meta).collect()] == [("t1", 65536, 1.0, 0.5)]


def test_counters(spark):
    samples = spark.createDataFrame([("d", 1, 10, 2**32 - 5), ("d", 2, 15, 7), ("d", 3, 30, 3)], "device string, at int, reads long, sectors long")
    got = reports.sector_bytes(reports.counter_deltas(samples, ["reads", "sectors"], wrap=2**32), ["sectors"]).first()
    assert (got["reads"], got["sectors"], got["sectors_bytes"]) == (20, 8, 8 * 512)
    io = spark.createDataFrame([("R", 5), ("W", 7), ("R", 6)], "rw string, bytes long")
    assert {tuple(r) for r in reports.block_io(io).collect()} == {("R", 2, 11), ("W", 1, 7)}
    vectors = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("b", 5, 6)], "k string, x long, y long")
    assert {tuple(r) for r in statistics.added_counters(vectors, ["k"], ["x", "y"]).collect()} == {("a", 4, 6), ("b", 5, 6)}


def test_convergence(spark):
    series = {"flat": [100, 100.1, 100.2], "wild": [1, 50, 3, 80, 2, 90, 4, 70, 5, 60, 6, 90, 7, 95]}
    rows = [(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    got = {(r["s"], r["i"]): r["converged"] for r in statistics.converged(spark.createDataFrame(rows, "s string, i int, v double"), "s", "i", "v").collect()}
    assert [got["flat", i] for i in range(3)] == [False, False, True]
    assert [got["wild", i] for i in range(14)] == [False] * 13 + [True]
    steps = statistics.systematic_sample(spark.range(101).select(F.col("id").cast("double").alias("v")), "v", 5).orderBy("step").collect()
    assert [r["value"] for r in steps] == [0.0, 25.0, 50.0, 75.0, 100.0]


def test_segments_never_split_a_key(spark):
    rng = random.Random(5)
    rows = [(f"{i:05d}", r) for i in range(400) for r in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "key string, run int")
    got = index.slot_segments(df)
    assert got.count() == 400
    sizes = df.join(got, "key").groupBy("pid", "segment").count().agg(F.max("count")).first()[0]
    assert sizes <= index.SLOTS
    bits = index.discriminating_bits(index.bit_segments(df))
    assert bits.agg(F.sum("n_keys")).first()[0] == 400
    assert bits.filter(f"n_keys > {index.SEGMENT_KEYS}").isEmpty()


def test_merges(spark):
    a, b, c = (spark.createDataFrame(rows, "key string, value string, tombstone boolean") for rows in ([("x", "a", False), ("y", "a", False)], [("x", None, True), ("z", "b", False)], [("x", "c", False)]))
    assert {(r["key"], r["rank"]) for r in views.merge_unique(a, b, c).collect()} == {("x", 2), ("y", 0), ("z", 1)}
    assert [(r["key"], r["rank"]) for r in views.merge_ordered(a, b, c).collect()] == [("x", 2), ("x", 1), ("x", 0), ("y", 0), ("z", 1)]
    assert views.merge_history(a, b, c).filter("repeated").count() == 2
    assert {r["key"]: r["value"] for r in views.tiers(a, b).collect()} == {"y": "a", "z": "b"}


def test_amplification_and_garbage(spark):
    io = spark.createDataFrame([(10, 30, 8, 20), (10, 10, 0, 0)], "log_bytes long, table_bytes long, read_bytes long, user_bytes long")
    assert tuple(compaction.amplification(io).first()) == (3.0, 0.4)
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    manifest = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "version long, path string")
    assert [r[0] for r in compaction.garbage(files, manifest, 2).collect()] == ["a"]


def test_executed_ops(spark):
    view = spark.createDataFrame([(k, "v") for k in (10, 20, 30)], "key long, value string")
    rows = [(1, "get", 10, 1), (2, "get", 11, 1), (3, "probe", 30, 1), (4, "seeknext", 25, 2), (5, "seeknext", 31, 2), (6, "seekskip", 10, 2), (7, "seekskip", 11, 2), (8, "set", 1, 1), (9, "scan", 0, 5)]
    got = {r["op_id"]: r["ok"] for r in workload.execute(spark.createDataFrame(rows, "op_id long, op string, key long, n int"), view).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False, 8: True, 9: True}
    made = workload.apply_writes(spark.createDataFrame([(1, "set", bytearray(b"a")), (2, "del", bytearray(b"b")), (3, "get", bytearray(b"c"))], "op_id long, op string, key binary"), 1, 5).orderBy("seq").collect()
    assert [(bytes(r["key"]), r["value"] and len(r["value"]), r["tombstone"]) for r in made] == [(b"a", 5, False), (b"b", None, True)]


def test_reads_on_nothing(spark):
    empty = spark.createDataFrame([], "key long, value string")
    ops = spark.createDataFrame([(1, 5, 0, 3)], "op_id long, key long, skip long, n long")
    assert reads.batch_range(ops, empty).isEmpty()
    assert reads.locate(empty, spark.createDataFrame([], "part_id int, anchor long")).isEmpty()
    assert reads.seek(empty, 1).isEmpty() and not reads.probe(empty, 1)


def test_oversized_records_raise(spark):
    big = spark.createDataFrame([(bytearray(b"k"), bytearray(70_000), False, 0, 1)], "key binary, value binary, tombstone boolean, run int, seq bigint")
    with pytest.raises(Exception, match="over the size limit"):
        checked(big).collect()
    assert writes.worker_share(10, 3, 2) == (6, 10)


def test_bloom_quality_takes_all_runs(spark):
    from kvstrata.plans import catalog

    got = catalog.kv_bloom_quality(spark, "/root/testdata/sf0.01")
    every = {r["run"] for r in catalog._runs(spark, "/root/testdata/sf0.01").select("run").distinct().collect()}
    assert max(every) >= 6 and {r["run"] for r in got.collect()} == every


def test_crc32c_is_the_known_one(spark):
    from kvstrata.functions import keys

    r = spark.createDataFrame([("123456789",), ("",)], "k string").select(keys.crc32c("k", 0xFFFFFFFF).alias("c"), keys.crc32c("k").alias("d")).collect()
    assert r[0]["c"] ^ 0xFFFFFFFF == 0xE3069283 and r[1]["d"] == keys.KEY_SEED


def test_many_anchors_give_the_same_partitions(spark, monkeypatch):
    from kvstrata.operators import reads

    anchors = spark.createDataFrame([(i, i * 10) for i in range(1, 60)], "part_id int, anchor long")
    rows = spark.range(0, 700, 3).withColumnRenamed("id", "key").withColumn("x", F.col("key") * 2)
    few = sorted(map(tuple, reads.locate(rows, anchors).select("key", "x", "part_id", "anchor").collect()), key=str)
    monkeypatch.setattr(reads, "LITERAL_ANCHORS", 5)
    assert sorted(map(tuple, reads.locate(rows, anchors).select("key", "x", "part_id", "anchor").collect()), key=str) == few


def test_filters_broadcast_or_joined_say_the_same(spark, monkeypatch):
    from kvstrata.operators import bloom

    rows = spark.range(3000).select(F.col("id").alias("key"), F.expr("cast(sqrt(id) as int)").alias("run"))
    asked = spark.range(0, 6000, 7).select(F.col("id").alias("key"))
    filters = bloom.build(rows, ["run"])
    few = sorted(map(tuple, bloom.test(asked.union(asked), filters, ["run"]).collect()))
    own = bloom.test(rows, filters, ["run"])
    assert len(few) == 858 * 55 and own.count() == 3000 and own.filter("not maybe").isEmpty()
    monkeypatch.setattr(bloom, "BROADCAST_WORDS", -1)
    assert sorted(map(tuple, bloom.test(asked.union(asked), filters, ["run"]).collect())) == few
