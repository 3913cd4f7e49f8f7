"""Sequences of writes against a dictionary; stores under every kind of compaction; brute-force checks."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from kvstrata.functions import generators, keys
from kvstrata.operators import bloom, compaction, index, lru, reads, views, workload, writes
from kvstrata.schema import MUTATIONS
from kvstrata.sources import loaders, registry
from kvstrata.sources.store import KvStore, MutationLog


def _key(i):
    return bytearray(f"k{i:04d}".encode())


def _batch(spark, rng, n, model, seq):
    rows = []
    for i in range(n):
        k, gone = rng.randrange(60), rng.random() < 0.3
        value = None if gone else bytearray(f"v{seq + i}".encode())
        rows.append((_key(k), value, gone, 0, seq + i))
        if gone:
            model.pop(bytes(_key(k)), None)
        else:
            model[bytes(_key(k))] = bytes(value)
    return spark.createDataFrame(rows, MUTATIONS)


def _seen(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


def test_views_follow_a_dictionary(spark):
    rng, model, rows = random.Random(1), {}, None
    for run in range(3):
        batch = _batch(spark, rng, 80, model, run * 100).withColumn("run", F.lit(run))
        rows = batch if rows is None else rows.unionByName(batch)
    assert _seen(views.live(rows)) == model
    flags = views.all_versions(rows)
    assert flags.count() == rows.count()
    assert flags.filter("not stale").count() == views.newest(rows).count()
    assert _seen(reads.scan(views.live(rows), b"k0010", b"k0020")) == {k: v for k, v in model.items() if b"k0010" <= k < b"k0020"}
    at = [bytes(r["key"]) for r in reads.seek(views.live(rows), b"k0031", 4, 1).collect()]
    assert at == sorted(k for k in model if k >= b"k0031")[1:5]
    assert [bytes(r["key"]) for r in reads.seek_at_most(views.live(rows), b"k0031", 2).collect()] == sorted((k for k in model if k <= b"k0031"), reverse=True)[:2]


@pytest.mark.parametrize("force", ["minor", "partial", "major", None])
def test_store_shows_the_same_under_any_compaction(spark, tmp_path, force):
    rng, model = random.Random(7), {}
    store = KvStore.create(spark, str(tmp_path / "s"), [b"", b"k0020", b"k0040"])
    for step in range(4):
        rejected = store.flush(_batch(spark, rng, 50, model, step * 100), force=force)
        assert rejected.isEmpty()
        assert _seen(store.live()) == model
    some = sorted(model)[3]
    assert _seen(store.get(some)) == {some: model[some]}
    before = _seen(store.live(version=2))
    memory = _batch(spark, rng, 20, model, 900)
    assert _seen(store.live(views.newest(memory))) == model
    store.flush(memory, force=force)
    store.split(10)
    assert _seen(store.live()) == model and _seen(store.live(version=2)) == before
    assert store.anchors().count() > 3
    store.collect_garbage(1)
    assert _seen(store.live()) == model and store.versions() == [store.head()]


def test_rejected_keys_come_back_without_overwriting(spark, tmp_path):
    store = KvStore.create(spark, str(tmp_path / "s"), [b"", b"k0030"])
    rows = [(_key(i), bytearray(b"x" * 3000), False, 0, i) for i in range(60)]
    store.flush(spark.createDataFrame(rows, MUTATIONS), force="major")
    little = spark.createDataFrame([(_key(1), bytearray(b"new"), False, 0, 100)], MUTATIONS)
    rejected = store.flush(little, budget=1 << 20)
    assert rejected.count() == 1
    fresh = spark.createDataFrame([(_key(1), bytearray(b"newer"), False, 0, 101), (_key(2), bytearray(b"y"), False, 0, 102)], MUTATIONS)
    back = writes.reinsert(rejected, fresh)
    assert {bytes(r["key"]): bytes(r["value"]) for r in back.collect()} == {bytes(_key(1)): b"newer", bytes(_key(2)): b"y"}


def test_appended_data_becomes_a_partition(spark, tmp_path):
    config = compaction.Config(max_pages=1)
    store = KvStore.create(spark, str(tmp_path / "s"), config=config)
    batch = lambda a, b: spark.createDataFrame([(_key(i), bytearray(b"z" * 200), False, 0, i) for i in range(a, b)], MUTATIONS)
    store.flush(batch(0, 10), force="minor")
    store.flush(batch(10, 20), force="minor")
    store.flush(batch(100, 160))
    # What was there stays; the appended rows, more than major_switch runs of bytes, are two partitions.
    assert store.anchors().count() == 3 and store.statistics().filter("part_id = 0").count() == 2
    assert store.live().count() == 80


def test_a_flush_reads_only_what_it_rewrites(spark, tmp_path, monkeypatch):
    """Pieces that the flush reads: none for minor, the newest run for partial, all of a partition for major."""
    store = KvStore.create(spark, str(tmp_path / "s"), [b"", b"k0050"])
    batch = lambda step: spark.createDataFrame([(_key(i), bytearray(b"v%d" % step), False, 0, step * 100 + i) for i in range(100)], MUTATIONS)
    read, plain = [], KvStore._read
    monkeypatch.setattr(KvStore, "_read", lambda self, entries: read.append([(r["part_id"], r["run"]) for r in entries]) or plain(self, entries))
    for step, force in enumerate(["minor", "minor", "partial"]):
        store.flush(batch(step), force=force)
    assert read == [[], [], [(0, 1), (1, 1)]]
    only = spark.createDataFrame([(_key(3), bytearray(b"x"), False, 0, 999)], MUTATIONS)
    store.flush(only, force="major")
    assert sorted(set(read[-1])) in ([(0, 0), (0, 1)], [(0, 0), (0, 1), (1, 0), (1, 1)])
    read.clear()
    assert _seen(store.get(bytes(_key(3)))) == {bytes(_key(3)): b"x"} and {p for p, _ in read[0]} == {0}


def test_major_output_is_split(spark, tmp_path):
    config = compaction.Config(max_pages=1)
    store = KvStore.create(spark, str(tmp_path / "s"), config=config)
    store.flush(spark.createDataFrame([(_key(i), bytearray(b"z" * 300), i % 7 == 0, 0, i) for i in range(200)], MUTATIONS), force="major")
    parts = store.manifest().collect()
    size = {}
    for r in parts:
        size[r["part_id"]] = size.get(r["part_id"], 0) + r["bytes"]
    assert len(size) > 5 and max(size.values()) <= config.major_switch * config.run_bytes
    spans = sorted((bytes(r["first_key"]), bytes(r["last_key"]), bytes(r["anchor"])) for r in parts)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and all(s[2] <= s[0] for s in spans) and spans[0][2] == b""
    model = {bytes(_key(i)): b"z" * 300 for i in range(200) if i % 7}
    assert _seen(store.live()) == model
    store.flush(spark.createDataFrame([(_key(i), bytearray(b"new"), False, 0, i) for i in range(0, 200, 9)], MUTATIONS))
    assert _seen(store.live()) == model | {bytes(_key(i)): b"new" for i in range(0, 200, 9)}


def test_a_failed_write_leaves_the_head(spark, tmp_path):
    store = KvStore.create(spark, str(tmp_path / "s"))
    store.flush(spark.createDataFrame([(_key(1), bytearray(b"a"), False, 0, 1)], MUTATIONS))
    (tmp_path / "s" / "versions" / "v2").mkdir()
    assert store.head() == 1 and store.live().count() == 1
    store.flush(spark.createDataFrame([(_key(2), bytearray(b"b"), False, 0, 2)], MUTATIONS))
    assert store.head() == 3 and store.live().count() == 2


def test_pinned_versions_stay(spark, tmp_path):
    store = KvStore.create(spark, str(tmp_path / "s"))
    for i in range(4):
        store.flush(spark.createDataFrame([(_key(0), bytearray(b"%d" % i), False, 0, i)], MUTATIONS), force="major")
    with store.pin(1) as pin:
        store.collect_garbage(1)
        assert store.versions() == [1, 4] and _seen(store.live(version=pin.version)) == {bytes(_key(0)): b"0"}
    store.collect_garbage(1)
    assert store.versions() == [4]


def test_log_marks_bad_keys(spark, tmp_path):
    log = MutationLog(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([(_key(i), bytearray(b"a"), False, 0, i) for i in range(6)], MUTATIONS)
    log.append(rows.filter("seq < 3"), 1)
    torn = rows.filter("seq >= 3").select("key", "value", "tombstone", "seq", (F.crc32("key") + F.when(F.col("seq") == 4, 1).otherwise(0)).alias("checksum"))
    torn.write.mode("append").parquet(f"{tmp_path}/log/epoch=1")
    assert {r["seq"]: r["checksum_ok"] for r in log.read().collect()} == {i: i != 4 for i in range(6)}
    assert sorted(r["seq"] for r in log.recover().collect()) == [0, 1, 2, 3]


def test_log_recovery_stops_at_a_bad_record(spark, tmp_path):
    log = MutationLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([(_key(i % 3), bytearray(b"a%d" % i), False, 0, i) for i in range(6)], MUTATIONS), 1)
    log.append(spark.createDataFrame([(_key(0), None, True, 0, 0)], MUTATIONS), 2)
    got = {bytes(r["key"]): (r["tombstone"], r["value"] and bytes(r["value"])) for r in log.recover().collect()}
    assert got == {bytes(_key(0)): (True, None), bytes(_key(1)): (False, b"a4"), bytes(_key(2)): (False, b"a5")}
    torn = log.read().withColumn("checksum_ok", (F.col("epoch") != 1) | (F.col("seq") < 3))
    got = {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in writes.replay(torn).collect()}
    assert got == {bytes(_key(0)): None, bytes(_key(1)): b"a1", bytes(_key(2)): b"a2"}


def test_updates_of_one_key_apply_in_order(spark):
    view = spark.createDataFrame([(1, 10.0)], "key long, value double")
    todo = spark.createDataFrame([(1, 2, 3.0), (1, 1, 2.0), (2, 1, 5.0), (3, 1, None)], "key long, seq long, argument double")
    got = writes.read_modify_write(todo, view, lambda old, a: F.coalesce(old, F.lit(1.0)) * a, 1)
    assert {r["key"]: r["value"] for r in got.collect()} == {1: 60.0, 2: 5.0}


def _lru_misses(pages, cap):
    cache, misses = OrderedDict(), 0
    for p in pages:
        if p in cache:
            cache.move_to_end(p)
            continue
        misses += 1
        cache[p] = None
        if len(cache) > cap:
            cache.popitem(last=False)
    return misses


@pytest.mark.parametrize(("chunk", "few"), [(1 << 18, 256), (16, 256), (16, 0), (5, 0)])
def test_lru_sweep(spark, monkeypatch, chunk, few):
    monkeypatch.setattr(lru, "FEW_CHUNKS", few)
    rng = random.Random(chunk)
    pages = [int(rng.paretovariate(0.6)) % 90 for _ in range(700)]
    trace = spark.createDataFrame(list(enumerate(pages)), "seq long, page long")
    got = {r["cap"]: r["miss_count"] for r in lru.sweep(lru.reuse_distances(trace, chunk), [1, 2, 5, 17, 40, 95]).collect()}
    assert got == {c: _lru_misses(pages, c) for c in got}


def test_capacities():
    caps = lru.standard_capacities()
    assert len(caps) == 112 and caps[0] == 8 and caps[-1] == 122_880


def test_bloom_has_no_false_negatives(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).cast("int").alias("run"))
    asked = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    for r in bloom.quality(bloom.test(asked, bloom.build(rows, ["run"]), ["run"]), rows, ["run"]).collect():
        assert r["fn"] == 0 and r["tp"] == 1000 and r["fpr"] < 0.03


def test_partial_keys_find_the_lower_bound():
    rng = random.Random(4)
    stored = sorted({bytes(rng.choices(b"abcz", k=rng.randint(1, 6))) for _ in range(60)})
    p = index.PartialKeys(stored)
    assert (p.codes[1:] > p.codes[:-1]).all()
    for _ in range(400):
        k = bytes(rng.choices(b"abcz", k=rng.randint(0, 7)))
        assert p.correct(k) == sum(s < k for s in stored)
        assert (p.match(k) is not None) == (k in stored)


def test_keys(spark):
    rows = spark.createDataFrame([(bytearray(b"abc"), bytearray(b"abd")), (bytearray(b"ab"), bytearray(b"abz")), (bytearray(b""), bytearray(b"")), (bytearray(b"x"), bytearray(b"x"))], "a binary, b binary")
    got = rows.select(keys.lcp("a", "b").alias("l"), keys.discriminating_bit("a", "b").alias("d")).collect()
    assert [(r["l"], r["d"]["pos"], r["d"]["mask"]) for r in got] == [(2, 2, 4), (2, 2, 64), (0, 0, 0), (1, 1, 0)]
    for a, b in [(b"abc", b"abd"), (b"ab", b"abz")]:
        assert index.dbit(a, b) == tuple(next((r["d"]["pos"], r["d"]["mask"]) for r in [rows.filter(F.col("a") == F.lit(a)).select(keys.discriminating_bit("a", "b").alias("d")).first()]))
    n = spark.createDataFrame([(0,), (1,), (127,), (128,), (300,), (2**40,)], "x long")
    got = n.select("x", keys.reversed_bits("x").alias("r"), keys.rotl64("x", 5).alias("l"), keys.previous_power("x").alias("p"), keys.next_power("x").alias("n"), keys.varint_bytes("x").alias("v"), keys.round_up("x", 64).alias("u"), keys.round_down("x", 64).alias("w")).collect()
    for r in got:
        x = r["x"]
        rev = int(f"{x:064b}"[::-1], 2)
        assert r["r"] == (rev - 2**64 if rev >> 63 else rev) and r["l"] == (x << 5)
        assert r["v"] == max(1, -(-x.bit_length() // 7)) and r["u"] == -(-x // 64) * 64 and r["w"] == x // 64 * 64
        if x:
            assert r["p"] == 1 << (x.bit_length() - 1) and r["n"] == 1 << (x - 1).bit_length()
    printed = rows.limit(1).select(keys.hex_print("a").alias("h"), keys.dec_print("a").alias("d")).first()
    assert tuple(printed) == ("61 62 63", "97 98 99")


def test_generators(spark):
    r = spark.range(5000)
    shuffled = [x[0] for x in r.select(generators.parse("shuffle 0 4999")("id")).collect()]
    assert sorted(shuffled) == list(range(5000)) and shuffled != sorted(shuffled)
    big = 10**12 + 39
    got = [x[0] for x in spark.range(100).select(generators.shuffled(F.col("id"), 0, big - 1)).collect()]
    assert got == [i * keys.coprime_stride(big) % big for i in range(100)]
    zipf = [x["count"] for x in r.select(generators.parse("zipfian 0 99")("id", 3).alias("z")).groupBy("z").count().orderBy("z").collect()]
    assert zipf[0] > zipf[1] > zipf[9] and len(zipf) > 90
    assert abs(generators.zeta(50_000) - sum(i**-0.99 for i in range(1, 50_001))) < 1e-6
    ops = spark.createDataFrame([(i, i % 2 == 0, 0) for i in range(100)], "op long, w boolean, worker int")
    for x in generators.latest(ops, "op", "w", "worker", 10).collect():
        assert 0 <= x["number"] <= 50
    with pytest.raises(ValueError):
        generators.parse("nothing 1 2")


def test_levels_place_three_quarters_of_the_keys(spark):
    levels = workload.run_levels(spark.range(4000).select(F.col("id").cast("string").alias("key")), 4)
    share = levels.filter("inserted").count() / 4000
    assert 0.7 < share < 0.8
    records = workload.run_records(levels, 4)
    assert records.select("key").distinct().count() == levels.filter("inserted").count()
    assert workload.key_sets(levels, "missing").join(records, "key", "left_semi").isEmpty()


def test_workload_ops(spark):
    ops = workload.ycsb_ops(spark, 2000, 2, workload.MIXES["E"], 0, 99_999)
    share = {r["op"]: r["count"] for r in ops.groupBy("op").count().collect()}
    assert set(share) == {"scan", "set"} and 0.9 < share["scan"] / 4000 < 0.98
    assert ops.filter("number < 0 or number > 99999").isEmpty()
    assert workload.pass_ops(spark, "S", 10, 3, "uniform 0 9").groupBy("worker").count().count() == 3
    latest = workload.ycsb_ops(spark, 200, 2, workload.MIXES["D"], 0, 0)
    assert latest.count() == 400


def test_loaders(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("a \nb\t\nc d\n")
    assert sorted(bytes(r[0]) for r in loaders.load(spark, str(tmp_path / "keys.txt")).collect()) == [b"a", b"b", b"c d"]
    (tmp_path / "k.genkv").write_text("6 4 97\n1 2\n3 3\n")
    got = [bytes(r["key"]) for r in loaders.load(spark, str(tmp_path / "k.genkv")).orderBy("id").collect()]
    assert got == [b"aaaa", b"aaab", b"aaac", b"abaa", b"abab", b"abac"]
    loaders.write_trace(spark.createDataFrame([(0, 5), (1, 9)], "seq long, page long"), str(tmp_path / "t.trace"))
    assert [r["page"] for r in loaders.load(spark, str(tmp_path / "t.trace")).orderBy("seq").collect()] == [5, 9]


def test_maps_by_name(spark):
    rows = spark.createDataFrame([(_key(1), bytearray(b"a"), False, 0, 0), (_key(1), None, True, 1, 0), (_key(2), bytearray(b"b"), False, 0, 0)], MUTATIONS)
    count = lambda n: registry.open_map(n, rows).view.count()
    assert (count("store"), count("stack_newest"), count("stack_versions"), count("run")) == (1, 2, 3, 3)
    m = registry.open_map("memory", rows)
    assert not m.probe(b"k0001") and m.probe(b"k0002")
    kept, n = m.delete_range(b"k0002")
    assert n == 1 and kept.view.isEmpty()
    with pytest.raises(ValueError):
        registry.open_map("nothing", rows)


def test_stream_equals_batch(spark, tmp_path):
    from kvstrata.streaming import upsert

    rng, model = random.Random(3), {}
    for i in range(3):
        _batch(spark, rng, 40, model, i * 100).write.mode("append").parquet(str(tmp_path / "in"))
    store = KvStore.create(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema(MUTATIONS).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = upsert.sink_to_store(stream, store, str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert _seen(store.live()) == model
