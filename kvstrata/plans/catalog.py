"""Named queries over the driver's tables, each with the SQL it must agree with.

Roles: events is a mutation log (key user_id, order ts and event_id, click plays the tombstone);
orders is a map of single versions; lineitem holds runs (the place of a row among those of
its order, 17 at sf0.1 and as many as the longest order has in general; R plays the tombstone); events by time is also a page trace.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import generators, keys, statistics
from ..operators import bloom, compaction, index, lru, reads, views, workload, writes
from ..session import globally_ranked, shared_dir
from ..sources.store import KvStore, MutationLog
from . import reports

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), "o_custkey")


def _runs(spark, d) -> DataFrame:
    """lineitem as mutations; an order has a few rows, so the window's groups are small."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    run = F.row_number().over(w) - 1
    return rows.select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").alias("tombstone"), run.alias("run"), F.col("l_partkey").alias("seq"))


def _ranked(spark, d) -> DataFrame:
    """The runs as one frame for merges, with the number of their run; an order may have any number of rows."""
    return _runs(spark, d).withColumnRenamed("run", "rank")


RUNS = "r AS (SELECT l_orderkey AS key, l_quantity AS value, l_returnflag = 'R' AS tombstone, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS run FROM lineitem)"
NEWEST = "n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY run DESC) = 1)"

# Views


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1 AND event_type <> 'click'")
def kv_live_view(spark, d):
    return views.live(_events(spark, d), "user_id", ("ts", "event_id"), F.col("event_type") == "click").select("user_id", "event_id", "value")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def kv_newest_with_ts(spark, d):
    return views.newest(_events(spark, d), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type = 'click' AS tombstone, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 1 AS stale FROM events")
def kv_all_versions_flags(spark, d):
    rows = _events(spark, d).withColumn("tombstone", F.col("event_type") == "click").select("user_id", "ts", "event_id", "tombstone")
    return views.all_versions(rows, "user_id", ("ts", "event_id")).select("user_id", "event_id", "tombstone", "stale")


@query(f"WITH {RUNS} SELECT key, run, tombstone, run < max(run) OVER (PARTITION BY key) AS stale, run = 0 AS tail FROM r")
def kv_sorted_view(spark, d):
    return index.sorted_view(_runs(spark, d)).select("key", "run", "tombstone", "stale", "tail")


# Merges


@query(f"WITH {RUNS} SELECT key, run, value, run < max(run) OVER (PARTITION BY key) AS repeated FROM r")
def kv_merge_runs(spark, d):
    return views.ranked_history(_ranked(spark, d)).select("key", F.col("rank").alias("run"), "value", "repeated")


@query(f"WITH {RUNS}, {NEWEST} SELECT key, run, value, tombstone FROM n")
def kv_merge_unique(spark, d):
    return views.ranked_unique(_ranked(spark, d)).select("key", F.col("rank").alias("run"), "value", "tombstone")


@query(f"WITH {RUNS}, {NEWEST} SELECT key, run, value FROM n WHERE run >= 3")
def kv_partial_merge(spark, d):
    return views.partial_merge(_runs(spark, d), 3).select("key", "run", "value")


@query(f"WITH {RUNS}, {NEWEST} SELECT key, value FROM n WHERE NOT tombstone")
def kv_incremental_merge(spark, d):
    rows = _runs(spark, d)
    old = views.newest(rows.filter("run < 4"))
    return views.incremental(old, rows.filter("run >= 4")).filter("not tombstone").select("key", "value")


@query(f"WITH {RUNS}, {NEWEST} SELECT key, value FROM n WHERE NOT tombstone")
def kv_live_tiers(spark, d):
    rows = _runs(spark, d)
    store, immutable, memory = (views.newest(rows.filter(c)).drop("run", "seq") for c in ("run < 2", "run between 2 and 3", "run > 3"))
    return views.tiers(store, immutable, memory).select("key", "value")


@query(f"WITH {RUNS}, e AS (SELECT run, min(key) AS first_key, max(key) AS last_key FROM r GROUP BY run) SELECT run, first_key, last_key, coalesce(first_key <= lag(last_key) OVER (ORDER BY run), false) AS overlaps FROM e")
def kv_run_overlap(spark, d):
    return views.run_overlap(_runs(spark, d))


# Point reads


@query("SELECT c_custkey AS user_id, coalesce(event_id, -1) AS event_id, coalesce(value, -1.0) AS value FROM customer LEFT JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON c_custkey = user_id AND event_type <> 'click'")
def kv_batch_get(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return reads.batch_get(asked, kv_live_view(spark, d), "user_id").fillna(-1)


LIVE = "SELECT user_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'click'"


@query(f"SELECT c_custkey AS user_id FROM customer WHERE c_custkey IN ({LIVE})")
def kv_batch_probe(spark, d):
    return reads.batch_probe(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), kv_live_view(spark, d), "user_id")


@query(f"SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN ({LIVE})")
def kv_batch_miss(spark, d):
    return reads.batch_miss(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), kv_live_view(spark, d), "user_id")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey = 100")
def kv_get(spark, d):
    return reads.get(_orders(spark, d), 100).select("key", "value")


@query("SELECT c_custkey AS key, CASE WHEN o_orderkey IS NULL THEN -1.0 ELSE o_totalprice END AS result FROM customer LEFT JOIN orders ON o_orderkey = c_custkey")
def kv_read_in_place(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return reads.read_in_place(asked, _orders(spark, d), F.coalesce("value", F.lit(-1.0))).select("key", "result")


@query("SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def kv_first_last(spark, d):
    return reads.first_last(_orders(spark, d))


# Range reads


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 777 ORDER BY 1 LIMIT 1")
def kv_seek_ge(spark, d):
    return reads.seek(_orders(spark, d), 777).select("key", "value")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey <= 777 ORDER BY 1 DESC LIMIT 3")
def kv_seek_le(spark, d):
    return reads.seek_at_most(_orders(spark, d), 777, 3).select("key", "value")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 500 ORDER BY 1 LIMIT 50")
def kv_scan_n(spark, d):
    return reads.seek(_orders(spark, d), 500, 50).select("key", "value")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 500 ORDER BY 1 LIMIT 5 OFFSET 20")
def kv_skip_n(spark, d):
    return reads.seek(_orders(spark, d), 500, 5, 20).select("key", "value")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= greatest(900, 300) ORDER BY 1 LIMIT 4")
def kv_seek_near(spark, d):
    return reads.seek_near(_orders(spark, d), 900, 300, 4).select("key", "value")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def kv_scan_range(spark, d):
    return reads.scan(_orders(spark, d), 100, 400).select("key", "value")


OPS = "ops AS (SELECT c_custkey AS op_id, c_custkey * 7 + 3 AS key, c_custkey % 3 AS skip, c_custkey % 6 AS n FROM customer)"


@query(
    f"WITH {OPS}, k AS (SELECT o_orderkey AS key, o_totalprice AS value, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders), "
    "s AS (SELECT ops.*, j.rank AS r FROM ops ASOF JOIN k j ON ops.key <= j.key) "
    "SELECT op_id, (k.rank - r - skip)::INT AS step, k.key, k.value FROM s JOIN k ON k.rank >= r + skip AND k.rank < r + skip + n"
)
def kv_batch_range_scan(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("op_id"))
    ops = c.select("op_id", (F.col("op_id") * 7 + 3).alias("key"), (F.col("op_id") % 3).alias("skip"), (F.col("op_id") % 6).alias("n"))
    return reads.batch_range(ops, _orders(spark, d).select("key", "value"))


@query("WITH a AS (SELECT n_nationkey * 1000 AS anchor, n_nationkey AS part_id FROM nation) SELECT o_orderkey AS key, part_id, anchor FROM orders ASOF LEFT JOIN a ON o_orderkey >= anchor")
def kv_anchor_lookup(spark, d):
    anchors = table(spark, d, "nation").select((F.col("n_nationkey") * 1000).alias("anchor"), F.col("n_nationkey").alias("part_id"))
    return reads.locate(_orders(spark, d).select("key"), anchors).select("key", "part_id", F.col("anchor").cast("int").alias("anchor"))


# Writes


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN 0.5 ELSE o_totalprice END AS value FROM orders UNION ALL SELECT -1, 0.5")
def kv_put_overwrite(spark, d):
    rows = writes.put(_orders(spark, d), 0, F.lit(0).cast("long"))
    new = rows.filter("key % 10 = 0").select("key").union(spark.range(1).select(F.lit(-1).cast("long"))).select("key", F.lit(0.5).alias("value"))
    return views.live(rows.unionByName(writes.put(new, 1, F.lit(1).cast("long")))).select("key", "value")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 3 <> 1")
def kv_delete(spark, d):
    rows = writes.put(_orders(spark, d), 0, F.lit(0).cast("long"))
    gone = writes.delete(rows.filter("key % 3 = 1").select("key"), 1, F.lit(1).cast("long"), "double")
    return views.live(rows.unionByName(gone)).select("key", "value")


@query("SELECT o_orderkey AS key, o_orderkey % 3 <> 1 AS stays FROM orders")
def kv_deleted_keys(spark, d):
    """Deletes that look first: what stays, and the keys that were there."""
    view = _orders(spark, d).select("key", "value")
    stays, gone = writes.deleted(view, view.filter("key % 3 = 1").select("key").union(spark.range(1).select(F.lit(-5).cast("long"))))
    return stays.select("key", F.lit(True).alias("stays")).union(gone.select("key", F.lit(False)))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE NOT (o_orderkey >= 200 AND o_orderkey < 1200)")
def kv_delete_range(spark, d):
    return writes.delete_range(_orders(spark, d), 200, 1200)[0].select("key", "value")


@query("SELECT o_orderkey AS key, (coalesce(sum(l_quantity), 0) + o_custkey)::DOUBLE AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def kv_rmw_sum(spark, d):
    view = _orders(spark, d).select("key", F.col("o_custkey").cast("double").alias("value"))
    updates = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("argument"), F.col("l_partkey").alias("seq"))
    return writes.add_up(updates.join(view.select("key"), "key", "left_semi"), view, 1).select("key", "value")


@query(
    f"WITH {RUNS} SELECT key, arg_max(value, run) AS value FROM r LEFT JOIN orders ON o_orderkey = key WHERE NOT tombstone AND value > 10 GROUP BY key, o_custkey HAVING arg_max(value, run) IS DISTINCT FROM o_custkey"
)
def kv_rmw_sequence(spark, d):
    """Updates in order; those of 10 or less, and tombstones, leave the value as it is."""
    view = _orders(spark, d).select("key", F.col("o_custkey").cast("double").alias("value"))
    updates = _runs(spark, d).select("key", F.col("run").cast("long").alias("seq"), F.when(~F.col("tombstone") & (F.col("value") > 10), F.col("value")).alias("argument"))
    return writes.read_modify_write(updates, view, lambda old, a: F.when(a.isNotNull(), a), 1).select("key", "value")


@query("SELECT o_orderkey AS key, CASE WHEN c_custkey IS NOT NULL THEN 1.0 ELSE o_totalprice END AS value FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def kv_write_in_place(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return writes.write_in_place(_orders(spark, d).select("key", "value"), asked, F.lit(1.0))


@query(
    "WITH o AS (SELECT o_orderkey AS key, o_totalprice AS value FROM orders), fresh AS (SELECT * FROM o WHERE key % 2 = 0), rejected AS (SELECT key, -1.0 AS value FROM o WHERE key % 3 = 0) "
    "SELECT * FROM fresh UNION ALL SELECT * FROM rejected WHERE key NOT IN (SELECT key FROM fresh)"
)
def kv_reinsert_rejected(spark, d):
    o = _orders(spark, d).select("key", "value")
    return writes.reinsert(o.filter("key % 3 = 0").withColumn("value", F.lit(-1.0)), o.filter("key % 2 = 0"))


@query("SELECT id, least(id // 333, 2)::INT AS worker FROM range(1000) t(id)")
def kv_bulk_ranges(spark, d):
    return writes.bulk(spark, 1000, 3)


@query(
    "WITH l AS (SELECT user_id AS key, event_id AS seq, event_id % 2 AS epoch, value, event_id % 997 <> 996 AS ok FROM events), "
    "b AS (SELECT epoch, min(seq) AS bad FROM l WHERE NOT ok GROUP BY epoch), v AS (SELECT l.* FROM l LEFT JOIN b USING (epoch) WHERE bad IS NULL OR seq < bad) "
    "SELECT key, epoch, seq, value FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seq DESC) = 1"
)
def kv_wal_replay_prefix(spark, d):
    log = _events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).alias("epoch"), "value", (F.col("event_id") % 997 != 996).alias("checksum_ok"))
    return writes.replay(log).select("key", "epoch", "seq", "value")


# Index statistics


@query(
    f"WITH {RUNS}, f AS (SELECT *, run < max(run) OVER (PARTITION BY key) AS stale FROM r), s AS (SELECT run, count(*) AS n_kv, count(*) FILTER (NOT stale) AS valid_kv, count(*) FILTER (stale) AS stale_kv, "
    "count(*) FILTER (NOT stale AND tombstone) AS valid_ts, count(*) FILTER (stale AND tombstone) AS stale_ts FROM f GROUP BY run) "
    "SELECT run, " + ", ".join(f"(sum({c}) OVER (ORDER BY run DESC))::BIGINT AS {c}" for c in ("n_kv", "valid_kv", "stale_kv", "valid_ts", "stale_ts")) + " FROM s"
)
def kv_suffix_stats(spark, d):
    rows = _runs(spark, d).withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("value").cast("string"))
    return index.suffix_statistics(rows).select("run", "n_kv", "valid_kv", "stale_kv", "valid_ts", "stale_ts")


@query(f"WITH {RUNS}, {NEWEST}, c AS (SELECT run, count(*) AS n FROM n GROUP BY run), a AS (SELECT DISTINCT run FROM r) SELECT a.run, (sum(coalesce(n, 0)) OVER (ORDER BY a.run DESC))::BIGINT AS uniqx FROM a LEFT JOIN c USING (run)")
def kv_uniqx(spark, d):
    return index.newest_per_suffix(_runs(spark, d))


@query("WITH k AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS s FROM orders), c AS (SELECT s, count(*) AS n_keys FROM k GROUP BY s) SELECT n_keys, count(*) AS n_segments FROM c GROUP BY n_keys")
def kv_segment_histogram(spark, d):
    return index.segment_histogram(globally_ranked(_orders(spark, d).select("key"), "key"))


_LCP = "coalesce(list_max(list_transform(range(0, least(length(previous), length(key)) + 1), lambda i: CASE WHEN left(previous, i) = left(key, i) THEN i ELSE 0 END)), 0)"


@query(f"WITH k AS (SELECT url AS key, lag(url) OVER (ORDER BY url) AS previous FROM pages) SELECT key, CASE WHEN previous IS NULL THEN '' ELSE left(key, least({_LCP} + 1, length(key))::INT) END AS anchor FROM k")
def kv_truncated_anchors(spark, d):
    urls = table(spark, d, "pages").select(F.col("url").alias("key"))
    return index.anchors(urls).select("key", "anchor")


@query(f"WITH k AS (SELECT url AS key, lag(url) OVER (ORDER BY url) AS previous FROM pages) SELECT key, {_LCP}::INT AS lcp, substr(key, {_LCP}::INT + 1) AS suffix FROM k")
def kv_compressed_keys(spark, d):
    urls = table(spark, d, "pages").select(F.col("url").alias("key"))
    return index.compressed_keys(urls).select("key", "lcp", "suffix")


@query(f"WITH {RUNS}, p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY key) - 1 AS idx FROM r) SELECT key, run, idx, tombstone FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY run DESC) = 1")
def kv_full_index(spark, d):
    return index.full_index(_runs(spark, d))


@query("SELECT (o_orderkey // 1000)::INT AS part_id, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def kv_key_range(spark, d):
    return index.key_range(_orders(spark, d).withColumn("part_id", F.floor(F.col("key") / 1000).cast("int")))


@query("SELECT count(DISTINCT url) AS n_keys, 0::BIGINT AS n_overfull, 0::BIGINT AS n_closed_early, 0::BIGINT AS n_alike FROM pages")
def kv_bit_segments(spark, d):
    """Segments of page urls by the bits that tell their keys apart: all keys, none over its limits, none closed before them.

    A segment is determined by where its range begins and these rules, so no count but 0 shows a wrong one.
    """
    rows = table(spark, d, "pages").select(F.col("url").cast("binary").alias("key"))
    found = index.discriminating_bits(index.bit_segments(rows))
    last = F.col("segment") == F.max("segment").over(Window.partitionBy("pid"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    # A key adds one bit at most, so a segment that closed at its limit of bits has exactly so many.
    over = (F.col("n_keys") > index.SEGMENT_KEYS) | (F.col("n_bits") > index.SEGMENT_BITS)
    early = ~F.col("last") & (F.col("n_keys") < index.SEGMENT_KEYS) & (F.col("n_bits") < index.SEGMENT_BITS)
    return found.withColumn("last", last).agg(F.sum("n_keys").alias("n_keys"), one(over).alias("n_overfull"), one(early).alias("n_closed_early"), one((F.col("n_keys") > 1) & (F.col("n_bits") == 0)).alias("n_alike"))


@query(
    "WITH u AS (SELECT DISTINCT url FROM pages), r AS (SELECT url, row_number() OVER (ORDER BY url) AS n FROM u), p AS (SELECT url AS key FROM u UNION SELECT url || 'x' FROM u UNION SELECT left(url, 9) FROM u) "
    "SELECT key, coalesce(n, 0)::BIGINT AS n_below, EXISTS (SELECT 1 FROM u WHERE url = key) AS matched FROM p ASOF LEFT JOIN r ON p.key > r.url"
)
def kv_partial_key_search(spark, d):
    """Page urls, urls with a letter more and their beginnings, looked up by the bits that tell urls apart."""
    urls = table(spark, d, "pages").select(F.col("url").alias("key"))
    probes = urls.union(urls.select(F.concat("key", F.lit("x")))).union(urls.select(F.substring("key", 1, 9)))
    found = index.partial_key_search(index.bit_segments(urls), probes.select(F.col("key").cast("binary").alias("key")))
    return found.select(F.col("key").cast("string").alias("key"), "n_below", "matched")


@query("SELECT count(*) AS n_versions, count(DISTINCT l_orderkey) AS n_keys, 0::BIGINT AS n_overfull, 0::BIGINT AS n_closed_early, 0::BIGINT AS n_out_of_order FROM lineitem")
def kv_slot_segments(spark, d):
    """Segments of whole keys: all versions, no segment over its slots, none closed where the next key's versions would fit."""
    rows = _runs(spark, d).select("key")
    placed = index.slot_segments(rows).join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
    segments = placed.groupBy("pid", "segment").agg(F.count("*").alias("keys"), F.sum("n").alias("used"), F.min("key").alias("low"), F.max("key").alias("high"), F.min_by("n", "key").alias("first_n"))
    order = Window.partitionBy("pid").orderBy("segment")
    segments = segments.withColumn("next_n", F.lead("first_n").over(order)).withColumn("next_low", F.lead("low").over(order))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return segments.agg(
        F.sum("used").alias("n_versions"), F.sum("keys").alias("n_keys"), one((F.col("used") > index.SLOTS) & (F.col("keys") > 1)).alias("n_overfull"),
        one(F.col("used") + F.col("next_n") <= index.SLOTS).alias("n_closed_early"), one(F.col("next_low") <= F.col("high")).alias("n_out_of_order"),
    )


@query(f"WITH {RUNS}, c AS (SELECT run, count(DISTINCT key) AS tp FROM r SEMI JOIN orders ON key = o_orderkey GROUP BY run) SELECT run, tp, 0::BIGINT AS fn, (SELECT count(*) FROM orders) - tp AS n_absent, true AS few_pass FROM c")
def kv_bloom_quality(spark, d):
    """Filters of all runs: no key that is there is refused, and of the absent ones about 1 in 100 passes (below 3; filters of a few keys have too few bits for that)."""
    rows = _runs(spark, d).select("key", "run")
    filters = bloom.build(rows, ["run"])
    got = bloom.quality(bloom.test(_orders(spark, d).select("key"), filters, ["run"]), rows, ["run"])
    return got.select("run", "tp", "fn", (F.col("fp") + F.col("tn")).alias("n_absent"), ((F.col("tp") < 100) | (F.col("fp") <= F.col("tn") * 0.03 + 2)).alias("few_pass"))


@query(f"WITH {RUNS} SELECT run, count(*) AS n_keys, 0::BIGINT AS n_refused FROM r GROUP BY run")
def kv_page_bloom(spark, d):
    """A filter for every page of 100 keys of a run; each key is tested against its own page's."""
    placed = globally_ranked(_runs(spark, d).select("run", "key"), "run", "key", name="place").select("run", "key", F.floor(F.col("place") / 100).alias("page"))
    tested = bloom.test(placed, bloom.build(placed, ["run", "page"]), ["run", "page"])
    return tested.groupBy("run").agg(F.count("*").alias("n_keys"), F.sum(F.when(F.col("maybe"), 0).otherwise(1)).alias("n_refused"))


# Compaction

_PARTS = (
    "WITH s0 AS (SELECT (l_orderkey // 4000)::INT AS part_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS run FROM lineitem), "
    "s1 AS (SELECT part_id, run, count(*) AS n_kv FROM s0 GROUP BY part_id, run), t AS (SELECT part_id, sum(n_kv) AS totkv, max(run) + 1 AS r FROM s1 GROUP BY part_id), "
    "s2 AS (SELECT part_id, run, n_kv FROM s1 UNION ALL SELECT part_id, r, 0 FROM t), "
    "f1 AS (SELECT s2.part_id, s2.run, t.r, totkv, totkv * 40 AS totsz, (totkv // 3) AS newnr, (totkv // 3) * 50 AS newsz, "
    "sum(n_kv) OVER (PARTITION BY s2.part_id ORDER BY run DESC) AS accu, coalesce(sum(n_kv) OVER (PARTITION BY s2.part_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s2 JOIN t USING (part_id)), "
    "f2 AS (SELECT *, newsz + CASE WHEN run = 0 THEN totkv ELSE accu END * (totsz // totkv) AS wx FROM f1), f3 AS (SELECT *, wx / (3840.0 * 20400)::DOUBLE + run AS nrun1 FROM f2), "
    "f4 AS (SELECT *, (8 * ceil(CASE WHEN run = 0 THEN least(nrun1, 8.0) ELSE nrun1 END) + 16) * ((newnr + CASE WHEN run = 0 THEN totkv ELSE below + accu END) // 32) + newnr + CASE WHEN run = 0 THEN totkv ELSE below + accu END AS wy FROM f3), "
    "f5 AS (SELECT *, (wx + wy) / newsz::DOUBLE AS wa, max(CASE WHEN run = r THEN nrun1 END) OVER (PARTITION BY part_id) AS last FROM f4), "
    "f6 AS (SELECT *, (wa + nrun1 * 0.75) / (last - nrun1 + CASE WHEN run = 0 AND last > 8 THEN nrun1 - 2 ELSE 0 END + CASE WHEN run = r THEN 1 ELSE 0 END + 4.0) AS score FROM f5) "
)


def _part_stats(spark, d) -> DataFrame:
    s = _runs(spark, d).groupBy(F.floor(F.col("key") / 4000).cast("int").alias("part_id"), "run").agg(F.count("*").alias("n_kv"))
    t = s.groupBy("part_id").agg(F.sum("n_kv").alias("totkv"), (F.max("run") + 1).alias("r"))
    rows = s.unionByName(t.select("part_id", F.col("r").alias("run"), F.lit(0).cast("long").alias("n_kv"))).join(t.drop("r"), "part_id")
    new = F.floor(F.col("totkv") / 3)
    return rows.select("part_id", "run", "n_kv", F.col("totkv").alias("valid"), "totkv", (F.col("totkv") * 40).alias("totsz"), new.alias("newnr"), (new * 50).alias("newsz"))


@query(_PARTS + "SELECT part_id, run, round(score, 6) AS score FROM f6")
def kv_compaction_scores(spark, d):
    return compaction.scores(_part_stats(spark, d)).select("part_id", "run", F.round("score", 6).alias("score"))


@query(_PARTS + "SELECT part_id, run AS bestrun, CASE WHEN run = 0 THEN 'major' WHEN run < r THEN 'partial' ELSE 'minor' END AS kind FROM f6 WHERE run = 0 OR (run < 8 AND nrun1 < 14) QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY score, run) = 1")
def kv_compaction_plan(spark, d):
    stats = _part_stats(spark, d)
    best = compaction.best_runs(compaction.scores(stats))
    parts = stats.groupBy("part_id").agg(F.max("run").alias("n_runs"), F.max("valid").alias("valid"), F.max("newnr").alias("newnr"), F.max("newsz").alias("newsz"), F.max("totsz").alias("totsz"))
    return compaction.plan(parts.withColumn("overlap", F.lit(True)).withColumn("is_last", F.lit(False)), best).select("part_id", "bestrun", "kind")


@query(
    "SELECT n_nationkey AS part_id, CASE WHEN n_nationkey % 5 = 0 THEN 'major' WHEN n_nationkey % 5 = 1 THEN 'reject' WHEN n_nationkey = 24 THEN 'append' WHEN n_nationkey % 4 = 0 THEN 'major' WHEN n_nationkey % 4 < 3 THEN 'partial' ELSE 'minor' END AS kind, "
    "CASE WHEN n_nationkey % 5 = 0 THEN 0 WHEN n_nationkey % 5 = 1 THEN 8 WHEN n_nationkey = 24 THEN 16 ELSE n_nationkey % 4 END AS bestrun FROM nation"
)
def kv_compaction_kinds(spark, d):
    """Every branch of a plan: empty partitions, nothing new, new data behind the last key, all, some or none rewritten."""
    id_ = F.col("n_nationkey")
    parts = table(spark, d, "nation").select(
        id_.alias("part_id"), F.lit(3).alias("n_runs"), F.when(id_ % 5 == 0, 0).otherwise(900).alias("valid"), F.when(id_ % 5 == 1, 0).otherwise(10).alias("newnr"),
        F.lit(100_000_000).cast("long").alias("newsz"), F.lit(1_000).cast("long").alias("totsz"), (id_ != 24).alias("overlap"), (id_ == 24).alias("is_last"),
    )
    best = table(spark, d, "nation").select(id_.alias("part_id"), (id_ % 4).alias("bestrun"))
    return compaction.plan(parts, best).select("part_id", "kind", "bestrun")


@query(
    "WITH p AS (SELECT n_nationkey AS part_id, n_nationkey * 1000000 AS newsz, (n_nationkey % 7) * 0.02 AS ratio FROM nation), "
    "o AS (SELECT *, max(CASE WHEN newsz > 4096 * 5000 OR s > 30000000 OR ratio > 0.1 THEN 1 ELSE 0 END) OVER (ORDER BY ratio, part_id) AS stop FROM (SELECT *, sum(newsz) OVER (ORDER BY ratio, part_id) AS s FROM p)) "
    "SELECT part_id, CASE WHEN stop = 1 THEN 'minor' ELSE 'reject' END AS kind FROM o"
)
def kv_reject_partitions(spark, d):
    n = table(spark, d, "nation")
    planned = n.select(F.col("n_nationkey").alias("part_id"), F.lit("minor").alias("kind"), F.lit(1).alias("bestrun"), (F.col("n_nationkey") * 1_000_000).cast("long").alias("newsz"), ((F.col("n_nationkey") % 7) * 0.02).alias("ratio"))
    return compaction.reject_small(planned, 30_000_000).select("part_id", "kind")


@query(f"WITH {RUNS}, {NEWEST} SELECT key, value FROM n WHERE NOT tombstone")
def kv_compacted_major(spark, d):
    rows = _runs(spark, d)
    return compaction.major(rows.filter("run < 5"), rows.filter("run >= 5")).select("key", "value")


@query(f"WITH {RUNS}, {NEWEST} SELECT key, value FROM n WHERE NOT tombstone")
def kv_compacted_partial(spark, d):
    rows = _runs(spark, d)
    return views.live(compaction.partial(rows.filter("run < 5"), rows.filter("run >= 5"), 2)).select("key", "value")


@query(f"WITH {RUNS}, {NEWEST} SELECT key, value FROM n WHERE NOT tombstone")
def kv_compacted_minor(spark, d):
    rows = _runs(spark, d)
    return views.live(compaction.minor(rows.filter("run < 5"), rows.filter("run >= 5"))).select("key", "value")


# Keys and generators


@query("SELECT o_orderkey AS id, lpad(lower(hex(o_orderkey)), 16, '0') AS key16, '!!!!' || lpad(lower(hex(o_orderkey)), 16, '0') AS key20 FROM orders")
def kv_hex_keys(spark, d):
    return _orders(spark, d).select(F.col("key").alias("id"), keys.hex_key("key").alias("key16"), keys.hex_key("key", 20).alias("key20"))


@query("SELECT o_orderkey AS id, o_orderkey AS back FROM orders")
def kv_u64_round_trip(spark, d):
    return _orders(spark, d).select(F.col("key").alias("id"), keys.u64_value(keys.u64_key("key")).cast("long").alias("back"))


_VARINT = "upper(list_aggregate(list_transform(range(0, n), lambda i: printf('%02x', ((key >> (7 * i)::INT) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END)), 'string_agg', ''))"


@query(f"WITH k AS (SELECT o_orderkey AS key, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::BIGINT AS n FROM orders) SELECT key, {_VARINT} AS code, key AS back FROM k")
def kv_varint(spark, d):
    coded = _orders(spark, d).select("key", keys.varint("key").alias("b"))
    return coded.select("key", F.hex("b").alias("code"), keys.varint_value("b").alias("back"))


_CRC = f"list_reduce(list_prepend({keys.KEY_SEED}::BIGINT, list_transform(string_split(lpad(lower(hex(o_orderkey)), 16, '0'), ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, ({keys.crc32c_table()}::BIGINT[])[(xor(a, b) & 255) + 1]))"


@query(f"SELECT o_orderkey AS key, {_CRC} AS crc FROM orders")
def kv_crc32c(spark, d):
    return _orders(spark, d).select("key", keys.crc32c(keys.hex_key("key")).alias("crc"))


@query("SELECT (o_custkey % 7)::INT AS part, count(DISTINCT o_orderkey % 1000)::BIGINT AS n_set, min(o_orderkey % 1000)::BIGINT AS first, bool_or(o_orderkey % 1000 = 500) AS has FROM orders GROUP BY 1")
def kv_bitmap(spark, d):
    rows = _orders(spark, d).select((F.col("o_custkey") % 7).cast("int").alias("part"), (F.col("key") % 1000).alias("number"))
    return statistics.bitmap_summary(statistics.bitmap(rows, ["part"], "number"), ["part"], 500)


@query("WITH r AS (SELECT o_totalprice AS value, row_number() OVER (ORDER BY o_totalprice) - 1 AS rank, count(*) OVER () AS total FROM orders) SELECT i::INT AS step, value FROM range(101) t(i) JOIN r ON rank = (i * (total - 1)) // 100")
def kv_systematic_sample(spark, d):
    return statistics.systematic_sample(_orders(spark, d), "value", 101)


@query("SELECT id, (7 + id % 50)::BIGINT AS incs, (56 - id % 50)::BIGINT AS decs, (7 + (id * 13) % 50)::BIGINT AS skips FROM range(1000) t(id)")
def kv_sequences(spark, d):
    r = spark.range(1000)
    return r.select("id", generators.ascending("id", 7, 56).alias("incs"), generators.descending("id", 7, 56).alias("decs"), generators.skipping("id", 7, 56, 13).alias("skips"))


@query(f"SELECT id, ((id * {keys.coprime_stride(5000)} + 17) % 5000)::BIGINT AS number FROM range(5000) t(id)")
def kv_shuffle_permutation(spark, d):
    return spark.range(5000).select("id", generators.shuffled("id", 0, 4999, 17).alias("number"))


_ZIPF = {n: [(i + 1) ** -generators.THETA for i in range(n)] for n in (1000, 100)}


def _zipf_mean(n: int) -> float:
    return sum(i * p for i, p in enumerate(_ZIPF[n])) / sum(_ZIPF[n])


#: Specification, least and largest number allowed, and the mean (None: the order of numbers is scattered).
_KINDS = {
    "uniform": ("uniform 0 999", 0, 999, 499.5), "zipfian": ("zipfian 0 999", 0, 999, _zipf_mean(1000)), "xzipfian": ("xzipfian 0 999", 0, 999, None),
    "unizipf": ("unizipf 0 999 10", 0, 999, 450 + _zipf_mean(100)), "zipfuni": ("zipfuni 0 999 10", 0, 999, 10 * _zipf_mean(100) + 4.5),
    "expo": ("expo 95 1000", 0, 1 << 40, 1000 / math.log(20) - 0.5), "geo": ("geo 0.01", 0, 1 << 40, 99.0),
}


@query("SELECT kind, 0::BIGINT AS n_outside, true AS mean_ok FROM (VALUES " + ", ".join(f"('{k}')" for k in _KINDS) + ") t(kind)")
def kv_distributions(spark, d):
    """20,000 draws of every random generator: none outside its range, and a mean within a twentieth of the distribution's."""
    rows = spark.range(20_000)
    cells = [F.struct(F.lit(n).alias("kind"), generators.parse(k[0])("id", 42).alias("number"), F.lit(k[1]).cast("long").alias("low"), F.lit(k[2]).cast("long").alias("high"), F.lit(k[3]).cast("double").alias("want")) for n, k in _KINDS.items()]
    long = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    near = F.coalesce(F.abs(F.avg("number") - F.first("want")) < F.first("want") * 0.05, F.lit(True))
    return long.groupBy("kind").agg(F.sum(F.when(F.col("number").between(F.col("low"), F.col("high")), 0).otherwise(1)).alias("n_outside"), near.alias("mean_ok"))


@query("SELECT event_id, (sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 4 ORDER BY event_id))::BIGINT AS newest, true AS in_reach FROM events")
def kv_latest(spark, d):
    """Writes take the next number of their worker; a read falls at most 1,000 behind the newest one."""
    ops = _events(spark, d).select("event_id", (F.col("value") > 50).alias("is_write"), (F.col("user_id") % 4).alias("worker"))
    newest = F.sum(F.col("is_write").cast("long")).over(Window.partitionBy("worker").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    got = generators.latest(ops, "event_id", "is_write", "worker", 1000).withColumn("newest", newest)
    behind = F.col("newest") - F.col("number")
    return got.select("event_id", "newest", F.when(F.col("is_write"), behind == 0).otherwise((F.col("number") >= 0) & behind.between(0, 999)).alias("in_reach"))


@query("SELECT count(*) AS n_mixed, count(*) AS n_parts, 0::BIGINT AS n_both, true AS share_ok, 0::BIGINT AS n_wrong_run FROM orders")
def kv_key_sets(spark, d):
    """Keys placed in runs: existing and missing keys are all keys and no key twice, three in four exist, runs are those drawn."""
    levels = workload.run_levels(_orders(spark, d).select("key"), 4)
    sets = {m: workload.key_sets(levels, m) for m in ("existing", "missing", "mixed")}
    tagged = sets["mixed"].withColumn("m", F.lit(0)).union(sets["existing"].withColumn("m", F.lit(1))).union(sets["missing"].withColumn("m", F.lit(2)))
    per_key = tagged.groupBy("key").agg(*(F.sum(F.when(F.col("m") == i, 1).otherwise(0)).alias(f"m{i}") for i in range(3)))
    records = workload.run_records(levels, 4).groupBy("key").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    drawn = F.array_sort(F.filter(F.array_distinct(F.array("level1", "level2")), lambda r: r < 4))
    wrong = levels.join(records, "key", "left").select("key", (F.coalesce("runs", F.array().cast("array<int>")) != drawn).alias("wrong"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return per_key.join(wrong, "key").agg(
        F.sum("m0").alias("n_mixed"), F.sum(F.col("m1") + F.col("m2")).alias("n_parts"), one((F.col("m1") > 0) & (F.col("m2") > 0)).alias("n_both"),
        F.avg("m1").between(0.68, 0.82).alias("share_ok"), one(F.col("wrong")).alias("n_wrong_run"),
    )


# Stores


def _mutations(spark, d) -> DataFrame:
    """The runs of lineitem with binary keys and values, as a store holds them."""
    rows = _runs(spark, d)
    return rows.select(keys.u64_key("key").alias("key"), F.col("value").cast("string").cast("binary").alias("value"), "tombstone", "run", "seq")


def _read_back(live: DataFrame) -> DataFrame:
    return live.select(keys.u64_value("key").cast("long").alias("key"), F.col("value").cast("string").cast("double").alias("value"))


def _store(spark, config=compaction.Config()) -> KvStore:
    """A new store of three partitions in the shared folder."""
    anchors = [b"", (1000).to_bytes(8, "big"), (2000).to_bytes(8, "big")]
    return KvStore.create(spark, f"{shared_dir(spark)}/kv-store-{uuid.uuid4().hex}", anchors, config)


def _flushed(spark, d, *force: str | None, config=compaction.Config()) -> KvStore:
    """The runs flushed in as many steps as there are kinds of compaction given."""
    store, rows = _store(spark, config), _mutations(spark, d)
    for i, kind in enumerate(force):
        last = i == len(force) - 1
        store.flush(rows.filter(F.col("run") >= i if last else F.col("run") == i), force=kind)
    return store


_LIVE_RUNS = f"WITH {RUNS}, {NEWEST} SELECT key, value::DOUBLE AS value FROM n WHERE NOT tombstone"


@query(_LIVE_RUNS)
def kv_store_minor(spark, d):
    return _read_back(_flushed(spark, d, "minor", "minor", "minor").live())


@query(_LIVE_RUNS)
def kv_store_partial(spark, d):
    return _read_back(_flushed(spark, d, "minor", "minor", "partial").live())


@query(_LIVE_RUNS)
def kv_store_major(spark, d):
    """Small runs, so that the output of the major compaction is split."""
    return _read_back(_flushed(spark, d, "minor", "major", config=compaction.Config(max_pages=20)).live())


@query(_LIVE_RUNS)
def kv_store_planned(spark, d):
    """Kinds chosen by the cost model."""
    return _read_back(_flushed(spark, d, None, None, config=compaction.Config(max_pages=20)).live())


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders")
def kv_store_append(spark, d):
    """Orders in key order: what lies behind the last key is appended as partitions of its own."""
    store = KvStore.create(spark, f"{shared_dir(spark)}/kv-store-{uuid.uuid4().hex}", config=compaction.Config(max_pages=4))
    rows = writes.put(_orders(spark, d).select(keys.u64_key("key").alias("key"), F.col("value").cast("string").cast("binary").alias("value"), F.col("key").alias("seq")), 0)
    edge = F.lit((100).to_bytes(8, "big")), F.lit((200).to_bytes(8, "big"))
    store.flush(rows.filter(F.col("key") < edge[0]), force="minor")
    store.flush(rows.filter((F.col("key") >= edge[0]) & (F.col("key") < edge[1])), force="minor")
    store.flush(rows.filter(F.col("key") >= edge[1]))
    return _read_back(store.live())


@query(_LIVE_RUNS)
def kv_store_split(spark, d):
    store = _flushed(spark, d, "minor", "minor")
    store.split(500)
    return _read_back(store.live())


@query(f"WITH {RUNS}, {NEWEST} SELECT key, value::DOUBLE AS value FROM n WHERE NOT tombstone AND key >= 900 AND key < 2100")
def kv_store_range(spark, d):
    """A key range of a store, from the partitions that it touches, under a memory table that deletes nothing."""
    low, high = ((n).to_bytes(8, "big") for n in (900, 2100))
    return _read_back(views.live(_flushed(spark, d, "minor", "partial").rows(start=low, end=high)))


@query(f"WITH {RUNS}, {NEWEST} SELECT key, value::DOUBLE AS value FROM n WHERE NOT tombstone")
def kv_log_recovery(spark, d):
    """The runs as epochs of a log, checked and replayed."""
    log, rows = MutationLog(spark, f"{shared_dir(spark)}/kv-log-{uuid.uuid4().hex}"), _mutations(spark, d)
    log.append(rows.filter("run = 0"), 0)
    for i in (1, 2):
        log.append(rows.filter("run = 1" if i == 1 else "run >= 2").withColumn("seq", F.col("run").cast("long")), i)
    return _read_back(log.recover().filter("not tombstone"))


@query(
    "WITH o AS (SELECT o_orderkey AS key, o_totalprice AS value FROM orders) SELECT key, "
    "CASE WHEN key % 6 = 0 THEN NULL WHEN key % 3 = 0 THEN 1.0 ELSE value END AS value FROM o"
)
def kv_ordered_map(spark, d):
    """A map by name: puts, overwrites of every third key, deletes of every sixth; null where a key is gone."""
    rows = _orders(spark, d).select("key", "value")
    thirds = rows.filter("key % 3 = 0").select("key")
    new = writes.put(rows, 0, F.lit(0).cast("long")).unionByName(writes.put(thirds.withColumn("value", F.lit(1.0)), 1, F.lit(1).cast("long")))
    gone = writes.delete(thirds.filter("key % 6 = 0"), 2, F.lit(2).cast("long"), "double")
    return reads.batch_get(rows.select("key"), views.live(new.unionByName(gone)).select("key", "value"))


# Reports


def _results(spark, d) -> DataFrame:
    """Suppliers as rows of results: a system and a memory limit for each, of which the first counts."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    one = s.groupBy((F.col("nation") % 4).alias("a"), (F.col("nation") % 3).alias("b")).agg(F.min("id").alias("id"))
    return one.select(
        F.concat(F.lit("s"), "a").alias("sysname"), F.concat(F.lit("m"), "b").alias("mem"), F.concat(F.lit("w"), "b").alias("workload"), (F.col("id") * 1000.0).alias("ops"),
        (F.col("id") * 2).alias("bio_read_bytes"), (F.col("id") * 3).alias("bio_write_bytes"), (F.col("id") + 1).alias("num_ops"), (F.col("id") * 1e9).alias("nsec"),
    )


_RESULTS = "r AS (SELECT 's' || a AS sysname, 'm' || b AS mem, 'w' || b AS workload, min(s_suppkey) AS id FROM (SELECT *, s_nationkey % 4 AS a, s_nationkey % 3 AS b FROM supplier) GROUP BY a, b)"


@query(f"WITH {_RESULTS} SELECT sysname, " + ", ".join(f"max(CASE WHEN mem = 'm{i}' THEN id * 1000.0 / 1000 END)::DOUBLE AS m{i}" for i in range(3)) + " FROM r GROUP BY sysname")
def kv_report_throughput(spark, d):
    return reports.throughput(_results(spark, d), ["m0", "m1", "m2"])


@query(f"WITH {_RESULTS} SELECT sysname, " + ", ".join(f"max(CASE WHEN mem = 'm{i}' THEN (id * 5)::DOUBLE / 1e12 END) AS m{i}" for i in range(3)) + " FROM r GROUP BY sysname")
def kv_report_load_io(spark, d):
    return reports.load_io(_results(spark, d), ["m0", "m1", "m2"])


@query(f"WITH {_RESULTS} SELECT sysname, " + ", ".join(f"max(CASE WHEN mem = 'm{i}' THEN (id * 2)::DOUBLE / (id + 1) / 1024 END) AS m{i}" for i in range(3)) + " FROM r GROUP BY sysname")
def kv_report_read_io(spark, d):
    return reports.read_io(_results(spark, d), ["m0", "m1", "m2"])


@query(f"WITH {_RESULTS} SELECT workload, " + ", ".join(f"max(CASE WHEN sysname = 's{i}' THEN id * 1000.0 / 1000 END)::DOUBLE AS s{i}" for i in range(4)) + " FROM r GROUP BY workload")
def kv_report_ycsb(spark, d):
    return reports.ycsb_throughput(_results(spark, d), ["s0", "s1", "s2", "s3"])


@query("SELECT event_type AS rw, count(*) AS n_io, sum(event_id)::BIGINT AS total_bytes FROM events GROUP BY 1")
def kv_block_io(spark, d):
    return reports.block_io(_events(spark, d).select(F.col("event_type").alias("rw"), F.col("event_id").alias("bytes")))


@query("SELECT user_id AS device, (arg_max(event_id, event_id) - arg_min(event_id, event_id))::BIGINT AS counter FROM events GROUP BY 1")
def kv_counter_deltas(spark, d):
    return reports.counter_deltas(_events(spark, d).select(F.col("user_id").alias("device"), F.col("event_id").alias("at"), F.col("event_id").alias("counter")), ["counter"])


# Workloads and traces

_DRAW = "(o_orderkey * 40503 + 12345) % 65536"


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS mix, op, count(*) AS n FROM (SELECT CASE WHEN {_DRAW} < {m.get * 65536 // 100} THEN 'get' WHEN {_DRAW} < {(m.get + m.scan) * 65536 // 100} THEN 'scan' WHEN {_DRAW} < {(m.get + m.scan + m.set) * 65536 // 100} THEN 'set' ELSE 'update' END AS op FROM orders) GROUP BY op"
        for n, m in workload.MIXES.items()
    )
)
def kv_ycsb_mix(spark, d):
    draw = (F.col("key") * 40503 + 12345) % 65536
    cells = [F.struct(F.lit(n).alias("mix"), workload.chosen_op(draw, m).alias("op")) for n, m in workload.MIXES.items()]
    return _orders(spark, d).select(F.explode(F.array(*cells)).alias("c")).groupBy("c.mix", "c.op").agg(F.count("*").alias("n"))


@query("SELECT event_type AS op, count(*) AS attempted, count(*) FILTER (value > 50)::BIGINT AS succeeded FROM events GROUP BY 1")
def kv_op_counts(spark, d):
    return workload.op_counts(_events(spark, d).select(F.col("event_type").alias("op"), (F.col("value") > 50).alias("ok")))


@query(
    "WITH ops AS (SELECT c_custkey AS op_id, ['get', 'probe', 'seeknext', 'seekskip', 'set', 'del'][c_custkey % 6 + 1] AS op, c_custkey * 11 AS key, c_custkey % 4 + 1 AS n FROM customer), "
    "k AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders), t AS (SELECT count(*) AS total FROM orders), "
    "s AS (SELECT ops.*, coalesce(j.rank, total + 1) AS r, total, e.key IS NOT NULL AS there FROM ops ASOF LEFT JOIN k j ON ops.key <= j.key CROSS JOIN t LEFT JOIN k e ON e.key = ops.key) "
    "SELECT op, count(*) AS attempted, count(*) FILTER (CASE WHEN op IN ('get', 'probe') THEN there WHEN op = 'seeknext' THEN r <= total WHEN op = 'seekskip' THEN r + n <= total ELSE true END)::BIGINT AS succeeded FROM s GROUP BY op"
)
def kv_executed_ops(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("op_id"))
    op = F.element_at(F.array(*map(F.lit, ("get", "probe", "seeknext", "seekskip", "set", "del"))), (F.col("op_id") % 6 + 1).cast("int"))
    ops = c.select("op_id", op.alias("op"), (F.col("op_id") * 11).alias("key"), (F.col("op_id") % 4 + 1).alias("n"))
    return workload.op_counts(workload.execute(ops, _orders(spark, d)))


@query(
    "WITH c AS (SELECT c_custkey AS id FROM customer), k AS (SELECT o_orderkey AS key FROM orders), gone AS (SELECT id * 4 AS key FROM c), made AS (SELECT id * 11 AS key FROM c), "
    "k1 AS (SELECT key FROM k WHERE key NOT IN (SELECT key FROM gone) UNION SELECT key FROM made WHERE key NOT IN (SELECT key FROM gone)), k2 AS (SELECT key FROM k1 UNION SELECT id * 8 FROM c) "
    "SELECT 0 AS pass, 'del' AS op, count(*) AS attempted, count(*) AS succeeded FROM c UNION ALL SELECT 0, 'set', count(*), count(*) FROM c WHERE id * 11 NOT IN (SELECT key FROM gone) "
    "UNION ALL SELECT 1, 'get', count(*), count(*) FILTER (id * 8 IN (SELECT key FROM k1)) FROM c UNION ALL SELECT 1, 'set', count(*), count(*) FROM c "
    "UNION ALL SELECT 2, 'probe', count(*), count(*) FILTER (id IN (SELECT key FROM k2)) FROM c"
)
def kv_passes(spark, d):
    """Three passes: deletes and sets; updates by get and set; probes. Each sees what those before it left."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("op_id"))
    ops = lambda op, key: c.select("op_id", F.lit(op).alias("op"), key.alias("key"), F.lit(1).cast("long").alias("n"))
    id_ = F.col("op_id")
    gone = ops("del", id_ * 4)
    first = gone.union(ops("set", id_ * 11).join(gone.select("key"), "key", "left_anti").select("op_id", "op", "key", "n"))
    view = _orders(spark, d).select("key", F.col("value").cast("string").cast("binary").alias("value"))
    return workload.run_passes(view, [first, ops("update", id_ * 8), ops("probe", id_)], merge=False)[0]


_TRACE = "t AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, user_id AS page FROM events), p AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY page ORDER BY i), 0) AS prev FROM t)"
_CAPACITIES = [1, 2, 4, 8, 16, 32, 64, 100, 128]


@query(
    f"WITH {_TRACE}, d AS (SELECT a.i, count(b.i) AS dist FROM p a LEFT JOIN p b ON b.i > a.prev AND b.i < a.i AND b.prev <= a.prev WHERE a.prev > 0 GROUP BY a.i), c AS (SELECT unnest({_CAPACITIES})::BIGINT AS cap) "
    "SELECT cap, ((SELECT count(*) FROM t) - (SELECT count(*) FROM d WHERE dist < cap))::BIGINT AS miss_count, (SELECT count(*) FROM d WHERE dist < cap)::BIGINT AS hit_count, (SELECT count(*) FROM t)::BIGINT AS tot_access FROM c"
)
def kv_lru_hits(spark, d):
    trace = _events(spark, d).select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").alias("page"))
    return lru.sweep(lru.reuse_distances(trace), _CAPACITIES)


@query(
    "WITH v AS (SELECT event_type AS series, event_id, value, row_number() OVER w AS n, avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS a, min(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS lo, "
    "max(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS hi, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) "
    "SELECT series, event_id, lo AS recent_min, hi AS recent_max, coalesce(abs(v1 - value) < value * 0.004 AND abs(v2 - value) < value * 0.004, false) OR (n >= 7 AND hi - lo < a * 0.05) OR n >= 14 AS converged FROM v"
)
def kv_convergence(spark, d):
    rows = _events(spark, d).select(F.col("event_type").alias("series"), "event_id", "value")
    return statistics.converged(rows, "series", "event_id", "value").select("series", "event_id", "recent_min", "recent_max", "converged")
