"""A store on shared files: immutable runs as Parquet and numbered versions as manifests.

Layout under the root: runs/<id>/p=<part>/piece=<n>/ (Parquet, sorted by key, a key range each),
versions/v<n> (the manifest, Parquet, one row per partition, run and piece, with the piece's first
and last key) and pins/ (versions that readers hold). The head is the newest version whose write was
committed, so readers see the old or the new one, whenever a writer dies. Pieces that a compaction
keeps are referred to by path and neither copied nor read. There is one writer.

What a flush reads is the new mutations and the pieces that its plan rewrites; plans are made from
manifests. Merged output of a major or append compaction is cut into partitions of at most
major_switch runs' bytes.

The memory table is a frame of mutations with run -1 above every stored run, held by the caller's
session until flush().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, reads, views
from ..operators.compaction import Config
from ..operators.writes import replay
from ..schema import MANIFEST, MAX_RUNS, MUTATIONS, checked
from ..session import materialise


_COMMITTED = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def _entry(part: int, anchor: bytes, run: int | None = None, piece: dict | None = None) -> tuple:
    """A manifest row without its version; no piece: an empty partition."""
    if piece is None:
        return part, bytearray(anchor), None, None, 0, 0, None, None
    return part, bytearray(anchor), run, piece["path"], piece["n_kv"], piece["bytes"], bytearray(piece["first_key"]), bytearray(piece["last_key"])


def _by_part(entries: list) -> dict[int, tuple[bytes, list]]:
    """Anchor and pieces of every partition."""
    out: dict[int, tuple[bytes, list]] = {}
    for r in entries:
        out.setdefault(r["part_id"], (bytes(r["anchor"]), []))[1].extend([r] if r["path"] is not None else [])
    return out


class KvStore:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config()):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Files

    def _listed(self, name: str) -> list[str]:
        path = self._fs_path(f"{self.root}/{name}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def exists(self) -> bool:
        return bool(self.versions())

    def head(self) -> int:
        return self.versions()[-1]

    @classmethod
    def create(cls, spark: SparkSession, root: str, anchors: list[bytes] = (b"",), config: Config = Config()) -> "KvStore":
        """Version 0: one empty partition for each anchor; the first anchor is the empty key."""
        store = cls(spark, root, config)
        if sorted(set(anchors)) != list(anchors) or not anchors or anchors[0] != b"":
            raise ValueError("anchors must ascend from the empty key")
        if store.exists():
            raise ValueError(f"there is a store at {root}")
        store._publish([_entry(i, a) for i, a in enumerate(anchors)])
        return store

    def _publish(self, entries: list[tuple]) -> None:
        """The next version; it becomes the head with the commit of its manifest. Numbers of failed writes aren't used again."""
        version = max((int(n[1:]) for n in self._listed("versions")), default=-1) + 1
        manifest = self.spark.createDataFrame([(version, *e) for e in entries], MANIFEST)
        manifest.coalesce(1).write.option(_COMMITTED, "true").mode("errorifexists").parquet(f"{self.root}/versions/v{version}")

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        found = (int(n[1:]) for n in self._listed("versions"))
        return sorted(v for v in found if self._fs.exists(self._fs_path(f"{self.root}/versions/v{v}/_SUCCESS")))

    def pin(self, version: int | None = None) -> "Pin":
        """Hold a version: until the pin is released, collect_garbage keeps what the version refers to."""
        return Pin(self, self.head() if version is None else version)

    def pinned(self) -> set[int]:
        return {int(n.split("-")[0]) for n in self._listed("pins")}

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/versions/v{self.head() if version is None else version}")

    # Reads. A snapshot is a version number: reads on it never change.

    def rows(self, version: int | None = None, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """All versions of all keys with part_id; a key range prunes partitions by their anchors."""
        entries = sorted(self.manifest(version).collect(), key=lambda r: bytes(r["anchor"]))
        order = sorted({bytes(r["anchor"]) for r in entries})
        upper = dict(zip(order, [*order[1:], None]))
        wanted = []
        for r in entries:
            high = upper[bytes(r["anchor"])]
            if r["path"] is None or end is not None and (bytes(r["anchor"]) >= end or bytes(r["first_key"]) >= end):
                continue
            if start is not None and (high is not None and high <= start or bytes(r["last_key"]) < start):
                continue
            wanted.append(r)
        out = self._read(wanted)
        if start is not None:
            out = out.filter(F.col("key") >= F.lit(start))
        if end is not None:
            out = out.filter(F.col("key") < F.lit(end))
        return out

    def _read(self, entries: list) -> DataFrame:
        """The rows of manifest entries in one scan; which part and run a piece belongs to is joined from the entries."""
        if not entries:
            return self.spark.createDataFrame([], MUTATIONS + ", part_id int")
        where = self.spark.createDataFrame([("/runs/" + r["path"].split("/runs/")[-1], r["part_id"], r["run"]) for r in entries], "place string, part_id int, run int")
        rows = self.spark.read.schema("key binary, value binary, tombstone boolean, seq bigint, place string").parquet(*[r["path"] for r in entries])
        return rows.join(F.broadcast(where), "place").select("key", "value", "tombstone", "run", "seq", "part_id")  # a row a file

    def newest(self, version: int | None = None) -> DataFrame:
        return views.newest(self.rows(version))

    def live(self, memory: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """Live rows of a version, under a memory table of mutations if one is given."""
        rows = self.rows(version).drop("part_id")
        if memory is not None:
            rows = rows.unionByName(memory.withColumn("run", F.lit(MAX_RUNS)))
        return views.live(rows)

    def get(self, key: bytes, memory: DataFrame | None = None, version: int | None = None) -> DataFrame:
        end = key + b"\0"
        rows = self.rows(version, key, end).drop("part_id")
        if memory is not None:
            rows = rows.unionByName(memory.filter(F.col("key") == F.lit(key)).withColumn("run", F.lit(MAX_RUNS)))
        return views.live(rows)

    def anchors(self, version: int | None = None) -> DataFrame:
        return self.manifest(version).select("part_id", "anchor").distinct()

    def statistics(self, version: int | None = None) -> DataFrame:
        """(part_id, run, n_kv, bytes) of every run."""
        pieces = self.manifest(version).filter("path is not null")
        return pieces.groupBy("part_id", "run").agg(F.sum("n_kv").alias("n_kv"), F.sum("bytes").alias("bytes"))

    # Writes

    def _plan(self, delta: DataFrame, budget: int, force: str | None) -> list:
        """One row per partition: kind and first rewritten run. Works on counts and sizes only."""
        config = self.config
        entries = self.manifest().collect()
        located = reads.locate(delta, self.anchors())
        fresh = {r["part_id"]: r for r in compaction.new_data(located, config=config).collect()}
        last_part = max(entries, key=lambda r: bytes(r["anchor"]))["part_id"]
        stats_rows, part_rows = [], []
        by_part = _by_part(entries)
        for part, (_, mine) in sorted(by_part.items()):
            sizes: dict[int, int] = {}
            for r in mine:
                sizes[r["run"]] = sizes.get(r["run"], 0) + r["n_kv"]
            new = fresh.get(part)
            newnr, newsz = (new["newnr"], new["newsz"]) if new else (0, 0)
            n_kv, total = sum(sizes.values()), sum(r["bytes"] for r in mine)
            last = max((bytearray(r["last_key"]) for r in mine), default=None)
            part_rows.append((part, len(sizes), n_kv, newnr, newsz, max(total, 1), part == last_part, last))
            if n_kv and newnr:
                stats_rows += [(part, i, sizes[run], n_kv, n_kv, total, newnr, newsz) for i, run in enumerate(sorted(sizes))]
                stats_rows.append((part, len(sizes), 0, n_kv, n_kv, total, newnr, newsz))
        spark = self.spark
        parts = spark.createDataFrame(part_rows, "part_id int, n_runs int, valid bigint, newnr bigint, newsz bigint, totsz bigint, is_last boolean, last_key binary")
        first = spark.createDataFrame([(p, bytearray(r["new_first"])) for p, r in fresh.items()], "part_id int, new_first binary")
        parts = parts.join(first, "part_id", "left").withColumn("overlap", F.coalesce(F.col("last_key") >= F.col("new_first"), F.lit(False)))
        stats = spark.createDataFrame(stats_rows, "part_id int, run int, n_kv bigint, valid bigint, totkv bigint, totsz bigint, newnr bigint, newsz bigint")
        planned = compaction.plan(parts, compaction.best_runs(compaction.scores(stats, config), config), config)
        if force is None:
            planned = compaction.reject_small(planned, budget, config)
        rows = [r.asDict() for r in planned.collect()]
        for r in rows:
            runs = r["n_runs"] = len({e["run"] for e in by_part[r["part_id"]][1]})
            if force and (r["newsz"] or force == "major"):
                r["kind"] = force if runs or force != "partial" else "minor"
                r["bestrun"] = {"major": 0, "partial": max(runs - 1, 0), "minor": runs}.get(force, r["bestrun"])
            if r["kind"] == "minor" and runs >= MAX_RUNS - 1:
                r["kind"], r["bestrun"] = "major", 0
        return rows

    def flush(self, delta: DataFrame, budget: int | None = None, force: str | None = None) -> DataFrame:
        """Compact the store with new mutations; publishes a version and returns what was rejected.

        budget: bytes that may be rejected (default none). force: major, partial or minor for all partitions
        with new data. All partitions of the new version are written by one job.
        """
        delta = materialise(checked(views.newest(delta)))
        plan = {r["part_id"]: r for r in self._plan(delta, budget or 0, force)}
        old = self.manifest().collect()
        # Runs of a partition are numbered from 0, so the first to rewrite is also how many stay.
        again = [r for r in old if r["path"] is not None and plan[r["part_id"]]["kind"] in ("major", "partial") and r["run"] >= plan[r["part_id"]]["bestrun"]]
        table = self.spark.createDataFrame([(p, r["kind"]) for p, r in plan.items()], "part_id int, kind string")
        fresh = reads.locate(delta, self.anchors()).drop("anchor").join(F.broadcast(table), "part_id")  # a row a partition
        rejected = fresh.filter("kind = 'reject'").drop("kind", "part_id")
        stored = self._read(again).join(F.broadcast(table), "part_id")
        merged = views.newest(stored.unionByName(fresh.filter("kind <> 'reject'").withColumn("run", F.lit(MAX_RUNS))))
        merged = merged.filter(~F.col("tombstone") | ~F.col("kind").isin("major", "append"))
        size = sum(r["bytes"] for r in again) + sum(r["newsz"] for r in plan.values() if r["kind"] != "reject")
        pieces = self._write(merged.withColumnRenamed("part_id", "p"), size)
        kept, number, by_part = [], max(plan, default=-1) + 1, _by_part(old)
        for part, p in plan.items():
            anchor, runs = by_part[part]
            keep = [tuple(r[c] for c in r.__fields__[1:]) for r in runs if p["kind"] in ("reject", "append") or r["run"] < p["bestrun"]]
            new = pieces.get(part, [])
            if p["kind"] in ("partial", "minor"):
                run = max((r[2] for r in keep), default=-1) + 1
                kept += keep + [_entry(part, anchor, run, x) for x in new] or [_entry(part, anchor)]
                continue
            groups = self._cut(new)
            if p["kind"] == "append" or not groups:
                kept += keep or [_entry(part, anchor)]
            for k, group in enumerate(groups):
                stays = k == 0 and p["kind"] == "major"
                start = anchor if stays else bytes(group[0]["first_key"])
                kept += [_entry(part if stays else number, start, 0, x) for x in group]
                number += not stays
        self._publish(kept)
        return rejected

    def _write(self, rows: DataFrame, size: int) -> dict[int, list]:
        """Rows (p, key, ...) as pieces: p -> its pieces in key order, each with place, path, n_kv, bytes, first and last key.

        Dealt out by ranges of (p, key), about two to a run's bytes, so no task holds more and every piece is a key range.
        """
        base = f"/runs/{uuid.uuid4().hex}"
        n = max(1, -(-2 * size // self.config.run_bytes))
        out = rows.repartitionByRange(n, "p", "key").sortWithinPartitions("p", "key").withColumn("piece", F.spark_partition_id())
        place = F.concat(F.lit(base + "/p="), F.col("p"), F.lit("/piece="), F.col("piece"))
        out.select("key", "value", "tombstone", "seq", place.alias("place"), "p", "piece").write.partitionBy("p", "piece").parquet(self.root + base)
        paths = [f"{self.root}{base}/{x}/{y}" for x in self._listed(base) if x.startswith("p=") for y in self._listed(f"{base}/{x}")]
        if not paths:
            return {}
        read = self.spark.read.schema("key binary, value binary, place string").parquet(*paths)
        bytes_ = F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0)))
        found = read.groupBy("place").agg(F.count("*").alias("n_kv"), bytes_.alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key")).collect()
        by: dict[int, list] = {}
        for r in sorted(found, key=lambda r: bytes(r["first_key"])):
            by.setdefault(int(r["place"].split("/p=")[1].split("/")[0]), []).append(r.asDict() | {"path": self.root + r["place"]})
        return by

    def _cut(self, pieces: list) -> list[list]:
        """Pieces in key order as partitions of at most major_switch runs' bytes."""
        groups, size = [], 0
        for x in pieces:
            if not groups or size + x["bytes"] > self.config.major_switch * self.config.run_bytes:
                groups.append([])
                size = 0
            groups[-1].append(x)
            size += x["bytes"]
        return groups

    def split(self, part_rows: int) -> None:
        """Rewrite all partitions as live ranges of about part_rows keys, tombstones dropped."""
        rows = materialise(self.live())
        n = max(1, -(-rows.count() // part_rows))
        ranged = rows.repartitionByRange(n, "key").withColumn("p", F.spark_partition_id())
        size = sum(r["bytes"] for r in self.manifest().filter("path is not null").collect())
        groups = sorted(self._write(ranged, size).values(), key=lambda g: bytes(g[0]["first_key"]))
        out = [_entry(i, bytes(g[0]["first_key"]) if i else b"", 0, x) for i, g in enumerate(groups) for x in g]
        self._publish(out or [_entry(0, b"")])

    def collect_garbage(self, keep_versions: int = 2) -> list[str]:
        """Drop old versions that no reader holds, and run folders that no remaining version refers to."""
        versions, held = self.versions(), self.pinned()
        stay = [v for i, v in enumerate(versions) if i >= len(versions) - keep_versions or v in held]
        for v in set(versions) - set(stay):
            self._fs.delete(self._fs_path(f"{self.root}/versions/v{v}"), True)
        used = {r["path"].split("/runs/")[1].split("/")[0] for v in stay for r in self.manifest(v).filter("path is not null").select("path").collect()}
        gone = [n for n in self._listed("runs") if n not in used]
        for n in gone:
            self._fs.delete(self._fs_path(f"{self.root}/runs/{n}"), True)
        return gone


class Pin:
    """A reader's hold on a version; use it as a context, or release() it."""

    def __init__(self, store: KvStore, version: int):
        self.store, self.version = store, version
        self.path = store._fs_path(f"{store.root}/pins/{version}-{uuid.uuid4().hex}")
        store._fs.create(self.path).close()
        if version not in store.versions():
            self.release()
            raise ValueError(f"there is no version {version}")

    def release(self) -> None:
        self.store._fs.delete(self.path, False)

    def __enter__(self) -> "Pin":
        return self

    def __exit__(self, *_) -> None:
        self.release()


class MutationLog:
    """An append-only log of mutations in epochs; a batch is visible once its Parquet commit is.

    Every record carries the CRC-32 of its key; what is read back has checksum_ok, and recovery stops
    in each epoch before the first record whose key doesn't match.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, rows: DataFrame, epoch: int) -> None:
        rows.select("key", "value", "tombstone", "seq", F.crc32("key").alias("checksum")).write.mode("append").parquet(f"{self.root}/epoch={epoch}")

    def read(self) -> DataFrame:
        rows = self.spark.read.option("basePath", self.root).parquet(self.root).withColumn("epoch", F.col("epoch").cast("long"))
        return rows.withColumn("checksum_ok", F.crc32("key").eqNullSafe(F.col("checksum"))).drop("checksum")

    def recover(self) -> DataFrame:
        """The newest mutation of each key over all epochs, older epochs first."""
        return replay(self.read())
