"""Maps by name: what each kind of map shows of a frame of mutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import reads, views, writes


class OrderedMap:
    """One ordered map over a frame: a run, a stack of runs, or a view of it."""

    def __init__(self, rows: DataFrame, see: Callable[[DataFrame], DataFrame] = views.live):
        self.rows, self.see = rows, see

    @property
    def view(self) -> DataFrame:
        return self.see(self.rows)

    def get(self, key) -> DataFrame:
        return reads.get(self.see(reads.get(self.rows, key)), key)

    def probe(self, key) -> bool:
        return not self.get(key).limit(1).isEmpty()

    def seek(self, key, n: int = 1, skip: int = 0) -> DataFrame:
        return reads.seek(self.view, key, n, skip)

    def seek_at_most(self, key, n: int = 1) -> DataFrame:
        return reads.seek_at_most(self.view, key, n)

    def scan(self, start=None, end=None) -> DataFrame:
        return reads.scan(self.view, start, end)

    def write(self, mutations: DataFrame) -> "OrderedMap":
        return OrderedMap(self.rows.unionByName(mutations), self.see)

    def delete_range(self, start=None, end=None) -> tuple["OrderedMap", int]:
        kept, gone = writes.delete_range(self.view, start, end)
        return OrderedMap(kept, self.see), gone.count()

    def clean(self) -> "OrderedMap":
        return OrderedMap(self.rows.limit(0), self.see)


def _same(rows: DataFrame) -> DataFrame:
    return rows


#: A store or memory table; a stack of runs or a partitioned version, live, newest or flagged; plain runs.
LIVE = ("store", "memory", "stack_live", "version_live", "index_live")
NEWEST = ("stack_newest", "version_newest", "index_newest")
VERSIONS = ("run", "stack")
FLAGGED = ("stack_versions",)

MAPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    **{n: views.live for n in LIVE},
    **{n: views.newest for n in NEWEST},
    **{n: _same for n in VERSIONS},
    **{n: views.all_versions for n in FLAGGED},
}


def register(name: str, see: Callable[[DataFrame], DataFrame]) -> None:
    MAPS[name] = see


def open_map(name: str, rows: DataFrame) -> OrderedMap:
    if name not in MAPS:
        raise ValueError(f"unknown map {name!r}; known: {', '.join(sorted(MAPS))}")
    return OrderedMap(rows, MAPS[name])
