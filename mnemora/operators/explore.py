"""Exploration of linked tables: follow, filter, group, sort and annotate, each step one more piece of a single plan.

A ``Graph`` holds tables, their keys and which columns refer to which table. A ``Walk`` starts at a table; a property of
another table is reached by a dotted path, ``author.team.name``, which joins each table on the way once, on its key. Nothing
runs before the rows are asked for, so Catalyst pushes filters and columns down to the scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``tables`` by name, the key column of each, and ``links``: (table, column) to the table whose key the column holds."""

    tables: dict[str, DataFrame]
    keys: dict[str, str]
    links: dict[tuple[str, str], str] = field(default_factory=dict)

    def start(self, table: str) -> Walk:
        return Walk(self, table, self.tables[table])


#: Annotations of groups by name.
ANNOTATIONS: dict[str, Callable[[Column], Column]] = {
    "count": F.count, "total": F.sum, "average": F.avg, "min": F.min, "max": F.max, "distinct": F.count_distinct,
}


@dataclass(frozen=True)
class Walk:
    graph: Graph
    table: str | None
    rows: DataFrame
    joined: tuple[str, ...] = ()

    def _reach(self, path: str) -> tuple[Walk, Column]:
        """The walk with the tables that ``path`` goes through, and the column at its end."""
        *hops, last = path.split(".")
        walk, table, before = self, self.table, ""
        for hop in hops:
            target = self.graph.links.get((table, hop))
            if target is None:
                raise ValueError(f"{table}.{hop} links to no table")
            at = f"{before}{hop}."
            if at not in walk.joined:
                other = self.graph.tables[target]
                named = other.select(*[F.col(c).alias(f"{at}{c}") for c in other.columns])
                held, key = walk.rows[f"`{before}{hop}`"], named[f"`{at}{self.graph.keys[target]}`"]
                walk = replace(walk, rows=walk.rows.join(named, held == key, "left"), joined=(*walk.joined, at))
            table, before = target, at
        return walk, walk.rows[f"`{before}{last}`"]

    def where(self, path: str, test: Callable[[Column], Column]) -> Walk:
        """Rows whose property passes ``test``; where the path goes through a link, rows without a partner fail as nulls do."""
        walk, at = self._reach(path)
        return replace(walk, rows=walk.rows.where(test(at)))

    def follow(self, column: str) -> Walk:
        """The rows that the column refers to, each once."""
        walk, held = self._reach(column)
        *hops, last = column.split(".")
        table = self.table
        for hop in hops:
            table = self.graph.links[table, hop]
        target = self.graph.links.get((table, last))
        if target is None:
            raise ValueError(f"{table}.{last} links to no table")
        key = self.graph.keys[target]
        return Walk(self.graph, target, self.graph.tables[target].join(walk.rows.select(held.alias(key)), key, "left_semi"))

    def back(self, table: str, column: str) -> Walk:
        """The rows of ``table`` whose column refers to the rows at hand."""
        if self.graph.links.get((table, column)) != self.table:
            raise ValueError(f"{table}.{column} doesn't link to {self.table}")
        keys = self.rows.select(F.col(f"`{self.graph.keys[self.table]}`").alias(column))
        return Walk(self.graph, table, self.graph.tables[table].join(keys, column, "left_semi"))

    def group(self, *paths: str, **annotations: tuple[str, str] | str) -> Walk:
        """A row for each group, by the paths (named by them, points as underscores), with ``name=(annotation, path)`` or ``name="count"``."""
        walk: Walk = self
        for path in [*paths, *[a[1] for a in annotations.values() if isinstance(a, tuple)]]:
            walk, _ = walk._reach(path)
        by = [walk._reach(p)[1].alias(p.replace(".", "_")) for p in paths]
        found = [(F.count(F.lit(1)) if isinstance(a, str) else ANNOTATIONS[a[0]](walk._reach(a[1])[1])).alias(name) for name, a in annotations.items()]
        return Walk(self.graph, None, walk.rows.groupBy(*by).agg(*found))

    def sort(self, *columns: str, limit: int | None = None) -> Walk:
        """By columns, ``-`` before a name for descending; with ``limit`` the first rows only."""
        order = [F.desc(f"`{c[1:]}`") if c.startswith("-") else F.asc(f"`{c}`") for c in columns]
        rows = self.rows.orderBy(*order)
        return replace(self, rows=rows if limit is None else rows.limit(limit))

    def pick(self, **paths: str) -> DataFrame:
        """``name=path`` as columns."""
        walk: Walk = self
        for path in paths.values():
            walk, _ = walk._reach(path)
        return walk.rows.select(*[walk._reach(path)[1].alias(name) for name, path in paths.items()])
