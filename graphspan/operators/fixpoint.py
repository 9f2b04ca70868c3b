"""Best values by key, improved along edges until none improves.

The values reached so far are a bucketed table and the changes written since. A step joins the last
changes, the frontier, with the edges where those lie, combines the messages, compares them with
what is known of their receivers and writes the improvements alone. So a step costs a read of the
edges and a write of what changed, and a graph of many thousand steps is not rewritten in each of
them.

A frontier of bounded size is broadcast, and every node looks for its neighbours in it: as edges lie
in buckets of either end, what a node hears is combined where its edges lie, and nothing moves. What
a larger one sends is dealt by receiver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from graphspan.operators.adjacency import along
from graphspan.session import bucketed, discard, materialise, materialise_with

_MOST = 6  # tables of changes that a step looks into
_TOLD = 32 << 20  # bytes of a frontier that every task is told


def _width(shape: T.DataType) -> int:
    """Bytes of a row's numbers."""
    return sum(_width(f.dataType) for f in shape) if isinstance(shape, T.StructType) else 8


class Best:
    """value by keys (`id`, and others that travel with the message), or several values, each on its own."""

    def __init__(
        self, start: DataFrame, keys: list[str], combine: Callable[[Column], Column] = F.min, mail: Callable[[Column], Column] | None = None, values: tuple[str, ...] = ("value",),
    ):
        """start: keys and `values`, one row a key. combine (F.min or F.max) picks among values of a
        key, mail among messages to it (by default the same)."""
        self.keys, self.combine, self.mail, self.values = keys, combine, mail or combine, values
        self.base, seen = bucketed(start.select(*keys, *values), keys, "best", n=F.count("*"))
        self.told = _TOLD // _width(self.base.schema)  # rows of a frontier that is broadcast
        self.rows, self.changes, self.changed = seen["n"], [], 0
        self.pinned: list[DataFrame] = []  # tables that the caller still reads, and discards itself

    @staticmethod
    def holds(table: DataFrame, among: list[DataFrame]) -> bool:
        return any(x is table for x in among)

    def unpin(self, table: DataFrame) -> None:
        """The caller is done with a table it had pinned."""
        self.pinned = [x for x in self.pinned if x is not table]
        if not self.holds(table, [self.base, *self.changes]):
            discard(table)

    def _pick(self, a: str, b: str) -> Column:
        return (F.least if self.combine is F.min else F.greatest)(a, b)

    def _since(self) -> DataFrame | None:
        """The best of the changes by key."""
        if not self.changes:
            return None
        rows = self.changes[0]
        for more in self.changes[1:]:
            rows = rows.union(more)
        return rows.groupBy(*self.keys).agg(*[self.combine(v).alias(f"__new_{v}") for v in self.values])

    def known(self) -> DataFrame:
        """Keys and values, of all that was reached."""
        since = self._since()
        if since is None:
            return self.base
        both = self.base.join(since, self.keys, "full_outer")
        return both.select(*self.keys, *[self._pick(v, f"__new_{v}").alias(v) for v in self.values])

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows with `known`, the value of their keys or null (of several values, `known_` and their names)."""
        names = {v: "known" if v == "value" else f"known_{v}" for v in self.values}
        out = rows.join(self.base.withColumnsRenamed({v: f"__base_{v}" for v in self.values}), self.keys, "left")
        since = self._since()
        if since is None:
            return out.withColumnsRenamed({f"__base_{v}": name for v, name in names.items()})
        out = out.join(since, self.keys, "left").withColumns({name: self._pick(f"__base_{v}", f"__new_{v}") for v, name in names.items()})
        return out.drop(*[f"__{x}_{v}" for v in self.values for x in ("base", "new")])

    def add(self, rows: DataFrame, count: int) -> None:
        """Changes that were written (materialise); count is their number."""
        if not count:
            discard(rows)
            return
        self.changes.append(rows)
        self.changed += count
        if len(self.changes) > _MOST:
            self._settle()

    def _settle(self) -> None:
        """All but the last two changes, from which steps may still start, become one table or part of the base."""
        last, old = self.changes[-2:], self.changes[:-2]
        self.changes = old
        if 4 * self.changed > self.rows:
            new, seen = bucketed(self.known(), self.keys, "best", n=F.count("*"))
            old = [*old, self.base]
            self.base, self.rows, merged, self.changed = new, seen["n"], [], 0
        else:
            merged = [materialise(self._since().withColumnsRenamed({f"__new_{v}": v for v in self.values}), "changes")]
        for x in old:
            if not self.holds(x, self.pinned):
                discard(x)
        self.changes = [*merged, *last]

    def _heard(self, frontier: DataFrame, adj: DataFrame, most: int | None, *what: Column | str) -> DataFrame:
        """The receiver's `id`, the other keys and what, for every edge that a frontier row sends along."""
        rest = [k for k in self.keys if k != "id"]
        if most is not None and most <= self.told:  # an edge's receiver has it too, as its own
            return adj.join(F.broadcast(frontier), F.col("dst") == F.col("id")).select(F.col("src").alias("id"), *rest, *what)
        return along(frontier, adj, hashed=most is not None).select(F.col("dst").alias("id"), *rest, *what)

    def step(
        self, frontier: DataFrame, adj: DataFrame, message: Column, accept: Column | None = None, value: Column | None = None, most: int | None = None, **measures: Column,
    ) -> tuple[DataFrame, dict]:
        """One superstep: what improved, and measures of it (n: how many, new: how many had no value yet).

        adj has every edge from both ends; most is a number that the frontier's rows don't exceed.
        message sees a frontier row (`value`) and its edge's `w`; null is not sent. accept sees `msg`
        and `known` (null if the receiver has no value); by default a better value is taken. value is
        what the receiver then has, by default the message.
        """
        mail = self._heard(frontier, adj, most, message.alias("msg"))
        mail = mail.filter("msg is not null").groupBy(*self.keys).agg(self.mail("msg").alias("msg"))
        better = F.col("msg") < F.col("known") if self.combine is F.min else F.col("msg") > F.col("known")
        take = accept if accept is not None else F.col("known").isNull() | better
        new = self.lookup(mail).filter(take).withColumn("value", F.col("msg") if value is None else value)
        measures = {"n": F.count("*"), "new": F.count(F.when(F.col("known").isNull(), 1)), **measures}
        fresh, seen = materialise_with(new, "changes", [*self.keys, "value"], **measures)
        self.add(fresh, seen["n"])
        return fresh, seen

    def step_each(self, frontier: DataFrame, adj: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
        """A superstep in which every value goes to all neighbours as it is and is combined by itself:
        the rows in which any value improved, and their number."""
        mail = self._heard(frontier, adj, most, *self.values).groupBy(*self.keys).agg(*[self.mail(v).alias(f"msg_{v}") for v in self.values])
        best = {v: self._pick(f"msg_{v}", f"known_{v}") for v in self.values}
        better = reduce(Column.__or__, [~best[v].eqNullSafe(F.col(f"known_{v}")) for v in self.values])
        new = self.lookup(mail).filter(better).select(*self.keys, *[best[v].alias(v) for v in self.values])
        fresh, seen = materialise_with(new, "changes", n=F.count("*"))
        self.add(fresh, seen["n"])
        return fresh, seen["n"]

    def spread(self, adj: DataFrame, message: Column) -> int:
        """Step until nothing improves; the number of steps that improved something."""
        frontier, most, steps = self.base, self.rows, 0
        while True:
            frontier, seen = self.step(frontier, adj, message, most=most)
            if not seen["n"]:
                return steps
            most, steps = seen["n"], steps + 1
