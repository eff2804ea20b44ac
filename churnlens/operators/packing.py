"""Budget- and capacity-constrained greedy selection ("skip and continue").

Semantics (sequential definition): walk rows in the given order; skip a row
whose cost would overflow the budget and continue; stop once ``max_customers``
rows are taken (``None``/0 = no cap). Rows with a NULL or negative cost or a NULL
order key are never selected.

Distributed evaluation over a *block-summary index*. The rows of all scenarios and
orders are range-ordered once and written to the shared folder, one folder per range
partition, in blocks of ``BLOCK_ROWS`` rows. One pass gives count, cost, least cost and
first key of every (scenario table, partition): those rows reach the driver. A walk then
goes down the summaries:

* a partition or block whose whole cost fits into what is left (and whose rows fit
  under the cap) is taken unread;
* one whose least cost is above what is left is passed over unread;
* of any other partition the block summaries are read (that partition's folder alone),
  of any other block its rows (that folder, and of its files the row groups of that
  block), and the walk goes through the block's rows inside one task.

After the first row that does not fit, what is left is below the largest cost, and each
further block that is read takes at least one row, so a walk reads at most
``1 + ceil(max/min cost)`` blocks. All walks that wait for a block share one job.

No customer row reaches the driver but the keys at which the walk skipped rows. Between two
such keys exactly the rows within the budget left at the first are taken, so the result is a
*predicate* (one term per stretch) over the input table: the selected set, the ACT flag and
everything downstream stay lazy DataFrame expressions.

Money is summed in integer micro-units so partitioning cannot flip a decision.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import micro
from churnlens.functions.scratch import drop, folder

BLOCK_ROWS = 4096
Order = list[tuple[str, bool]]


@dataclass
class PackResult:
    keys: Order                # the order, the id last
    stretches: list[tuple[int, tuple | None, tuple | None]]   # (budget, after this key, before this key)
    cost_col: str
    spent: float               # budget used (exact micro-unit sum / 1e4)
    count: int                 # number of selected rows
    source: DataFrame
    eligible: Column | None = None

    def taken(self, **columns: Column) -> Column:
        """Holds on the selected rows among eligible ones, with other expressions for the
        named order columns."""
        at = {name: columns.get(name, F.col(name)) for name, _ in self.keys}
        cost = micro(self.cost_col)
        has_keys = reduce(Column.__and__, [c.isNotNull() for c in at.values()]) & (cost >= 0)
        found = F.lit(False)
        for budget, after, before in self.stretches:
            term = (cost <= F.lit(budget)) & has_keys
            if after is not None:
                term = term & _beyond(self.keys, at, after, False)
            if before is not None:
                term = term & _beyond(self.keys, at, before, True)
            found = found | term
        return F.coalesce(found, F.lit(False))

    @property
    def predicate(self) -> Column:
        """Holds on the selected rows of the input table."""
        return self.taken() if self.eligible is None else self.eligible & self.taken()

    @property
    def rounds(self) -> int:
        return len(self.stretches)

    @property
    def selected(self) -> DataFrame:
        return self.source.where(self.predicate)


def _beyond(keys: Order, at: dict[str, Column], bound: tuple, earlier: bool) -> Column:
    """Rows strictly after (or before) ``bound`` in the lexicographic order ``keys``
    (``(column, descending)``; the last key must be unique)."""
    cond, eq = F.lit(False), F.lit(True)
    for (name, desc), b in zip(keys, bound):
        cond = cond | (eq & (at[name] < F.lit(b) if desc != earlier else at[name] > F.lit(b)))
        eq = eq & (at[name] == F.lit(b))
    return cond


@dataclass
class _Unit:
    """Summary of a partition's or a block's rows of one scenario table."""

    part: int
    block: int | None          # None: a partition of several blocks
    rows: int
    cost: int
    least: int
    first: tuple


@dataclass
class _Walk:
    """Where one scenario's walk stands."""

    lane: int
    rem: int
    left: int | None
    todo: deque
    start: int = 0             # what was left where the present stretch began
    cut: tuple | None = None   # and the key after which it began
    took: bool = False
    count: int = 0
    stretches: list = field(default_factory=list)

    def close(self, end: tuple | None) -> None:
        if self.took:
            self.stretches.append((self.start, self.cut, end))
        self.start, self.cut, self.took = self.rem, end, False

    def advance(self) -> _Unit | None:
        """Goes on until a unit must be read; None at the end of the walk."""
        while self.todo and self.left != 0:
            unit = self.todo[0]
            if unit.cost <= self.rem and (self.left is None or unit.rows <= self.left):
                self.rem -= unit.cost
                self.count += unit.rows
                self.left = None if self.left is None else self.left - unit.rows
                self.took = True
            elif unit.least > self.rem:
                if self.took:
                    self.close(unit.first)
            else:
                return unit
            self.todo.popleft()
        self.close(self.todo[0].first if self.todo else None)
        self.todo.clear()
        return None


def greedy_pack(df: DataFrame, order: Order, budget: float,
                max_customers: int | None = None, cost_col: str = "retention_cost",
                id_col: str = "customer_id") -> PackResult:
    """Select rows of ``df`` (already filtered to eligible rows) in ``order``
    (list of ``(column, descending)``, ``id_col`` ascending is appended as the
    final tiebreak) under ``budget`` and ``max_customers``."""
    return greedy_pack_many({0: df}, order, {0: budget}, {0: max_customers}, cost_col, id_col)[0]


def greedy_pack_many(tables: dict, order: Order | dict, budgets: dict, caps: dict,
                     cost_col: str = "retention_cost", id_col: str = "customer_id") -> dict:
    """The same greedy for several scenarios, ``tables = {scenario: eligible rows}``, in the
    same jobs. ``order`` is one for all or ``{scenario: order}``. Scenarios with the same table
    object and order share its rows. Returns ``{scenario: PackResult}``."""
    orders = {s: [*(order[s] if isinstance(order, dict) else order), (id_col, False)] for s in tables}
    micros = {s: int(round(budgets[s] * C.MICRO)) for s in tables}
    lanes: dict[tuple, int] = {}
    lane_of = {s: lanes.setdefault((id(tables[s]), tuple(orders[s])), len(lanes)) for s in tables}
    picked = [next(s for s in tables if lane_of[s] == lane) for lane in lanes.values()]
    # a column per place and direction in the order, shared by all lanes
    names = [[f"{'d' if desc else 'a'}{k}" for k, (_, desc) in enumerate(orders[s])] for s in picked]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        tables[s].select(F.lit(lane).alias("lane"), micro(cost_col).alias("cost"),
                         *[F.col(k).alias(n) for (k, _), n in zip(orders[s], names[lane])]) for lane, s in enumerate(picked)])
    walks = _walk_all(rows, names, {s: (lane_of[s], micros[s], caps.get(s)) for s in tables})
    return {s: PackResult(orders[s], w.stretches, cost_col, (micros[s] - w.rem) / C.MICRO, w.count, tables[s])
            for s, w in walks.items()}


def greedy_pack_stacked(rows: DataFrame, order: Order, budgets: list[float], caps: list[int | None],
                        cost_col: str = "retention_cost", id_col: str = "customer_id") -> list[PackResult]:
    """The same for eligible rows of all scenarios in one table, ``lane`` being the place of
    a row's scenario in ``budgets`` and ``caps``."""
    order = [*order, (id_col, False)]
    micros = [int(round(b * C.MICRO)) for b in budgets]
    names = [f"{'d' if desc else 'a'}{k}" for k, (_, desc) in enumerate(order)]
    rows = rows.select("lane", micro(cost_col).alias("cost"), *[F.col(k).alias(n) for (k, _), n in zip(order, names)])
    walks = _walk_all(rows, [names] * len(budgets), {k: (k, m, cap) for k, (m, cap) in enumerate(zip(micros, caps))})
    return [PackResult(order, w.stretches, cost_col, (micros[k] - w.rem) / C.MICRO, w.count, rows.where(F.col("lane") == k))
            for k, w in walks.items()]


def _walk_all(rows: DataFrame, names: list[list[str]], wanted: dict) -> dict:
    """Walks ``{scenario: (lane, budget, cap)}`` over ``rows(lane, cost, order columns)``."""
    most = [max((m for lane_, m, _ in wanted.values() if lane_ == lane), default=0) for lane in range(len(names))]
    index = _Index(rows, names, most)
    walks = {s: _Walk(lane, budget, cap or None, deque(index.parts[lane]), budget) for s, (lane, budget, cap) in wanted.items()}
    while True:
        waits = {s: unit for s, w in walks.items() if (unit := w.advance()) is not None}
        if not waits:
            break
        wide = {s: u for s, u in waits.items() if u.block is None}
        if wide:
            found = index.blocks({(walks[s].lane, u.part) for s, u in wide.items()})
            for s, u in wide.items():
                walks[s].todo.popleft()
                walks[s].todo.extendleft(reversed(found[walks[s].lane, u.part]))
        else:
            index.walk([(walks[s], u) for s, u in waits.items()])
    index.close()
    return walks


class _Index:
    """The ordered rows of all lanes (scenario tables) in the shared folder."""

    def __init__(self, rows: DataFrame, names: list[list[str]], most: list[int]):
        self.spark = spark = rows.sparkSession
        self.names, self.keys = names, sorted({n for own in names for n in own}, key=lambda n: (int(n[1:]), n))
        has_keys = {tuple(own): reduce(Column.__and__, [F.col(n).isNotNull() for n in own]) for own in names}
        usable = reduce(Column.__or__, [F.col("lane").isin([k for k, own in enumerate(names) if tuple(own) == used]) & known
                                        for used, known in has_keys.items()])
        stacked = rows.where(usable & F.col("cost").between(0, F.element_at(F.lit(most), F.col("lane") + 1)))
        along = [F.col("lane"), *[F.col(n).desc() if n[0] == "d" else F.col(n) for n in self.keys]]
        self.path = folder(spark, "greedy")
        (stacked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *along).sortWithinPartitions(*along)
         .select("*", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"), F.spark_partition_id().alias("part"))
         .withColumn("block", F.expr(f"CAST(at DIV {BLOCK_ROWS} AS INT)"))
         .write.partitionBy("part").parquet(self.path))
        schema = stacked.select("lane", "cost", *self.keys).schema.add("at", "long").add("block", "integer").add("part", "integer")
        self.rows = spark.read.schema(schema).parquet(self.path)
        self.parts: dict[int, list[_Unit]] = {lane: [] for lane in range(len(names))}
        for r in self._summary("lane", "part").collect():
            self.parts[r["lane"]].append(self._unit(r, r["low"] if r["low"] == r["high"] else None))
        for units in self.parts.values():
            units.sort(key=lambda u: u.part)

    def _summary(self, *by: str, where: Column | None = None) -> DataFrame:
        rows = self.rows if where is None else self.rows.where(where)
        return rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("cost").alias("total"), F.min("cost").alias("least"),
            F.min_by(F.struct(*self.keys), "at").alias("first"), F.min("block").alias("low"), F.max("block").alias("high"))

    def _unit(self, r, block: int | None) -> _Unit:
        return _Unit(r["part"], block, r["rows"], r["total"], r["least"], self._key(r["lane"], r["first"]))

    def _key(self, lane: int, key) -> tuple:
        return tuple(key[n] for n in self.names[lane])

    def blocks(self, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], list[_Unit]]:
        """Block summaries of some (lane, partition)s; reads those partitions' folders alone."""
        some = F.col("part").isin(sorted({part for _, part in wanted})) & reduce(Column.__or__, [
            (F.col("lane") == lane) & (F.col("part") == part) for lane, part in wanted])
        found: dict = {w: [] for w in wanted}
        for r in self._summary("lane", "part", "block", where=some).collect():
            found[r["lane"], r["part"]].append(self._unit(r, r["block"]))
        return {w: sorted(units, key=lambda u: u.block) for w, units in found.items()}

    def walk(self, steps: list[tuple[_Walk, _Unit]]) -> None:
        """Takes each walk through the rows of its block, one task a walk."""
        some = F.col("part").isin(sorted({u.part for _, u in steps})) & F.col("block").isin(sorted({u.block for _, u in steps}))
        mine = F.filter(F.array(*[
            F.when((F.col("lane") == w.lane) & (F.col("part") == u.part) & (F.col("block") == u.block), k)
            for k, (w, u) in enumerate(steps)]), lambda k: k.isNotNull())
        key = F.struct(*self.keys)
        rows = self.rows.where(some).select(F.explode(mine).alias("walk"), "at", "cost", key.alias("key"))
        kind = rows.schema["key"].dataType.simpleString()

        def state(values) -> Column:
            return reduce(lambda acc, k: acc.when(F.col("walk") == k, values(*steps[k])), range(1, len(steps)),
                          F.when(F.col("walk") == 0, values(*steps[0])))

        began = state(lambda w, u: F.struct(
            F.lit(w.rem).cast("long").alias("rem"), F.lit(w.left).cast("long").alias("open"), F.lit(w.start).cast("long").alias("start"),
            F.lit(w.took).alias("took"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(kind).alias("cut"),
            F.array().cast(f"array<struct<start:bigint,cut:{kind},stop:{kind}>>").alias("stretches")))
        # a row above the stretch's budget is no candidate; one that fits is taken; any other ends the stretch
        ended = F.expr(f"""aggregate(array_sort(collect_list(struct(at, cost, key))), first(began), (s, r) -> CASE
            WHEN r.cost > s.start THEN s
            WHEN r.cost <= s.rem AND (s.open IS NULL OR s.open > 0) THEN named_struct(
                'rem', s.rem - r.cost, 'open', s.open - 1L, 'start', s.start, 'took', true, 'n', s.n + 1L, 'cut', s.cut, 'stretches', s.stretches)
            ELSE named_struct('rem', s.rem, 'open', s.open, 'start', CASE WHEN s.open = 0 THEN -1L ELSE s.rem END, 'took', false, 'n', s.n,
                'cut', r.key, 'stretches', CASE WHEN s.took THEN array_append(s.stretches, named_struct('start', s.start, 'cut', s.cut, 'stop', r.key))
                                           ELSE s.stretches END) END)""")
        for r in rows.withColumn("began", began).groupBy("walk").agg(ended.alias("s")).collect():
            w, s = steps[r["walk"]][0], r["s"]
            tuple_of = lambda k: w.cut if k is None else self._key(w.lane, k)
            w.stretches.extend((x["start"], tuple_of(x["cut"]), tuple_of(x["stop"])) for x in s["stretches"])
            w.rem, w.left, w.count, w.took = s["rem"], s["open"], w.count + s["n"], s["took"]
            w.start, w.cut = s["start"], tuple_of(s["cut"])
            w.todo.popleft()

    def close(self) -> None:
        drop(self.spark, self.path)
