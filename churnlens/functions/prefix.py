"""Global running sums without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task. Instead:

1. ``repartitionByRange`` on (group keys, order keys) and sort within partitions;
   ``checkpoint()`` the result into the shared checkpoint folder so partition
   ids and in-partition order are fixed even if executors are lost;
2. one small job computes per-(partition, group) counts and sums — at most
   #partitions + #groups rows reach the driver;
3. the driver turns them into exclusive offsets;
4. a narrow ``mapInPandas`` pass adds the offset to a local cumulative sum.

No shuffle happens after the range partitioning. ``running`` gives every row its sums;
``reduce`` only hands the sums to a function that boils the rows of a slice down to a few
(rank statistics, order statistics, areas), which merge by plain aggregates.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.session import ensure_checkpoint_dir


class RangeOrdered:
    """A table range-partitioned and sorted by ``partition_by + order``."""

    def __init__(self, df: DataFrame, order: list[Column], partition_by: list[str] = (),
                 num_partitions: int | None = None):
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.partition_by = list(partition_by)
        keys = [F.col(c) for c in self.partition_by] + list(order)
        ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        self.df = ranged.checkpoint(eager=True)

    def _inputs(self, sums: dict[str, Column], where: Column | None):
        """The rows with clean inputs of the sums and a key of their group, the inputs' types,
        and the offsets of each (partition, group)."""
        base = self.df if where is None else self.df.where(where)
        tmp = {name: f"__in_{name}" for name in sums}
        inputs = base.select(*base.columns, *[expr.alias(tmp[name]) for name, expr in sums.items()])
        kinds = {f.name: f.dataType for f in inputs.schema.fields}

        def filled(name: str) -> Column:
            zero = F.lit(0).cast(kinds[name])
            known = F.coalesce(F.col(name), zero)
            return F.when(F.isnan(known), zero).otherwise(known) if isinstance(
                kinds[name], (T.DoubleType, T.FloatType)) else known

        # JSON leaves NULL fields out, so each NULL pattern is a key of its own
        group_key = F.to_json(F.struct(*map(F.col, self.partition_by))) if self.partition_by else F.lit("")
        staged = inputs.select(*base.columns, *[filled(tmp[n]).alias(tmp[n]) for n in sums], group_key.alias("__group"))
        totals = (staged.groupBy(F.spark_partition_id().alias("__pid"), "__group")
                  .agg(F.count(F.lit(1)).alias("__n"), *[F.sum(tmp[n]).alias(tmp[n]) for n in sums])
                  .collect())
        return staged, kinds, tmp, totals

    def _slices(self, sums: dict[str, Column], tmp: dict[str, str], totals):
        """A function of a task's batches: (rows, group, first, end, places, running sums) of each
        contiguous slice of a group."""
        offsets, names = _exclusive_offsets(totals, list(sums), tmp), list(sums)

        def walk(batches):
            from pyspark import TaskContext
            part = TaskContext.get().partitionId()
            state: dict = {}
            for pdf in batches:
                if pdf.empty:
                    continue
                groups = pdf["__group"].to_numpy()
                starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
                for g, a, b in zip(groups[starts], starts, np.r_[starts[1:], len(pdf)]):
                    st = state.get(g)
                    if st is None:
                        off_n, off_s = offsets[(part, g)]
                        st = state[g] = [off_n, dict(off_s)]
                    places = st[0] + np.arange(1, b - a + 1)
                    st[0] += b - a
                    run = {}
                    for s in names:
                        run[s] = np.cumsum(pdf[tmp[s]].to_numpy()[a:b]) + st[1][s]
                        st[1][s] = run[s][-1]
                    yield pdf, g, a, b, places, run
        return walk

    def running(self, sums: dict[str, Column], where: Column | None = None,
                rn: str = "rn") -> DataFrame:
        """Rows (optionally filtered) with 1-based ``rn`` and inclusive running sums
        per group, in the table's order. Sum inputs must be integral or double; NULL
        and NaN inputs add nothing, and NULL is a group like any other."""
        staged, kinds, tmp, totals = self._inputs(sums, where)
        cols, walk = self.df.columns, self._slices(sums, tmp, totals)
        schema = T.StructType(self.df.schema.fields + [T.StructField(rn, T.LongType())] + [
            T.StructField(name, T.LongType() if isinstance(kinds[tmp[name]], (T.IntegralType,))
                          else T.DoubleType()) for name in sums])

        def local_pass(batches):
            for pdf, _, a, b, places, run in walk(batches):
                yield pdf[cols].iloc[a:b].assign(**{rn: places, **run})

        return staged.mapInPandas(local_pass, schema)

    def reduce(self, sums: dict[str, Column], boil, schema: str) -> DataFrame:
        """The group columns and what ``boil(rows, places, running, totals)`` makes of each slice
        of a group: a list of tuples of ``schema``. ``rows`` is a pandas frame, ``places`` and
        ``running`` are as in :meth:`running`, ``totals`` has the group's sums and its row
        count ``n``. A group has a slice per partition and batch, so the rows must merge."""
        staged, _, tmp, totals = self._inputs(sums, None)
        walk, whole, by = self._slices(sums, tmp, totals), {}, self.partition_by
        for r in totals:
            t = whole.setdefault(r["__group"], dict.fromkeys(["n", *sums], 0))
            t["n"] += r["__n"]
            for s in sums:
                t[s] += r[tmp[s]] or 0
        fields = T.StructType([f for f in self.df.schema.fields if f.name in by]) if by else T.StructType([])
        out = T.StructType(fields.fields + T._parse_datatype_string(schema).fields)

        def local_pass(batches):
            for pdf, g, a, b, places, run in walk(batches):
                rows = pdf.iloc[a:b]
                own = tuple(rows[c].iloc[0] for c in by)
                yield pd.DataFrame([(*own, *t) for t in boil(rows, places, run, whole[g])], columns=out.names)

        return staged.mapInPandas(local_pass, out)


def _exclusive_offsets(totals, sum_names, tmp):
    """(partition, group) -> (rows before, {sum: total before}) in range order."""
    by_group = defaultdict(list)
    for r in totals:
        by_group[r["__group"]].append(r)
    offsets = {}
    for g, rows in by_group.items():
        acc_n, acc = 0, {s: 0 for s in sum_names}
        for r in sorted(rows, key=lambda x: x["__pid"]):
            offsets[(r["__pid"], g)] = (acc_n, dict(acc))
            acc_n += r["__n"]
            for s in sum_names:
                acc[s] = acc[s] + (r[tmp[s]] or 0)
    return offsets


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column],
                 partition_by: list[str] = (), rn: str = "rn",
                 num_partitions: int | None = None) -> DataFrame:
    """One-shot convenience wrapper around :class:`RangeOrdered`."""
    return RangeOrdered(df, order, partition_by, num_partitions).running(sums, rn=rn)


__all__ = ["RangeOrdered", "running_sums"]
