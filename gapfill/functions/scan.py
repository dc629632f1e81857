"""Prefix scans: ranks and running sums over a whole ordered table, without an ordered task for all of it.

Rows are range-partitioned by the order (Spark draws the bounds from a sample, and the number of partitions follows the
session and the size of the data), sorted inside, and kept in that state. What partitions carry to the next ones is one row
each; that is all that meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapfill.frames import cut_lineage, each

_ROW_BITS = 33  # of monotonically_increasing_id


def global_rank(df: DataFrame, order: Sequence, out: str, group: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """0-based rank of every row under ``order``, inside ``group``; all in the JVM.

    A rank is the number of rows of the partitions before it plus the place inside its own. The rank inside a group counts
    from the group's first row; NULL is a group like any other.
    """
    order, group = each(order), list(group)
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *each(group), *order).sortWithinPartitions(*each(group), *order)
    ranged = cut_lineage(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _ROW_BITS)
    # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
               .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    ranked = (ranged.join(F.broadcast(offsets), part == F.col("__part"))
              .withColumn(out, F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("__at", "__part", "__offset"))
    if not group:
        return ranked
    names = [f"__g{i}" for i in range(len(group))]
    starts = ranked.groupBy(*[c.alias(n) for c, n in zip(each(group), names)]).agg(F.min(out).alias("__start"))
    same = F.lit(True)
    for c, n in zip(each(group), names):
        same = same & c.eqNullSafe(F.col(n))
    return ranked.join(starts, same).withColumn(out, F.col(out) - F.col("__start")).drop("__start", *names)


def running_sums(df: DataFrame, group: str, order: str, sums: Sequence[str], partitions: int | None = None) -> DataFrame:
    """(group, order, next, *sums): running sums of long columns up to each row of its group, and the value that follows in the group (NULL at its end).

    ``order`` is a double without NULL, distinct within a group. A group may span any number of partitions.
    """
    ranged = cut_lineage(df.select(group, order, *[F.col(s).cast("long").alias(s) for s in sums])
                         .repartitionByRange(*([partitions] if partitions else []), group, order).sortWithinPartitions(group, order))
    width = len(sums)

    def parts(batch):
        """(group, first row, one past the last) of a sorted batch."""
        names = batch.column(0).to_pylist()
        cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        return [(names[a], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]

    def ends(batches):
        """The first value and the sums of a partition's first and last group; of a whole partition at most two rows."""
        seen: list[list] = []
        for batch in batches:
            value = batch.column(1).to_numpy()
            columns = [batch.column(2 + k).to_numpy() for k in range(width)]
            for name, a, b in parts(batch):
                total = [int(c[a:b].sum()) for c in columns]
                if seen and seen[-1][0] == name:
                    seen[-1][2] = [x + y for x, y in zip(seen[-1][2], total)]
                else:
                    # groups between the first and the last end here
                    seen = seen[:1] + [[name, float(value[a]), total]]
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at] * len(seen), pa.int32()), pa.array([s[0] for s in seen], pa.string()), pa.array([s[1] for s in seen], pa.float64()),
                                          pa.array([s[2] for s in seen], pa.list_(pa.int64()))], names=["part", "name", "first", "total"])
    found = sorted((r["part"], i, r["name"], r["first"], r["total"]) for i, r in enumerate(
        ranged.mapInArrow(ends, "part int, name string, first double, total array<bigint>").collect()))
    carry: dict[int, tuple[str, list[int]]] = {}      # what a partition's first group has summed before
    follow: dict[int, tuple[str, float]] = {}         # the value after a partition's last row, in the same group
    open_name, open_sum, last_part = None, [0] * width, None
    for part, _, name, first, total in found:
        if name == open_name and part != last_part:
            carry[part] = (name, open_sum)
            follow[last_part] = (name, first)
            open_sum = [x + y for x, y in zip(open_sum, total)]
        else:
            open_name, open_sum = name, list(total)
        last_part = part

    def lift(batches):
        at = TaskContext.get().partitionId()
        name_before, before = carry.get(at, (None, [0] * width))
        held = None

        def finish(rows, following):
            """Rows of one batch, whose last row is followed by ``following`` = (group, value)."""
            names, value, columns = rows
            after = np.append(value[1:], following[1])
            same = np.array([x == y for x, y in zip(names, [*names[1:], following[0]])])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(value), pa.array(after, mask=~same), *map(pa.array, columns)],
                                              names=[group, order, "next", *sums])
        for batch in batches:
            if not batch.num_rows:
                continue
            value = batch.column(1).to_numpy()
            columns = [batch.column(2 + k).to_numpy().copy() for k in range(width)]
            for name, a, b in parts(batch):
                base = before if name == name_before else [0] * width
                for k in range(width):
                    columns[k][a:b] = np.cumsum(columns[k][a:b]) + base[k]
                name_before, before = name, [int(c[b - 1]) for c in columns]
            names = batch.column(0).to_pylist()
            if held:
                yield finish(held, (names[0], value[0]))
            held = names, value, columns
        if held:
            yield finish(held, follow.get(at, (None, np.nan)))
    schema = T.StructType([ranged.schema[group], T.StructField(order, T.DoubleType()), T.StructField("next", T.DoubleType()),
                           *[T.StructField(s, T.LongType()) for s in sums]])
    return ranged.mapInArrow(lift, schema)
