"""Running totals over a whole sorted table: range partitions, a scan of each, and prefix sums over the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, lean, partitions

#: Totals are kept modulo 2^61, so that adding two never overflows.
MASK = (1 << 61) - 1


def running(df: DataFrame, order: list[str], values: list[str], scratch: Scratch, name: str, group: str | None = None) -> DataFrame:
    """df with run_<v> for each column v of values (longs from 0 up to MASK): its total up to and with that row, modulo 2^61.

    Rows are taken in the order of `order` (nulls first), within each value of group, if given: a long that is
    never null, and the first of `order`. A group may lie across any number of partitions. What passes through
    the driver is one record for each partition: its first and last group, and the totals at its end.
    """
    names = [f"run_{v}" for v in values]
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, totals, last, opened, at = TaskContext.get().partitionId(), np.zeros(len(values), np.int64), None, True, 0
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            groups = batch.column(group).to_numpy() if group else np.zeros(n, np.int64)
            new = np.empty(n, bool)
            new[0], new[1:] = last is not None and groups[0] != last, groups[1:] != groups[:-1]
            segment = np.cumsum(new)
            begins = np.flatnonzero(new)
            out = []
            for k, v in enumerate(values):
                x = batch.column(v).to_numpy().astype(np.int64)
                total = np.cumsum(x)
                base = np.concatenate([[-totals[k]], total[begins] - x[begins]])
                out.append((total - base[segment]) & MASK)
            totals, last = np.array([o[-1] for o in out]), groups[-1]
            still = (segment == 0) if opened else np.zeros(n, bool)
            opened = bool(still[-1])
            extra = [*out, np.full(n, part, np.int32), np.arange(at, at + n), still, groups.astype(np.int64)]
            at += n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, extra)], names=[*columns, *names, "part_", "row_", "opened_", "group_"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), *(f"{c} long" for c in names), "part_ int, row_ long, opened_ boolean, group_ long"])
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = scratch.table(dealt.mapInArrow(lean(run), schema), name)
    ends = rows.groupBy("part_").agg(F.min_by("group_", "row_").alias("first"), F.max_by(F.struct("group_", "opened_", *names), "row_").alias("last"))
    carried, before, carry = [], None, [0] * len(names)
    for r in sorted(ends.collect(), key=lambda r: r["part_"]):
        held = carry if before == r["first"] else [0] * len(names)
        if any(held):
            carried.append((r["part_"], *held))
        carry = [(r["last"][c] + (h if r["last"]["opened_"] else 0)) & MASK for c, h in zip(names, held, strict=True)]
        before = r["last"]["group_"]
    kept = [F.col(c) for c in columns]
    if not carried:
        return rows.select(*kept, *names)
    carries = df.sparkSession.createDataFrame(carried, ", ".join(["part_ int", *(f"carry_{c} long" for c in names)]))
    joined = rows.join(F.broadcast(carries), "part_", "left")
    added = [F.when(F.col("opened_"), F.col(c) + F.coalesce(f"carry_{c}", F.lit(0))).otherwise(F.col(c)).bitwiseAND(MASK).alias(c) for c in names]
    return joined.select(*kept, *added)
