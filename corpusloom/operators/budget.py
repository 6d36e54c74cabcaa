"""Size budgets in a given order, splits by stratum, and samples."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import SEED, BudgetConfig
from corpusloom.functions.text import shuffle_key
from corpusloom.scratch import Scratch


def running_total(df: DataFrame, order: list[str], value: str | Column, scratch: Scratch, name: str, by: list[str] | None = None) -> DataFrame:
    """df with total: the sum of value up to and with each row in the order of columns (within groups), as a written table.

    Rows are sorted over range partitions; the sums of each partition (one row a partition, and one more a
    group) give the next ones their base, so no task sees all rows, nor all of a large group. Rows must
    differ in the order's columns.
    """
    by = by or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    parts = scratch.table(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), f"{name}-parts")
    within = Window.partitionBy("_part", *by)
    sums = parts.groupBy("_part", *by).agg(F.sum("_value").alias("_s"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_by_{c}") for c in by), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inner = parts.withColumn("_inner", F.sum("_value").over(within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    total = inner.join(bases, same).withColumn("total", F.col("_inner") + F.col("_base"))
    return scratch.table(total.select(*df.columns, "total"), name)


def ranked(df: DataFrame, by: list[str], order: list[str], scratch: Scratch, name: str = "ranked") -> DataFrame:
    """df with rank (from 1) in its group and n, the group's size; large groups are spread over tasks."""
    rows = running_total(df, order, F.lit(1), scratch, name, by).withColumnRenamed("total", "rank")
    sizes = df.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(sizes, same).drop(*(f"_by_{c}" for c in by))


def _fill(gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = gap
        for batch in batches:
            take = []
            for n in batch.column("_size").to_pylist():
                take.append(n <= left)
                left -= n if take[-1] else 0
            yield batch.filter(pa.array(take, pa.bool_())).drop_columns(["_size"])

    return run


#: So few rows that may still fit one task fills at once, in order; and up to LONG_TAIL where a round settles less than a tenth of them.
FILLED_AT_ONCE, LONG_TAIL = 100, 200_000


def first_fit(df: DataFrame, order: list[str], size: str, budget: int, at_once: int = FILLED_AT_ONCE) -> DataFrame:
    """The rows that a greedy fill takes: each in turn if it still fits, later ones too when one doesn't.

    If all fit together, all are taken. Else all rows before the first that doesn't fit are taken at once by a
    running total; of the rows after it only those can fit that are no larger than what is left, and they are
    filled in the same way again, in as many rounds as it takes. Once few are left, or rounds get on slowly, one
    task fills them in order.
    """
    scratch = Scratch(df.sparkSession, "fit")
    left, gap, taken, before = df.filter(F.col(size) <= budget), budget, [], None
    for k in itertools.count():
        n, total = left.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).head()
        slow, before = before is not None and n <= LONG_TAIL and n > 0.9 * before, n
        if total <= gap or n <= at_once or slow:
            if n and total > gap:
                one = left.withColumn("_size", F.col(size).cast("long")).repartition(1).sortWithinPartitions(*order)
                left = one.mapInArrow(_fill(gap), left.schema)
            taken.append(left)
            break
        rows = running_total(left, order, size, scratch, f"r{k}")
        fits = rows.filter(F.col("total") <= gap)
        stop = rows.filter(F.col("total") > gap).agg(F.min(F.struct(*order))).head()[0]
        # Sizes of 0 after the stop have a larger total, so what fits is all before it.
        taken.append(fits.drop("total"))
        gap -= fits.agg(F.coalesce(F.sum(size), F.lit(0))).head()[0]
        types = dict(rows.dtypes)
        after = F.struct(*order) > F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, stop, strict=True)))
        left = scratch.table(rows.filter(after & (F.col(size) <= gap)).drop("total"), f"left{k}")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def apply_budget(df: DataFrame, cfg: BudgetConfig = BudgetConfig(), seed: int = SEED) -> tuple[DataFrame, dict]:
    """The documents (doc_id, provenance_class, priority, source, n_chars) that stay, and a report.

    Manual documents fill their own target first; the characters they fill, at the wanted manual fraction
    and a margin, cap all other classes together.
    """
    order = ["priority", "source", "shuffle", "doc_id"]
    rows = df.withColumn("shuffle", shuffle_key(F.col("doc_id"), seed))
    is_manual = F.coalesce(F.col("provenance_class") == "manual", F.lit(False))
    manual_target = int(cfg.manual_target_tokens * cfg.manual_chars_per_token)
    down_target = int(cfg.downloaded_target_tokens * cfg.downloaded_chars_per_token)

    def chars(kept: DataFrame) -> int:
        return kept.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).head()[0]

    manual = first_fit(rows.filter(is_manual), order, "n_chars", manual_target)
    manual_chars = chars(manual)
    f = min(0.99, cfg.min_manual_fraction + cfg.margin)
    cap = int(manual_chars / cfg.manual_chars_per_token * (1 - f) / f * cfg.downloaded_chars_per_token) if f > 0 else None
    budget = down_target if cap is None else min(down_target, cap)
    other = first_fit(rows.filter(~is_manual), order, "n_chars", budget)
    down_chars = chars(other)
    shortfall = max(0, manual_target - manual_chars)
    material = max(int(0.01 * manual_target), 50_000)
    binding = "ratio" if shortfall > material and cap is not None and cap < down_target else "target"
    total = manual_chars + down_chars
    report = {"manual_chars": manual_chars, "downloaded_chars": down_chars, "downloaded_budget": budget, "ratio_cap_chars": cap, "binding": binding, "manual_shortfall_chars": shortfall, "effective_fraction": f, "manual_char_fraction": manual_chars / total if total else 0.0}
    return manual.unionByName(other).drop("shuffle"), report


def stratified_split(df: DataFrame, strata: list[str], ratios: tuple[float, float, float] = (0.98, 0.01, 0.01), smallest: int = 20, seed: int = SEED) -> DataFrame:
    """df with split: in each stratum the first max(1, floor(n r)) documents of a fixed shuffle go to val, the next to test; small strata are all train."""
    scratch = Scratch(df.sparkSession, "split")
    # Written: range partitions, ranks and sizes would each make df anew.
    narrow = scratch.table(df.select("doc_id", *strata).withColumn("_shuffle", shuffle_key(F.col("doc_id"), seed)), "narrow")
    rows = ranked(narrow, strata, ["_shuffle", "doc_id"], scratch)
    val, test = (F.greatest(F.lit(1), F.floor(F.col("n") * r)) for r in ratios[1:])
    split = F.when(F.col("n") < smallest, "train").when(F.col("rank") <= val, "val").when(F.col("rank") <= val + test, "test").otherwise("train")
    # Few rows aren't train, so the join back is small on one side.
    held = rows.select(F.col("doc_id").alias("_id"), split.alias("split")).filter("split <> 'train'")
    return df.join(held, F.col("doc_id") == F.col("_id"), "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("_id")


def sample(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n rows of a fixed shuffle by doc_id (a top-n, never a full sort)."""
    return df.orderBy(shuffle_key(F.col("doc_id"), seed), "doc_id").limit(n)


def sample_by_class(df: DataFrame, n: int, column: str = "provenance_class", seed: int = SEED) -> DataFrame:
    """Up to n rows of each class in a fixed shuffle."""
    w = Window.partitionBy(column).orderBy(shuffle_key(F.col("doc_id"), seed), "doc_id")
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def label_split(key: Column, train: float = 0.8, seed: int = SEED) -> Column:
    """train or test by a hash of the key."""
    return F.when(F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("long") < int(train * (1 << 32)), "train").otherwise("test")


def line_sample(lines: DataFrame, share: float, column: str = "line") -> DataFrame:
    """Lines whose content hash falls in the share, so equal lines stay or go together."""
    return lines.filter(F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))


def until_budget(df: DataFrame, order: list[str], size: str, budget: int) -> DataFrame:
    """The rows that a collection with a budget reads: all until the sum reaches it, with the one that crosses."""
    scratch = Scratch(df.sparkSession, "collect")
    return running_total(df, order, size, scratch, "r").filter(F.col("total") - F.col(size) < budget).drop("total")


def strided_windows(df: DataFrame, windows: int, budget: int, size: str = "n_chars", by: str = "doc_id") -> DataFrame:
    """Equal windows over each source in the order of `by`; from each, rows until its share of the budget is met, with the one that crosses."""
    per, scratch = max(1, budget // windows), Scratch(df.sparkSession, "strided")
    rows = ranked(df, ["source"], [by], scratch)
    q, r = F.floor(F.col("n") / windows), F.col("n") % windows
    # The first n % windows windows have one row more.
    late = r + F.floor((F.col("rank") - r * (q + 1) - 1) / F.greatest(q, F.lit(1))) + 1
    rows = rows.withColumn("window", F.when(F.col("rank") <= r * (q + 1), F.floor((F.col("rank") - 1) / (q + 1)) + 1).otherwise(late)).drop("rank", "n")
    rows = running_total(rows, [by], size, scratch, "windows", ["source", "window"])
    return rows.filter(F.col("total") - F.col(size) < per).drop("total")


def interleave(df: DataFrame, group: str, key: str, seed: int = SEED, ties: list[str] | None = None) -> DataFrame:
    """df with turn and place: round-robin over groups in shuffled order, each group's keys shuffled (order by turn, place). Rows of one key come in the order of ties."""
    rows = df.withColumn("_shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))))
    rows = ranked(rows, [group], ["_shuffle", key, *(ties or [])], Scratch(df.sparkSession, "interleave"))
    return rows.withColumnRenamed("rank", "turn").drop("n", "_shuffle").withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group))))
