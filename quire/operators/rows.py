"""Operators over ordered rows: islands, anchors, ordinals, references, weaving, regions.

Each takes DataFrames and column names. Windows run per key, so they spread over the key's partitions; where
a per-row array expression does the same, it is used instead and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a rule table is broadcast, after it was counted. Beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def small(rules: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rules`` marked for broadcast if it was counted to hold at most ``rows``; else as it is."""
    return F.broadcast(rules) if rules.limit(rows + 1).count() <= rows else rules


#: Input that is worth a task of its own, and input up to which a core is not yet filled.
TASK_BYTES, CORE_BYTES = 1 << 16, 1 << 27


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its input, as Catalyst estimates it, can't fill them: one row group is one task.

    Larger inputs have tasks enough, and stay where they are read. What was mapped or dealt out already was spread
    before that; estimates of what a map gives say nothing of its work.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(x in plan.toString() for x in ("MapInArrow", "Repartition")):
        return df
    size = int(str(plan.stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(2 * cores, size // TASK_BYTES)
    return df.repartition(tasks) if tasks > 1 and size < cores * CORE_BYTES else df


def islands(df: DataFrame, by: list[str], order: list, same: list, inside: Column) -> DataFrame:
    """Adds ``island``: numbers of maximal runs of rows inside, equal in ``same``, in order; null outside.

    Two row numbers differ by a constant within a run, so one sort serves both.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    key = F.struct(inside.alias("inside"), *[F.col(c) for c in same])
    before = F.lag(key).over(w)
    starts = F.when(inside & (before.isNull() | (before != key)), 1).otherwise(0)
    df = df.withColumn("_starts", starts)
    number = F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("island", F.when(inside, number)).drop("_starts")


def ordinals(df: DataFrame, by: list[str], order: list, same: list, inside: Column) -> DataFrame:
    """Adds the place of each row in its island."""
    df = islands(df, by, order, same, inside)
    w = Window.partitionBy(*by, "island").orderBy(*order)
    return df.withColumn("ordinal", F.when(F.col("island").isNotNull(), F.row_number().over(w)))


def anchor_asof(df: DataFrame, by: list[str], order: list, value: Column, name: str = "anchor") -> DataFrame:
    """Each row gets the last non-null value at or before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def undefined(refs: DataFrame, declared: DataFrame, on: list[str]) -> DataFrame:
    """References to nothing declared."""
    return refs.join(declared, on, "left_anti")


def mismatched(refs: DataFrame, declared: DataFrame, on: list[str], left: str, right: str) -> DataFrame:
    """References whose target is attached to another element."""
    return refs.join(declared, on).where(F.col(left) != F.col(right))


def renumber(declared: DataFrame, refs: DataFrame, by: list[str], name: str, order: list) -> DataFrame:
    """New names ``o1..`` of the anchors that are referred to, in the order of declaration."""
    if not by:
        raise ValueError("anchors are numbered within a document: name its key columns")
    used = declared.join(refs.select(*by, name).distinct(), [*by, name], "left_semi")
    w = Window.partitionBy(*by).orderBy(*order)
    return used.withColumn("new_name", F.concat(F.lit("o"), F.row_number().over(w)))


def canonical_terms(df: DataFrame, vocabulary: DataFrame, value: str) -> DataFrame:
    """Adds ``canonical``: the term itself, or that of its alias in any case; others pass through.

    The vocabulary is a rule table of the schema; it is broadcast where it is counted to be small.
    """
    terms = vocabulary.groupBy("alias").agg(F.min("term").alias("term"))
    out = df.join(small(terms), F.lower(F.col(value)) == F.col("alias"), "left")
    return out.withColumn("canonical", F.coalesce("term", value)).drop("alias", "term")


def weave(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Slices of two witnesses side by side at their coordinates; one side is null where it lacks one."""
    return left.join(right, on, "full")


def _whole_keys(it, by: list[str], columns: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Rows that come sorted by ``by``, some whole keys at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table, by)
        last = int(np.flatnonzero(starts)[-1])
        if last:
            yield table.slice(0, last)
        held, size = table.slice(last).to_batches(), len(table) - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where a key differs from that of the row before."""
    out = np.zeros(len(table), bool)
    out[0] = True
    for c in by:
        codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def count_inversions(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """By group, numbered from 0 in order, pairs of rows whose values fall: counted half by half, as a merge sort would."""
    first = np.searchsorted(group, np.arange(group[-1] + 1))
    place = np.arange(len(group)) - first[group]
    rank = np.unique(value, return_inverse=True)[1]
    out = np.zeros(len(first), np.int64)
    for k in range(int(place.max()).bit_length()):
        right = place >> k & 1
        order = np.lexsort((right, rank, place >> k + 1, group))
        part = np.cumsum(np.concatenate(([0], np.diff(group[order]) | np.diff(place[order] >> k + 1))) != 0)
        left = np.cumsum(1 - right[order])  # of the left half, ranks up to here
        ends = np.append(np.flatnonzero(np.diff(part)), len(part) - 1)
        above = left[ends][part] - left
        np.add.at(out, group[order], np.where(right[order] == 1, above, 0))
    return out


def inversions(df: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Per key, pairs of items that two orders put the other way round.

    Spark sorts each partition by key and first order; inversions of the second are counted in n log n steps, many keys
    at a time.
    """
    types = dict(df.dtypes)

    def run(it):
        for table in _whole_keys(it, by, [second]):
            starts = _starts(table, by)
            found = count_inversions(np.cumsum(starts) - 1, table[second].to_numpy())
            keys = table.select(by).take(np.flatnonzero(starts)).append_column("n_inversions", pa.array(found))
            yield from keys.filter(pa.array(found > 0)).to_batches()

    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*by, first, second)
    rows = rows.repartition(*by).sortWithinPartitions(*by, first, second).drop(first)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in by], "n_inversions long"]))


def regions(df: DataFrame, by: list[str], order: list, trigger: Column) -> DataFrame:
    """Adds ``region``: how many triggers stand at or before the row; 0 before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("region", F.sum(F.when(trigger, 1).otherwise(0)).over(w))


def best_rules(nodes: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The rule with the largest class set among those whose classes the node has; ``tied`` if there are several.

    A key's rules travel to its nodes as one array (broadcast where counted to be small), and the choice is made in the
    node's own row.
    """
    rule = F.struct(F.size("classes").alias("size"), "rule", "classes")
    table = rules.groupBy(F.col(key).alias("_key")).agg(F.collect_list(rule).alias("_rules"))
    fits = F.filter("_rules", lambda r: F.forall(r["classes"], lambda c: F.array_contains("node_classes", c)))
    found = nodes.join(small(table), F.col(key) == F.col("_key")).select("node", fits.alias("fits")).where(F.size("fits") > 0)
    top = F.array_max(F.transform("fits", lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"))))
    found = found.select("node", "fits", top.alias("top"))
    return found.select("node", F.col("top")["rule"].alias("rule"), (F.size(F.filter("fits", lambda r: r["size"] == F.col("top")["size"])) > 1).alias("tied"))
