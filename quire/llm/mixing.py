"""Mixing sources to target weights by the cube method.

A source whose target is ``r`` times its size takes every document ``floor(r)`` times; the fraction left is
each document's inclusion probability for one more copy. The flight moves these probabilities through the
null space of two constraints, words and documents, three documents at a time, until at most two of a block
are undecided. Blocks of one source are a hash of its documents, so a source of any size is spread over
tasks; what blocks leave undecided flies again in blocks of blocks, until a source's is one block. The last documents of a block do not fly:
they and the at most two undecided ones are the landing problem, where of all choices (2 to the number of
LANDING + 2 at most) the one nearest to the balance in words, then in documents, is taken.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; repeated rows
are documents of their own; with no words at all every target is 0 and nothing is taken. Runs agree, since
blocks, order and the moves' coin depend on the rows only.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Written, row_key, small

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_ROWS = 2_000
LANDING = 10
TINY = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target, n_docs from (source, size).

    Targets are ``least(most * size, weight * level)`` with one level for all. The sources ordered by the
    level at which they reach their cap, the level is that of the first source that stays below its cap.
    The windows run over the sources' totals, not over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(k, F.lit(len(weights))))
    rows = totals.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    rows = rows.withColumn("cap_level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("cap_level", F.col("source").asc_nulls_last())
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    level_at = F.min(F.when(F.col("level") < F.col("cap_level"), F.struct("cap_level", "level"))).over(everything)
    rows = rows.withColumn("final", F.coalesce(level_at["level"], F.lit(0.0)))
    return rows.select("source", "source_size", "n_docs", F.least("cap", F.col("weight") * F.col("final")).alias("target"))


def flight(sizes: list[float], p: list[float], coin: random.Random) -> list[int]:
    """Moves ``p`` in place, keeping sum(p) and sum(p * size); returns the places left undecided (at most two)."""
    live: list[int] = []
    coming = iter(range(len(p)))
    while True:
        while len(live) < 3:
            k = next(coming, None)
            if k is None:
                break
            if TINY < p[k] < 1 - TINY:
                live.append(k)
            else:
                p[k] = float(round(p[k]))
        if len(live) == 3:
            a, b, c = (sizes[k] for k in live)
            u = (b - c, c - a, a - b)
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
        elif len(live) == 2 and sizes[live[0]] == sizes[live[1]]:
            u = (1.0, -1.0)
        else:
            return live
        up = min(((1 - p[k]) if x > 0 else -p[k]) / x for k, x in zip(live, u) if x)
        down = min((p[k] if x > 0 else p[k] - 1) / x for k, x in zip(live, u) if x)
        step = up if coin.random() * (up + down) < down else -down
        left = []
        for k, x in zip(live, u):
            p[k] += step * x
            if p[k] <= TINY or p[k] >= 1 - TINY:
                p[k] = float(round(p[k]))
            else:
                left.append(k)
        if len(left) == len(live):  # rounding kept all inside: settle the nearest one
            k = min(live, key=lambda i: min(p[i], 1 - p[i]))
            p[k] = float(round(p[k]))
            left.remove(k)
        live = left


def land(sizes: list[float], p: list[float], live: list[int]) -> None:
    """Decides the last units: least distance to the balance, a document of distance counting as 2% of a mean one."""
    own, part = np.array([sizes[k] for k in live]), np.array([p[k] for k in live])
    picks = np.arange(1 << len(live))[:, None] >> np.arange(len(live)) & 1
    off = np.abs((picks - part) @ own) + 0.02 * (own.mean() if len(live) else 0) * np.abs((picks - part).sum(axis=1))
    for k, x in zip(live, picks[int(np.argmin(off))]):
        p[k] = float(x)


def _flown(final: bool):
    def fly(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("turn", "ascending"), ("key_a", "ascending"), ("key_b", "ascending")]))
        sizes, p = [float(x) for x in table["size"].to_pylist()], table["p"].to_pylist()
        inside = [k for k, x in enumerate(p) if TINY < x < 1 - TINY]
        # half of those that land are the largest, so that any one of them can be made up for
        last = sorted(inside, key=lambda k: -sizes[k])[: LANDING // 2]
        last += [k for k in inside if k not in last][: LANDING - len(last)]
        flying = [k for k in inside if k not in last]
        q = [p[k] for k in flying]
        live = flight([sizes[k] for k in flying], q, random.Random(table["turn"][0].as_py()))
        for k, x in zip(flying, q):
            p[k] = x
        if final:
            land(sizes, p, [flying[k] for k in live] + last)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return fly


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, copies, taken and the row key."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = Written(docs.select("doc_id", "source", size.alias("size"), *row_key(docs)), "sizes").df
    targets = Written(source_targets(sizes, weights, most), "targets").df
    t = small(targets.withColumnRenamed("source", "source_t"))
    rows = sizes.join(t, sizes["source"].eqNullSafe(t["source_t"])).drop("source_t")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("ratio", ratio).withColumn("base", F.floor(F.col("ratio") + TINY).cast("int"))
    rows = rows.withColumn("p", F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0)))
    turn = F.xxhash64(F.lit("turn"), "source", "key_a", "key_b")
    block = F.pmod(F.xxhash64("key_a", "key_b"), F.ceil(F.col("n_docs") / BLOCK_ROWS)).cast("int")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "base", "p", "key_a", "key_b", turn.alias("turn"), block.alias("block"))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    flown = Written(rows.groupBy("source", "block").applyInArrow(_flown(False), rows.schema), "flown").df
    settled = [flown.where(~open_)]
    rest = flown.where(open_)
    while rest.groupBy("source").count().where(F.col("count") > BLOCK_ROWS).limit(1).count():
        again = rest.withColumn("block", F.floor(F.col("block") * (2 * LANDING) / BLOCK_ROWS).cast("int"))
        flown = Written(again.groupBy("source", "block").applyInArrow(_flown(False), rows.schema), "flown").df
        settled.append(flown.where(~open_))
        rest = flown.where(open_)
    done = rest.groupBy("source").applyInArrow(_flown(True), rows.schema)
    for part in settled:
        done = done.unionByName(part)
    copies = (F.col("base") + F.col("p").cast("int")).alias("copies")
    done = done.select("doc_id", "source", "size", "source_size", "target", copies, "key_a", "key_b")
    return done.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    taken = mix(docs).groupBy("key_a", "key_b").agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(docs)).dropDuplicates(["key_a", "key_b"])
    out = rows.join(taken, ["key_a", "key_b"])
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
