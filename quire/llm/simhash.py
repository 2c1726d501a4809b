"""SimHash near-duplicates with pivot distance tables.

Documents with one fingerprint are one node. Two fingerprints at 3 or fewer differing bits agree wholly in
at least three of six bit groups, so each distinct fingerprint is dealt under the twenty triples of groups;
a task sorts what it got by triple and computes a table of Hamming distances to the pivots (random
reference fingerprints). The distance to a pivot differs by at most 3 between linked fingerprints: pairs
are formed only within that reach of the first pivot, dropped by the largest difference over the others,
and the survivors are verified by their own distance. Links found are reduced to stars inside the task.
A bucket beyond TILE fingerprints is dealt again as pairs of tiles, so that no task holds all of it.

Defined cases: a null text, or one without words, has fingerprint zero and is linked like any other; with
fewer words than a shingle the whole sequence is one shingle; a null doc_id is reached by none and takes
its component's least doc_id; repeated rows share a component; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Written, mapped, release, whole_groups
from quire.llm.components import components

SHINGLE = 3
MOST_BITS = 3
PIVOTS = 16
TILE = 50_000
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bit groups whose triples are the buckets: sizes differ by one at most.
GROUPS = [(0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64)]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes, repeats included."""
    from xxhash import xxh64_intdigest

    words = WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        pairs = zip(starts[k : min(n, k + 65536)].tolist(), last[k : k + 65536].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in pairs], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``fp`` (the 64 bits as a signed long) to all columns but ``text``."""
    keep = [c for c in docs.columns if c != "text"]

    def run(it):
        for b in it:
            fps = np.array([fingerprint(t or "", shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(fps, pa.int64())], [*keep, "fp"])

    out = docs.select(*keep).schema.add("fp", "long")
    return mapped(docs.select(*keep, "text"), run, out, 500)


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of the fingerprints to the pivots, one row per pivot."""
    refs = np.random.default_rng(64).integers(0, 1 << 64, pivots, np.uint64, endpoint=False)
    return np.stack([np.bitwise_count(fps ^ r) for r in refs]).astype(np.int16)


def local_links(group: np.ndarray, fps: np.ndarray, side: np.ndarray | None = None, most: int = MOST_BITS, block: int = 1 << 21) -> Iterator[np.ndarray]:
    """Links as stars among fingerprints of one group: ``group`` numbers groups, rows may be in any order.

    side: only pairs of different sides count where a group has both sides 1 and 2.
    """
    from_pivots = pivot_table(fps)
    key = group.astype(np.int64) * 256 + from_pivots[0]
    order = np.argsort(key, kind="stable")
    key, fps, table = key[order], fps[order], from_pivots[:, order]
    side = None if side is None else side[order]
    end = np.searchsorted(key, key + most, "right")
    width = end - np.arange(len(fps)) - 1
    label = np.arange(len(fps))
    start = 0
    total = np.concatenate(([0], np.cumsum(width)))
    while start < len(fps):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + block, "right")) - 1)
        n = width[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[start:stop] - total[start], n)
        start = stop
        ok = label[a] != label[b]
        if side is not None:
            ok &= (side[a] != side[b]) | (side[a] == 0)
        a, b = a[ok], b[ok]
        for row in table[1:]:
            if not len(a):
                break
            near = np.abs(row[a] - row[b]) <= most
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= most
        a, b = a[near], b[near]
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label != label[label]).any():
                label = label[label]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
    tied = np.flatnonzero(label != np.arange(len(fps)))
    if len(tied):
        yield np.stack([fps[tied], fps[label[tied]]])


def _runs(keys: np.ndarray) -> np.ndarray:
    """Numbers of runs of equal keys in a sorted array."""
    return np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1]))) if len(keys) else keys


def links(fps: DataFrame, most: int = MOST_BITS, tile: int = TILE) -> DataFrame:
    """Links (a, b) as stars among the distinct longs ``fp``."""
    triples = [sum((1 << hi) - (1 << lo) for lo, hi in three) for three in combinations(GROUPS, 3)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in triples])
    dealt = fps.select("fp", F.posexplode(masks).alias("triple", "mask"))
    dealt = dealt.select("fp", F.xxhash64("triple", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))

    def plain(it):
        for bucket, fp in whole_groups(it, "bucket", ("fp",)):
            yield from _star_batches(bucket, fp.view(np.uint64), None, most)

    def sided(it):
        for bucket, fp, side in whole_groups(it, "bucket", ("fp", "side")):
            yield from _star_batches(bucket, fp.view(np.uint64), side, most)

    def stars(rows, by):
        return mapped(rows.repartition("bucket").sortWithinPartitions("bucket"), by, "a long, b long")

    large = Written(dealt.groupBy("bucket").count().where(F.col("count") > tile), "large")
    if not large.df.limit(1).count():
        return stars(dealt, plain)
    rest = stars(dealt.join(large.df, "bucket", "left_anti"), plain)
    hot = dealt.join(large.df, "bucket").withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
    hot = hot.withColumn("own", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))
    hot = hot.select("fp", "bucket", "own", F.explode(pair).alias("p"))
    side = F.when(F.col("p.i") == F.col("p.j"), 0).when(F.col("own") == F.col("p.i"), 1).otherwise(2)
    hot = hot.select("fp", F.xxhash64("bucket", "p.i", "p.j").alias("bucket"), side.cast("int").alias("side"))
    return rest.union(stars(hot, sided))


def _star_batches(bucket: np.ndarray, fps: np.ndarray, side: np.ndarray | None, most: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    group = _runs(bucket[order])
    size = np.bincount(group)[group] if len(group) else group
    order, group = order[size > 1], group[size > 1]
    # a few groups at a time: the number of rows held is that of the part or of one group
    at = 0
    while at < len(order):
        stop = min(len(order), at + 200_000)
        while stop < len(order) and group[stop] == group[stop - 1]:
            stop += 1
        rows = order[at:stop]
        for pair in local_links(group[at:stop], fps[rows], None if side is None else side[rows], most):
            yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], ["a", "b"])
        at = stop


def _labelled(rows: DataFrame) -> DataFrame:
    """rows: a written table with doc_id and fp. Adds component_id, the least doc_id of the component."""
    nodes = Written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = Written(links(nodes.df.select("fp")), "links")
    roots = components(found.df).withColumnRenamed("node", "fp")
    rooted = nodes.df.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = Written(rooted.join(least, "root").select("fp", "component_id"), "named")
    nodes.drop()
    found.drop()
    release(rows.sparkSession)
    return rows.join(named.df, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, one row per row of ``docs``."""
    return _labelled(Written(fingerprints(docs.select("doc_id", "text")), "fingerprints").df)
