"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional code words, one of each codebook, found by a beam
search over the residuals. Codebooks are k-means over the residuals of a bounded sample. The index keeps each
vector's codes, the squared norm of its approximation and the vector. A query is scored against all rows by
sums of table entries; the best of each block of rows by that score are ranked by their exact distance. A
task keeps each query's nearest over all its blocks and gives them out once, at its end.

The sample (``SAMPLE`` rows of least hash) bounds training only; every row is indexed. Queries are taken in
blocks of ``QUERIES`` rows, which bounds what is broadcast and what a task keeps; each block scans the index.

Defined cases: vectors that are null, empty, zero, of another dimension than most of the sample, or hold
null or non-finite components take no part; ties go to the smaller vec_id; a query's own vec_id is no
candidate, and repeated rows of a vec_id are; a query's vec_id with several vectors asks with the least of
them; with no valid rows the result is empty.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import Written, mapped

SAMPLE = 16384
BOOKS, WORDS, BEAM = 16, 256, 4
QUERIES = 20_000
RERANK = 256
ROWS = 8192
SEED = 17


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): usable vectors in double precision."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(axis=1) - 2 * x @ words.T, axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _nearest(x, words)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, at, x)
        words[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        words[empty] = x[rng.choice(len(x), len(empty))]
    return words


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) by beam search: at each book the best ``beam`` partial sums go on."""
    m, k, _ = books.shape
    out = np.empty((len(x), m), np.uint8)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        rest, codes, cost = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8), (part**2).sum(axis=1)[:, None]
        for j in range(m):
            norm = (books[j] ** 2).sum(axis=1)
            score = (cost[:, :, None] + norm - 2 * rest @ books[j].T).reshape(len(part), -1)
            top = np.argpartition(score, min(beam, score.shape[1] - 1), axis=1)[:, :beam]
            cost = np.take_along_axis(score, top, axis=1)
            who, word = top // k, top % k
            rest = np.take_along_axis(rest, who[:, :, None], axis=1) - books[j][word]
            codes = np.concatenate([np.take_along_axis(codes, who[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        best = np.argmin(cost, axis=1)
        out[at : at + 1024] = codes[np.arange(len(part)), best]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS) -> np.ndarray:
    rng, rest, out = np.random.default_rng(SEED), x.copy(), []
    for _ in range(books):
        out.append(kmeans(rest, words, rng))
        rest -= out[-1][_nearest(rest, out[-1])]
    return np.stack(out)


def build_index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[Written, np.ndarray] | None:
    """The written index (vec_id, v, codes, norm) of all valid rows, and the codebooks."""
    rows = valid(vectors)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not len(picked):
        return None
    some = picked["v"].to_pylist()
    sizes = Counter(map(len, some))
    dim = min(sizes, key=lambda n: (-sizes[n], n))
    books = train(np.array([v for v in some if len(v) == dim]))

    def run(it):
        for b in it:
            if len(b):
                x = b.column("v").flatten().to_numpy().reshape(len(b), dim)
                codes = encode(x, books)
                norm = (decode(codes, books) ** 2).sum(axis=1)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), packed, pa.array(norm)], ["vec_id", "v", "codes", "norm"])

    schema = "vec_id long, v array<double>, codes binary, norm double"
    return Written(mapped(rows.where(F.size("v") == dim), run, schema), "codes"), books


class Nearest:
    """Ids and distances of the ``k`` nearest rows so far of each query, nearest first, ties by id."""

    def __init__(self, n: int, k: int):
        self.ids, self.far = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf)

    def add(self, i: int, ids: np.ndarray, far: np.ndarray) -> None:
        k = self.ids.shape[1]
        ids, far = np.concatenate((self.ids[i], ids)), np.concatenate((self.far[i], far))
        best = np.lexsort((ids, far))[:k]
        self.ids[i], self.far[i] = ids[best], far[best]


def score_block(queries: np.ndarray, q_ids: np.ndarray, codes: np.ndarray, norm: np.ndarray, ids: np.ndarray, x: np.ndarray, books: np.ndarray, best: Nearest, rerank: int) -> None:
    """Adds to ``best`` the nearest of one block of rows for each query."""
    order = np.argsort(ids, kind="stable")  # equal scores then favour the smaller id
    codes, norm, ids, x = codes[order], norm[order], ids[order], x[order]
    for at in range(0, len(queries), 256):
        q, own = queries[at : at + 256], q_ids[at : at + 256]
        total = np.broadcast_to(norm, (len(q), len(norm))).copy()
        for j in range(len(books)):
            total -= (2 * q @ books[j].T)[:, codes[:, j]]
        total[own[:, None] == ids[None, :]] = np.inf
        if len(ids) > rerank:
            edge = np.partition(total, rerank - 1, axis=1)[:, rerank - 1 : rerank]
        else:
            edge = np.full((len(q), 1), np.inf)
        for i in range(len(q)):
            # rows below the edge, then those at it in order of their ids, up to the number to rerank
            row = total[i]
            less = np.flatnonzero(row < edge[i])
            at_edge = np.flatnonzero((row == edge[i]) & (row < np.inf))[: max(0, rerank - len(less))]
            pick = np.concatenate((less, at_edge))
            best.add(at + i, ids[pick], np.sqrt(((x[pick] - q[i]) ** 2).sum(axis=1)))


def search(spark: SparkSession, index: DataFrame, books: np.ndarray, queries: DataFrame, k: int = 10, rerank: int = RERANK, block: int = QUERIES) -> DataFrame:
    """queries: (vec_id, v). (query_id, rank, vec_id, score) of each query's k nearest in the index."""
    numbered = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // block)))))
    parts = 1 + (numbered.agg(F.max("part")).first()[0] or 0)
    found = []
    for p in range(parts):
        mine = numbered.where(F.col("part") == p).toArrow()
        q_ids = mine["vec_id"].to_numpy()
        if not len(q_ids):
            continue
        shared = spark.sparkContext.broadcast((q_ids, np.array(mine["v"].to_pylist()), books))

        def run(it, shared=shared):
            q_ids, q, books = shared.value
            best = Nearest(len(q), k)
            for b in it:
                for at in range(0, len(b), ROWS):
                    part = b.slice(at, ROWS)
                    x = np.array(part.column("v").to_pylist())
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(part), -1)
                    score_block(q, q_ids, codes, part.column("norm").to_numpy(), part.column("vec_id").to_numpy(), x, books, best, rerank)
            who, place = np.nonzero(best.far < np.inf)
            for at in range(0, len(who), 100_000):
                i, j = who[at : at + 100_000], place[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(best.ids[i, j]), pa.array(best.far[i, j])], ["query_id", "vec_id", "score"])

        found.append(Written(mapped(index, run, "query_id long, vec_id long, score double"), "nearest").df)
    near = found[0]
    for x in found[1:]:
        near = near.union(x)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``every``; candidates: all rows but the query's own."""
    spark = vectors.sparkSession
    built = build_index(vectors.select("vec_id", "embedding"))
    empty = "query_id long, rank int, vec_id long, score double"
    if built is None:
        return spark.createDataFrame([], empty)
    index, books = built
    queries = index.df.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    if not queries.limit(1).count():
        return spark.createDataFrame([], empty)
    return search(spark, index.df, books, queries, k)
