"""Approximate nearest neighbours by collision counting.

Vectors, at unit length, are projected on ``PROJECTIONS`` random lines; a
line's index is the array of its projections, sorted.  A query looks at
windows centred at its own projections.  Windows grow step by step (virtual
rehashing: no new hash tables, only wider ranges of the same arrays); a
vector in the window of at least ``THRESHOLD`` lines collides often enough
and is verified by its exact cosine.  Growth stops when enough have been.

Equal vectors are indexed once, with the smallest of their ids (k + 1 are all
that a result can hold), so copies do not stand in for different vectors.
Vectors and queries are dealt into blocks of bounded size by a hash of their
(smallest) ids; every query block meets every row block, and the best of each
are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged

PROJECTIONS = 100
THRESHOLD = 90          # lines that must collide
VERIFY_SHARE = 0.15     # of a block's vectors to verify for a query, and
VERIFY_ROOT = 10.0      # times the square root of their number at least
GROWTH = 1.05           # factor of a window's width from one step to the next
PILOT = 512             # vectors from which the first width is guessed
ROW_BLOCK = 8192
QUERY_BLOCK = 2048
SEED = 7


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of vectors that can be compared: not null, without
    null or non-finite components, not zero.  An id's repeated rows count
    once (the smallest vector, if they differ); null ids take no part."""
    v = F.col("v")
    df = vectors.select(vectors[id_col].cast("long").alias("vec_id"),
                        vectors[vector_col].cast("array<double>").alias("v"))
    fine = df.where("vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x)"
                    " OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    return fine.groupBy("vec_id").agg(F.min(v).alias("vector"))


def distinct(vectors: DataFrame, ids: int) -> DataFrame:
    """``vector, vec_ids``: each different vector once, with the ``ids``
    smallest of its ids, sorted.  What many rows share is cut down where the
    rows lie, before they meet."""
    own = Window.partitionBy("hash", "vector").orderBy("vec_id")
    few = vectors.select("vec_id", "vector", F.xxhash64("vector").alias("hash")).withColumn(
        "place", F.row_number().over(own)).where(F.col("place") <= ids)
    return few.groupBy("hash", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")).select(
        "vector", "vec_ids")


class Block:
    """Index of one block: unit vectors and, per line, their sorted projections.
    ``copies`` are the sorted ids of each vector (not given: ``ids`` alone)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, seed: int, copies: list | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.copies = [ids[k:k + 1] if copies is None else np.asarray(copies[k]) for k in order]
        self.norms = _norms(self.vectors)
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        at = ((self.vectors / self.norms[:, None]) @ self.lines).T
        self.pilot = at[:, np.linspace(0, len(ids) - 1, min(PILOT, len(ids))).astype(int)]
        self.order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, self.order, axis=1)

    def _within(self, at: np.ndarray, half: float) -> tuple[list[int], list[int]]:
        """Per line, the range of the sorted array inside the query's window."""
        return ([int(line.searchsorted(x, "left")) for line, x in zip(self.sorted, at - half)],
                [int(line.searchsorted(x, "right")) for line, x in zip(self.sorted, at + half)])

    def candidates(self, unit: np.ndarray, threshold: int, wanted: int) -> np.ndarray:
        """Vectors whose collisions reach the threshold, once at least
        ``wanted`` do (or all vectors collide on every line).

        The first width is a guess: that at which the same share of a few
        spread-out vectors would collide often enough, less one step."""
        at, n = unit @ self.lines, len(self.ids)
        reach = np.sort(np.partition(np.abs(self.pilot - at[:, None]), threshold - 1, axis=0)[threshold - 1])
        half = max(float(reach[min(len(reach) - 1, wanted * len(reach) // n)]) / GROWTH, 1e-9)
        lo, hi = self._within(at, half)
        counts = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, lo, hi)]), minlength=n)
        while True:
            found = np.flatnonzero(counts >= threshold)
            if len(found) >= min(wanted, n) or all(b - a == n for a, b in zip(lo, hi)):
                return found
            half *= GROWTH
            wide_lo, wide_hi = self._within(at, half)  # only what the wider window adds
            rings = [o[c:d] for o, a, b, x, y in zip(self.order, wide_lo, wide_hi, lo, hi) for c, d in ((a, x), (y, b))]
            counts += np.bincount(np.concatenate(rings), minlength=n)
            lo, hi = wide_lo, wide_hi

    def nearest(self, query_id: int, vector: np.ndarray, k: int, threshold: int, share: float, root: float):
        norm = _norms(vector[None, :])[0]
        wanted = max(int(root * len(self.ids) ** 0.5), int(share * len(self.ids))) + 1
        found = self.candidates(vector / norm, threshold, wanted)
        score = cosine(self.vectors[found], self.norms[found], vector, norm)
        best = np.lexsort((self.ids[found], -score))[:k + 1]  # the query's own vector may have no other id
        held = [self.copies[i] for i in found[best]]
        ids, score = np.concatenate(held), np.repeat(score[best], [len(x) for x in held])
        ids, score = ids[ids != query_id], score[ids != query_id]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def cosine(vectors, norms, query, norm) -> np.ndarray:
    """Row by row, so that equal vectors have equal scores."""
    return (vectors * query).sum(axis=1) / (norms * norm)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = PROJECTIONS,
           threshold: int = THRESHOLD, share: float = VERIFY_SHARE, root: float = VERIFY_ROOT,
           row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each
    query, itself left out; ties to the smaller id.  Both inputs are
    ``vec_id, vector`` as :func:`clean` gives them.  Vectors of different
    lengths are not compared.  Queries without candidates have no rows."""
    different = staged(distinct(vectors, k + 1), "distinct-vectors")
    n = different.agg(F.count(F.lit(1))).first()[0]
    share = min(1.0, share * vectors.agg(F.count(F.lit(1))).first()[0] / max(1, n))  # as many as if copies were indexed
    m = queries.agg(F.count(F.lit(1))).first()[0]
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-m // query_block))
    block = lambda c, blocks, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = different.select(F.col("vec_ids")[0].alias("vec_id"), "vec_ids", "vector", F.size("vector").alias("dim")
                            ).withColumn("rb", block("vec_id", row_blocks, 1)).withColumn("qb", every(query_blocks))
    asked = queries.select("vec_id", "vector", F.size("vector").alias("dim"), block("vec_id", query_blocks, 2).alias("qb")
                           ).withColumn("rb", every(row_blocks))

    def meet(left, right):
        import pandas as pd

        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            own = Block(left["vec_id"].to_numpy(np.int64), np.stack(left["vector"].to_numpy()), projections, seed,
                        left["vec_ids"].tolist())
            for q, v in zip(right["vec_id"].tolist(), right["vector"]):
                ids, scores = own.nearest(q, np.asarray(v), k, threshold, share, root)
                out["query_id"] += [q] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = rows.groupBy("rb", "qb", "dim").cogroup(asked.groupBy("rb", "qb", "dim")).applyInPandas(
        meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id",
               vector_col: str = "embedding") -> DataFrame:
    """Search with every ``every``-th id as a query against all vectors."""
    fine = staged(clean(vectors, id_col, vector_col), "vectors")
    return search(fine, fine.where(F.col("vec_id") % every == 0), k)
