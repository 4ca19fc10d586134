"""Nearest neighbours by collision-counting hashing with query-centred windows and virtual rehashing.

Every vector, scaled to unit length (so the nearest by distance has the largest cosine), is projected on PROJECTIONS
random directions; each direction keeps its values sorted. A query opens a window around its own value on every
direction and widens all of them step by step (virtual rehashing: the arrays stay, only the bounds move, and only
newly covered entries are counted). A vector counted in at least COLLISIONS of the directions is a candidate and is
verified by its exact cosine. Widening stops when the k best found are no farther than the half-width of the windows, as
anything nearer would then have collided often enough with a chance of 0.95 or more; or when k + SPARE vectors and a
share CANDIDATES of the block are candidates; or when all are covered. Where neighbours stand out (copies, clusters) the
first rule ends a search after few candidates; among vectors without any structure only the second does.

Vectors are dealt into blocks of about BLOCK, each of which is indexed once; queries stream past every block, so a task holds
one block whatever the number of queries. Only while there are fewer blocks than tasks are blocks copied, for one part of the
queries each. The k best of each block are merged. A stated set of queries against all rows stays a product of the two, cut by
the candidates' share; what moves is each vector once and each query once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import quoted, shuffle_partitions, spool, table
from gleanspark.llm.vectors import matrix, pieces, unit, usable

NEAREST = 5
PROJECTIONS = 96
COLLISIONS = 0.6  # of the projections
CANDIDATES = 0.12  # of the vectors of a block
SPARE = 100  # candidates besides that share and the k asked for
HALVES = np.append(0.1 * 1.3 ** np.arange(14), np.inf)  # half-widths of the windows, round by round
BLOCK, QUERY_BLOCK = 16_384, 2048
ASKED_AT_ONCE = 256
EVERY = 50
SEED = 2


class SortedProjections:
    """The sorted arrays of one block of unit vectors."""

    def __init__(self, units: np.ndarray, projections: int = PROJECTIONS):
        self.directions = np.random.default_rng([SEED, units.shape[1]]).standard_normal((units.shape[1], projections))
        values = units @ self.directions
        self.order = np.ascontiguousarray(np.argsort(values, 0, kind="stable").T)
        self.values = np.ascontiguousarray(np.sort(values, 0).T)

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rounds, projections) bounds in the sorted arrays of ever wider windows; the last covers all."""
        centres = queries @ self.directions
        low, high = (np.empty((len(queries), len(HALVES), len(self.values)), np.int32) for _ in range(2))
        for j, v in enumerate(self.values):
            low[:, :, j] = np.searchsorted(v, centres[:, j, None] - HALVES)
            high[:, :, j] = np.searchsorted(v, centres[:, j, None] + HALVES, "right")
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray, share: float = COLLISIONS) -> Iterator[tuple[float, np.ndarray]]:
        """(half-width, rows that have newly reached the collision threshold), round by round."""
        m, n = self.values.shape
        need = int(np.ceil(share * m))
        counts, done, a, b = np.zeros(n, np.int64), np.zeros(n, bool), low[0], low[0]
        for half, to_a, to_b in zip(HALVES.tolist(), low, high, strict=True):
            new = [o[x:y] for o, x, y in zip(self.order, to_a.tolist(), a.tolist(), strict=True)]
            new += [o[x:y] for o, x, y in zip(self.order, b.tolist(), to_b.tolist(), strict=True)]
            counts += np.bincount(np.concatenate(new), minlength=n)
            a, b = to_a, to_b
            hits = np.flatnonzero((counts >= need) & ~done)
            done[hits] = True
            yield half, hits


def verified(index: SortedProjections, windows: tuple, k: int, least: int, cosine) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their cosines) of the candidates of a query; `cosine` verifies rows, and gives -inf for the query itself."""
    rows, cosines, found, best = [], [], 0, np.empty(0)
    for half, hits in index.candidates(*windows):
        cos = cosine(hits)
        rows.append(hits)
        cosines.append(cos)
        found += len(hits)
        best = np.sort(np.append(best, cos))[-k:]
        near = len(best) == k and 2 - 2 * best[0] <= half * half
        if near or found >= least:
            break
    return np.concatenate(rows), np.concatenate(cosines)


def _search(k: int, share: float):
    """(row, vec_id, score) of the k nearest in a block of vectors of every query that is dealt to it.

    A group's vectors come first and are indexed once; its queries then stream past, so a task holds one block whatever
    the number of queries.
    """

    def run(batches):
        group, held, index = None, [], None
        for (*now, asks), piece in pieces(batches, ["dim", "qb", "vb", "asks"]):
            if now != group:
                group, held, index = now, [], None
            if not asks:
                held.append(piece)
                continue
            if not held:
                continue
            if index is None:
                block = pa.Table.from_batches(held)
                ids, own, base = block.column("id").to_numpy(), block.column("row").to_numpy(), matrix(block.column("embedding"))
                norm, index = np.linalg.norm(base, axis=1), SortedProjections(unit(base))
                least = min(k + 1 + SPARE + int(share * len(base)), len(base))
            asked, rows = matrix(piece.column("embedding")), piece.column("row").to_numpy()
            for at in range(0, len(asked), ASKED_AT_ONCE):
                x, mine = asked[at : at + ASKED_AT_ONCE], rows[at : at + ASKED_AT_ONCE]
                sizes = np.linalg.norm(x, axis=1)
                low, high = index.windows(x / sizes[:, None])
                out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                for i, *windows in zip(range(len(x)), low, high, strict=True):

                    def cosine(hits: np.ndarray, i: int = i, x: np.ndarray = x, sizes: np.ndarray = sizes, mine: np.ndarray = mine) -> np.ndarray:
                        cos = (base[hits] * x[i]).sum(1) / (norm[hits] * sizes[i])
                        cos[own[hits] == mine[i]] = -np.inf
                        return cos

                    hits, cos = verified(index, windows, k, least, cosine)
                    best = np.lexsort((ids[hits], -cos))[:k]
                    best = best[np.isfinite(cos[best])]
                    out_q.append(np.full(len(best), mine[i]))
                    out_v.append(ids[hits[best]])
                    out_s.append(cos[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (out_q, out_v, out_s)], ["row", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, vec_id: str = "vec_id", embedding: str = "embedding", share: float = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where `is_query` holds its k nearest other rows by cosine.

    Nearest first, ties to the smaller id; fewer rows where there are fewer candidates. Rows with a null id or an
    unusable vector take no part; vectors of another length are no candidates. Rows that repeat an id are queries and
    candidates each on their own. Other columns are read by `is_query` only, so they may have any name. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    good = vectors.select(quoted(vec_id).cast("long").alias("id"), quoted(embedding).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = spool(good.where(usable("embedding") & F.col("id").isNotNull()).withColumns({"dim": F.size("embedding"), "row": F.monotonically_increasing_id()}), "vectors")
    counts = {r.is_query: r.n for r in good.groupBy("is_query").agg(F.count("*").alias("n")).collect()}
    blocks = -(-sum(counts.values()) // BLOCK)
    # Vectors are copied only as far as there are tasks without a block of their own.
    asked = min(-(-counts.get(True, 0) // QUERY_BLOCK), -(-shuffle_partitions(spark) // max(blocks, 1)))
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(max(n, 1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    columns = ["row", "id", "embedding", "dim", "asks", "qb", "vb"]
    rows = good.withColumns({"asks": F.lit(False), "vb": part(blocks, "block")}).withColumn("qb", every(asked)).select(*columns)
    queries = good.where("is_query").withColumns({"asks": F.lit(True), "qb": part(asked, "query")}).withColumn("vb", every(blocks)).select(*columns)
    dealt = queries.unionByName(rows).repartition(max(shuffle_partitions(spark), 1), "dim", "qb", "vb").sortWithinPartitions("dim", "qb", "vb", "asks")
    found = spool(dealt.mapInArrow(_search(k, share), "row long, vec_id long, score double"), "neighbours")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.join(good.where("is_query").select("row", F.col("id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector of `embeddings` whose id is divisible by 50, among all others; odd rows as in `nearest`."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op2_ann": op2_ann}
ORACLE: dict[str, str] = {}
