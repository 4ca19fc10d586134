"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to unit length; cosine >= COSINE is then a distance of at most sqrt(2 - 2 * COSINE). Each hash table
quantises random Gaussian projections with WIDTH and a random shift; vectors that share all cells of a table share a
bucket, and pairs within a bucket are verified by their exact cosine. The number of hashes in a table grows with the
logarithm of the vectors under one label, so that a vector meets about STRANGERS unrelated ones a table at any size; the
number of tables then follows from RECALL, the chance that a pair at the threshold shares a bucket (`layout`). A pair at
cosine 0.97 does so with a chance of more than 0.999.

Equal vectors are merged first, and every distinct vector of a label gets a key of its own. Buckets of one vector are
dropped before any vector is moved. A bucket of more than SIDE vectors is cut at random into parts, and every two parts
meet in a group of their own, so no task holds more than two parts at a time. A group reports only a number of links for
each vector and a spanning forest, never its pairs. A pair that shares buckets in several tables is counted in the
first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import shuffle_partitions, spool, table
from gleanspark.llm.components import components
from gleanspark.llm.vectors import matrix, runs, unit, usable

COSINE = 0.93
RECALL, STRANGERS, WIDTH = 0.98, 4.0, 2.0
SIDE = 512
SEED = 6


def same_cell(distance: float, width: float = WIDTH) -> float:
    """The chance that two points at this distance fall into one cell of a random projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def layout(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(tables, hashes in each) for `n` vectors that are compared with one another; unrelated ones are taken as orthogonal."""
    near, far = same_cell(math.sqrt(2 - 2 * cosine)), same_cell(math.sqrt(2))
    hashes = max(1, math.ceil(math.log(max(n / STRANGERS, 1)) / -math.log(far)))
    return math.ceil(math.log(1 - recall) / math.log(1 - near**hashes)), hashes


def bucket_keys(vectors: np.ndarray, tables: int, hashes: int, width: float = WIDTH) -> np.ndarray:
    """(n, tables) 64-bit keys of unit vectors; equal cells give equal keys."""
    rng = np.random.default_rng([SEED, vectors.shape[1]])
    directions = rng.standard_normal((vectors.shape[1], tables * hashes))
    shifts = rng.uniform(0, width, tables * hashes)
    mixers = rng.integers(-(2**63), 2**63 - 1, tables * hashes) | 1
    cells = np.floor((vectors @ directions + shifts) / width).astype(np.int64)
    return (cells * mixers).reshape(len(vectors), tables, hashes).sum(2)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row of its component."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(tables: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(v, links, root) for the vectors of each group; a group has one part (a = b) or two."""
        for group in runs(batches, ["label", "dim", "t", "key", "a", "b"]):
            t, a, b = (group.column(c)[0].as_py() for c in ("t", "a", "b"))
            v = group.column("v").to_numpy()
            n = group.column("n").to_numpy()
            x = unit(matrix(group.column("embedding")))
            part = group.column("part").to_numpy()
            near = x @ x.T >= COSINE
            near &= (part[:, None] != part[None]) if a != b else ~np.eye(len(x), dtype=bool)
            if not near.any():
                continue
            root = _forest(near)
            if t:
                keys = bucket_keys(x, tables, hashes)[:, :t]
                i, j = np.nonzero(np.triu(near))
                for at in range(0, len(i), 1 << 18):
                    p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                    before = (keys[p] == keys[q]).any(1)
                    near[p[before], q[before]] = near[q[before], p[before]] = False
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(near @ n), pa.array(v[root])], ["v", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors`.

    Vectors link only with vectors of the same label and length. Rows with a null label or an unusable vector (null,
    empty, zero, with null or non-finite components) link with nothing: 0 links, their own component, kept. Rows that
    repeat an id, or have none, count each as a vector of their own, whether their vectors are equal or not; a null id is
    never the smallest of a component unless it is the only one. Other columns are not read, so their names don't
    matter. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", usable("embedding") & F.col("label").isNotNull())
    digest = {"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(SEED), "embedding", "label")}  # 128 bits name a vector of a label
    reps = rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    reps = spool(reps.withColumns({"dim": F.size("embedding"), "v": F.monotonically_increasing_id(), **digest}), "vectors")
    largest = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    tables, hashes = layout(largest)

    @F.arrow_udf("array<long>")
    def keys_of(given: pa.Array) -> pa.Array:
        sizes = given.value_lengths().to_numpy(zero_copy_only=False)
        keys = np.zeros((len(given), tables), np.int64)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            keys[at] = bucket_keys(unit(matrix(given.take(pa.array(at)))), tables, hashes)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.reshape(-1)))

    cells = spool(reps.select("v", "label", "dim", F.posexplode(keys_of("embedding")).alias("t", "key")), "cells")
    bucket = ["label", "dim", "t", "key"]
    crowded = cells.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / SIDE).cast("int")
    placed = cells.join(crowded, bucket).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("v", "t"), F.col("parts")).cast("int"))
    other = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = other.select("v", *bucket, "part", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"))
    groups = groups.join(reps.select("v", "n", "embedding"), "v")
    dealt = groups.repartition(shuffle_partitions(vectors.sparkSession), *bucket, "a", "b").sortWithinPartitions(*bucket, "a", "b")
    found = spool(dealt.mapInArrow(_verify(tables, hashes), "v long, links long, root long"), "vector-links")
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("v").alias("a"), F.col("root").alias("b"))).join(reps.select("v", "least"), "v")
    smallest = grouped.groupBy("root").agg(F.min("least").alias("reached"))
    reached = grouped.join(smallest, "root").select("v", "reached")
    facts = reps.select("h1", "h2", "v", "n", "least").join(links, "v", "left").join(reached, "v", "left")
    facts = spool(facts.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("reached", "least").alias("component_id")), "vector-facts")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rest = rows.where("ok").select("vec_id", *[c.alias(k) for k, c in digest.items()]).join(facts, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return rest.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector of `embeddings`; odd rows as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLE = {
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AS ok FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok
  WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id"""
}
