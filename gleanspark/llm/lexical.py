"""Ranked lexical search over an index of documents that recursive graph bisection has put in order.

Order: a bounded sample of documents is split in two again and again. Each split starts anywhere and swaps the documents
that gain most, where the cost of a half is the log-gap cost of its terms; what it has learned is kept as a weight for
every term and a cut. Every document of the corpus, in the sample or not, then walks these splits to its leaf, so documents
that share terms lie together. Leaves are cut into shards of about equal size, whatever the copies in them.

Index: one row a document, sorted by shard, with its terms and the integer gain of each, which is the part of the score that
doesn't depend on the query.

Search: for each term of a query a shard's bound is the largest gain that it holds, and the bound of the query in the shard
is the weighted sum. Shards are visited by falling bound, in rounds. After each round a query's k-th best score is known, and
it stops for good when no shard left has a bound as high; one with an equal bound is still visited, as a document in it may
win the tie by its doc_id. Scores are exact sums of integers, so the result is that of scoring every document.
Queries are handled in blocks of bounded size; tasks hold one batch of documents and one block.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import quoted, small_batches, spool, table

BEST = 20
DIMS = 1 << 14  # terms share weights by hash
SAMPLE, SAMPLE_TERMS = 4096, 512  # documents that the splits are learned from, and terms of each
DEPTH, SWEEPS = 6, 12
SHARD, SHARDS = 2048, 4096  # documents of a shard at least; shards of an index at most, besides one a leaf
QUERIES_AT_ONCE, ENTRIES = 512, 1 << 18  # queries of a block, and their terms
ROUNDS = (2, 8)  # shards a query visits in the first rounds; the last one takes all that are left
SEED = 13
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
_TEXTS = 512  # texts that a task holds as terms at a time


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; none of a null."""
    return (text or b"").translate(_FOLD).split()


def dims_of(found) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) & (DIMS - 1) for t in found), np.int32)


@dataclass
class Splits:
    """A binary tree of splits in level order; node i leads to 2i + 1 (left) and 2i + 2 (margin above the cut)."""

    depth: int
    weights: np.ndarray = field(repr=False)
    cuts: np.ndarray = field(repr=False)

    def leaves(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Leaf of each of n documents; `flat` are their dims, `owner` the document of each."""
        node = np.zeros(n, np.int64)
        for _ in range(self.depth):
            margin = np.bincount(owner, self.weights[node[owner], flat], n)
            node = 2 * node + 1 + (margin > self.cuts[node])
        return node - (2**self.depth - 1)


def _split(flat: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """(weight of each term for the right half, cut) that bisects n documents."""
    right = np.arange(n) >= (n + 1) // 2
    cost = lambda d, size: d * np.log2(size / (d + 1))
    for _ in range(SWEEPS):
        sizes = np.array([n - right.sum(), right.sum()], float)
        degree = [np.bincount(flat[right[owner] == side], minlength=DIMS).astype(float) for side in (False, True)]
        now = cost(degree[0], sizes[0]) + cost(degree[1], sizes[1])
        leave = [now - cost(np.maximum(degree[s] - 1, 0), sizes[s]) - cost(degree[1 - s] + 1, sizes[1 - s]) for s in (0, 1)]
        gain = np.bincount(owner, np.where(right[owner], leave[1][flat], leave[0][flat]), n)
        a, b = (np.flatnonzero(right == side) for side in (False, True))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = min(len(a), len(b))
        swaps = int((gain[a[:k]] + gain[b[:k]] > 1e-9).sum())
        if not swaps:
            break
        right[a[:swaps]], right[b[:swaps]] = True, False
    degree = [np.bincount(flat[right[owner] == side], minlength=DIMS).astype(float) for side in (False, True)]
    weight = np.log2((degree[1] + 1) / (right.sum() + 2)) - np.log2((degree[0] + 1) / (n - right.sum() + 2))
    weight = weight.astype(np.float32)
    margin = np.sort(np.bincount(owner, weight[flat], n))
    half = (n + 1) // 2
    return weight, float(margin[half - 1] + margin[half]) / 2


def bisect(documents: list[np.ndarray], depth: int) -> Splits:
    """Splits learned from the dims of a sample of documents."""
    nodes = 2**depth - 1
    found = Splits(depth, np.zeros((nodes, DIMS), np.float32), np.full(nodes, np.inf))
    held = {0: np.arange(len(documents))}
    for i in range(nodes):
        mine = held.pop(i, np.zeros(0, int))
        if len(mine) < 2:
            continue
        flat = np.concatenate([documents[d] for d in mine])
        owner = np.repeat(np.arange(len(mine)), [len(documents[d]) for d in mine])
        found.weights[i], found.cuts[i] = _split(flat, owner, len(mine))
        above = np.bincount(owner, found.weights[i][flat], len(mine)) > found.cuts[i]
        held[2 * i + 1], held[2 * i + 2] = mine[~above], mine[above]
    return found


@dataclass(frozen=True)
class Index:
    """`rows`: shard, doc_id, terms (between spaces), gains (packed), one a document that has terms; `n_docs` of them; `n_shards`
    numbers of shards."""

    rows: DataFrame
    n_docs: int
    n_shards: int


def _learn(docs: DataFrame, n_docs: int) -> tuple[Splits, np.ndarray]:
    """(splits, share of the sample in each leaf)."""

    @F.arrow_udf("array<int>")
    def some(texts: pa.Array) -> pa.Array:
        """Distinct dims of a text, at most SAMPLE_TERMS of them, drawn by the order of a hash."""
        found = (np.unique(dims_of(set(terms(x.as_py())))) for x in texts)
        return pa.array([np.sort(f[np.argsort(f * 40503 % 65521, kind="stable")[:SAMPLE_TERMS]]).tolist() for f in found], pa.list_(pa.int32()))

    depth = min(DEPTH, max(0, math.ceil(math.log2(max(n_docs, 1) / SHARD))))
    if not depth:
        return Splits(0, np.zeros((0, DIMS), np.float32), np.zeros(0)), np.ones(1)
    drawn = docs.where(F.pmod("h", F.lit(n_docs)) < SAMPLE).groupBy("h").agg(F.any_value("text").alias("text"))
    got = drawn.select("h", some("text").alias("dims")).orderBy("h").limit(2 * SAMPLE).toPandas()["dims"]  # SAMPLE rows expected
    sample = [np.array(d, np.int32) for d in got if len(d)]
    splits = bisect(sample, depth)
    flat = np.concatenate(sample) if sample else np.zeros(0, np.int32)
    leaves = splits.leaves(flat, np.repeat(np.arange(len(sample)), [len(s) for s in sample]), len(sample))
    return splits, np.bincount(leaves, minlength=2**depth) / max(len(sample), 1)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of every row of `docs` whose text has a term.

    A null text has none; a null id is indexed like any other; rows that repeat an id, and repeated rows, are documents on
    their own. Long texts are read whole. Only the two columns named are read. An empty table gives an empty index.
    """

    @F.arrow_udf("long")
    def n_terms(texts: pa.Array) -> pa.Array:
        return pa.array([len(terms(x.as_py())) for x in texts], pa.int64())

    spark = docs.sparkSession
    plain = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("binary").alias("text"))
    plain = plain.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    total = plain.select(n_terms("text").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, all_terms = total.docs, total.terms
    splits, share = _learn(plain, n_docs)
    sent = spark.sparkContext.broadcast(splits)  # 2 ** DEPTH - 1 splits of DIMS weights: 4 MB

    def posted(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):  # small parts, so that a worker's memory doesn't follow the batch
                part = batch.slice(at, _TEXTS)
                counted = [Counter(terms(x.as_py())) for x in part.column("text")]
                part = part.select(["doc_id", "h"]).filter(pa.array([bool(c) for c in counted]))
                counted = [c for c in counted if c]
                sizes = np.array([len(c) for c in counted], np.int64)
                owner = np.repeat(np.arange(len(counted)), sizes)
                tf = np.fromiter((v for c in counted for v in c.values()), np.int64)
                m = 75 + 25 * np.bincount(owner, tf, len(counted)).astype(np.int64) * n_docs // max(all_terms, 1)
                gains = 1_000_000_000 * tf // (1000 * tf + 12 * m[owner])
                leaves = sent.value.leaves(dims_of(t for c in counted for t in c), owner, len(counted))
                words = pa.array([b" ".join(c) for c in counted], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves, pa.int32()), words, packed(gains, np.append(0, np.cumsum(sizes)))], ["doc_id", "h", "leaf", "terms", "gains"])

    of_shard = max(SHARD, n_docs // SHARDS)
    slices = np.maximum(1, np.ceil(share * n_docs / of_shard)).astype(int)
    first = np.cumsum(slices) - slices
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("leaf") + 1)
    shard = (pick(first) + F.pmod("h", pick(slices))).cast("int")
    rows = plain.mapInArrow(posted, "doc_id long, h long, leaf int, terms binary, gains binary").select(shard.alias("shard"), "doc_id", "terms", "gains")
    return Index(spool(rows.repartition("shard").sortWithinPartitions("shard"), "lexical-index"), n_docs, int(slices.sum()))


def _shard_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """(shard, first row, end) for each run of rows of one shard."""
    shards = batch.column("shard").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)] if len(shards) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shards[a]), a, b


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of numbers below 2 ** 31 as one value each, little-endian 32-bit integers: flat columns cost tasks far less than arrays."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype("<i4")), pa.py_buffer(values.astype("<i4"))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows, where each row's begin and the last ones end)."""
    ends = np.append(0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))).astype(np.int64) // 4
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<i4"), ends


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that a worker's memory doesn't follow the size that they come in."""
    return (batch.slice(at, 4 * _TEXTS) for batch in batches for at in range(0, batch.num_rows, 4 * _TEXTS))


def _narrow(vocabulary):
    """Rows of the index with the terms of a block of queries only, as numbers."""

    def run(batches):
        for batch in _parts(batches):
            words = b" ".join(x.as_py() for x in batch.column("terms")).split(b" ")
            ids = np.fromiter(map(vocabulary.value.get, words, repeat(-1)), np.int32, len(words))
            gains, ends = unpacked(batch.column("gains"))
            known = ids >= 0
            ends = np.append(0, np.cumsum(known))[ends]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), packed(ids[known], ends), packed(gains[known], ends)], ["shard", "doc_id", "ids", "gains"])

    return run


def _bounds(batches):
    """(shard, id, largest gain, documents that hold the term) of each run of a shard."""
    for batch in batches:
        (ids, ends), (gains, _) = (unpacked(batch.column(c)) for c in ("ids", "gains"))
        for shard, a, b in _shard_runs(batch):
            mine, gain = ids[ends[a] : ends[b]], gains[ends[a] : ends[b]]
            if len(mine):
                order = np.argsort(mine, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(mine[order]) > 0))
                top = np.maximum.reduceat(gain[order], starts).astype(np.int64)
                n = np.diff(np.append(starts, len(mine)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), shard, np.int32)), pa.array(mine[order][starts]), pa.array(top), pa.array(n)], ["shard", "id", "top", "n"])


@dataclass
class _Block:
    """A block of queries: ids and weights of the terms of each, as numbers of the vocabulary."""

    ids: list[np.ndarray]
    weights: list[np.ndarray]

    def __post_init__(self):
        self.exact = [int(w.sum()) * 1_000_000 < 2**53 for w in self.weights]  # sums of doubles are exact

    def scores(self, q: int, ids: np.ndarray, owner: np.ndarray, gains: np.ndarray, n: int) -> np.ndarray:
        """Score of n documents from their postings in order of ids."""
        low, high = np.searchsorted(ids, self.ids[q]), np.searchsorted(ids, self.ids[q], "right")
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        parts = np.repeat(self.weights[q], size) * gains[at].astype(np.int64)
        if self.exact[q]:
            return np.bincount(owner[at], parts, n).astype(np.int64)
        out = np.zeros(n, np.int64)
        np.add.at(out, owner[at], parts)
        return out


def _visit(block, visits, least: np.ndarray, k: int):
    """(query, doc_id, score) of the k best documents of each run of a shard for each query that visits it."""

    def run(batches):
        for batch in batches:
            (ids, ends), (gains, _) = (unpacked(batch.column(c)) for c in ("ids", "gains"))
            nameless = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            names = pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)
            queries, rows, scores = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for shard, a, b in _shard_runs(batch):
                if shard not in visits.value:
                    continue
                mine = slice(int(ends[a]), int(ends[b]))
                owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                order = np.argsort(ids[mine], kind="stable")
                held, owner, gain = ids[mine][order], owner[order], gains[mine][order]
                for q in visits.value[shard].tolist():
                    got = block.value.scores(q, held, owner, gain, b - a)
                    good = np.flatnonzero(got >= max(int(least[q]), 1))
                    if len(good) > k:
                        good = good[got[good] >= np.partition(got[good], -k)[-k]]
                        good = good[np.lexsort((names[a + good], nameless[a + good], -got[good]))[:k]]
                    queries.append(np.full(len(good), q, np.int32))
                    rows.append(a + good)
                    scores.append(got[good])
            at = np.concatenate(rows)
            found = pa.array(names[at], mask=nameless[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries)), found, pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: Index, entries: list, k: int) -> DataFrame:
    """(query, doc_id, score, rank) for a block of queries, given as (query, term, times) with queries numbered from 0."""
    spark = index.rows.sparkSession
    words = sorted({bytes(t) for _, t, _ in entries})
    number = {t: i for i, t in enumerate(words)}
    n_queries = max(q for q, _, _ in entries) + 1
    sent = spark.sparkContext.broadcast(number)  # ENTRIES terms or so
    narrow = spool(index.rows.mapInArrow(_narrow(sent), "shard int, doc_id long, ids binary, gains binary"), "block-postings")
    bounds = narrow.mapInArrow(_bounds, "shard int, id int, top long, n long").groupBy("shard", "id").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    bounds = spool(bounds, "block-bounds")
    df = {r.id: r.n for r in bounds.groupBy("id").agg(F.sum("n").alias("n")).collect()}  # one a term of the block
    weight = [math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))]
    mine: list[list] = [[] for _ in range(n_queries)]
    for q, t, times in entries:
        if number[t] in df:
            mine[q].append((number[t], weight[number[t]] * times))
    block = _Block(*([np.array([x[i] for x in sorted(m)], np.int64) for m in mine] for i in (0, 1)))
    weights = spark.createDataFrame([(q, i, w) for q, m in enumerate(mine) for i, w in m], "query int, id int, weight long")
    sums = bounds.join(weights, "id").groupBy("query", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    got = sums.toPandas()  # QUERIES_AT_ONCE or so by the shards of the index
    bound = np.zeros((n_queries, index.n_shards), np.int64)
    bound[got["query"], got["shard"]] = got["bound"]

    sent, best = spark.sparkContext.broadcast(block), None
    left, least = bound > 0, np.zeros(n_queries, np.int64)
    for take in (*ROUNDS, index.n_shards):
        left &= bound >= least[:, None]
        now = np.zeros_like(left)
        nearest = np.argsort(np.where(left, -bound, 1), axis=1, kind="stable")[:, :take]
        np.put_along_axis(now, nearest, np.take_along_axis(left, nearest, 1), 1)
        if not now.any():
            break
        left &= ~now
        visits = spark.sparkContext.broadcast({int(s): np.flatnonzero(now[:, s]) for s in np.flatnonzero(now.any(0))})
        visited = narrow.where(F.col("shard").isin(list(visits.value))) if len(visits.value) < index.n_shards else narrow
        found = visited.mapInArrow(_visit(sent, visits, least, k), "query int, doc_id long, score long")
        best = spool(_best(found if best is None else found.unionByName(best.drop("rank")), k), "block-best")
        for r in best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).collect():  # one a query
            least[r["query"]] = r.score
    return best if best is not None else spark.createDataFrame([], "query int, doc_id long, score long, rank int")


def search(index: Index, queries: DataFrame, k: int = BEST, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of `queries` the k documents of highest score above 0.

    Equal scores by ascending id, a null id last; a row may have fewer, or none. A null or empty text has no terms and finds
    nothing; a long one is read whole; rows that repeat an item are queries on their own. Only the two columns named are
    read. Empty tables give an empty result.
    """

    @F.arrow_udf("array<struct<term:binary,times:long>>")
    def counted(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("term", pa.binary()), ("times", pa.int64())]))
        return pa.array([[{"term": t, "times": n} for t, n in Counter(terms(x.as_py())).items()] for x in texts], kind)

    spark = queries.sparkSession
    asked = queries.select(quoted(item_id).cast("long").alias("item_id"), counted(quoted(text).cast("binary")).alias("terms")).where(F.size("terms") > 0)
    asked = spool(asked.withColumn("row", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("entries")).first()
    blocks, found = max(-(-size.n // QUERIES_AT_ONCE), -(-size.entries // ENTRIES)), []
    for b in range(blocks if index.n_docs else 0):
        got = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()  # about QUERIES_AT_ONCE rows with ENTRIES terms
        if got:
            names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(got)], "query int, item_id long")
            best = _search_block(index, [(q, bytes(x.term), x.times) for q, r in enumerate(got) for x in r.terms], k)
            found.append(spool(best.join(names, "query").select("item_id", "rank", "doc_id", "score"), "found"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in found:
        out = out.unionByName(part)
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of `documents` for each item of `benchmark`; odd rows as in `build_index` and `search`."""
    with small_batches(spark):  # all that reads texts or postings is written before the result is returned
        return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical": op13_lexical}
_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = {
    "op13_lexical": f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
found AS (SELECT r, doc_id, t, count(*) AS tf FROM (SELECT r, doc_id, unnest({_TERMS_SQL}) AS t FROM numbered) GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM found GROUP BY r),
stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM found, stats GROUP BY t),
asked AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS_SQL}) AS t FROM benchmark) GROUP BY ALL),
gains AS (SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)) AS gain FROM found JOIN lengths USING (r), stats),
scored AS (SELECT item_id, r, doc_id, sum(q * w * gain)::BIGINT AS score FROM asked JOIN weights USING (t) JOIN gains USING (t) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
}
