"""Near-copies: documents whose sets of five-word shingles have a Jaccard similarity of SIMILAR (0.8) or more.

Candidates are the links of `simhash`: fingerprints at RADIUS bits or fewer, found by Golay codewords. At a similarity of 0.8
fingerprints differ in about ten bits, too many for that search, so MinHash adds candidates: BANDS (20) keys of ROWS (5)
minima each. Two sets of similarity 0.8 share a key with probability
0.9996. Equal sets are merged first. Each bucket links its members to the least of them; what is connected so is a
crowd, and every two sets of a crowd are compared exactly, whether or not they shared a bucket. A link is thus never
false, and is missed only where no chain of fingerprint links and buckets joins its two sets.

A crowd moves each set once. One of more than SIDE sets, or HASHES shingles, is cut at random into parts, and every two
parts meet in a group of their own, so no task holds more than two parts at a time. A group reports a spanning forest,
never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import quoted, shuffle_partitions, spool
from gleanspark.llm.components import components
from gleanspark.llm.vectors import runs

SHINGLE, SIMILAR = 5, (4, 5)  # 0.8 as a fraction, so that the comparison is exact
BANDS, ROWS, SEED = 20, 5, 5
SIDE, HASHES = 512, 1 << 20
_BLOCK = 1 << 10


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are those of `simhash.fingerprint`, and so are short texts."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.sort(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64, len(parts)))


@lru_cache(1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1), rng.integers(0, 2**63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, as signed longs; none of an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    odd, weights = _mixers()
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), _BLOCK):
        np.minimum(least, (odd * low[at : at + _BLOCK]).min(1), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * weights
    return keys.sum(1, dtype=np.uint64).view(np.int64)


def forest(sets: list[np.ndarray], part: np.ndarray, across: bool) -> np.ndarray:
    """For each set the first one of its component over links of SIMILAR or more; `across`: between different parts only."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    holders, ends = owner[order], np.cumsum(n)
    starts, label = ends - n, np.arange(len(sets))
    first = np.cumsum(size) - size
    for i in range(len(sets)):
        mine = which[first[i] : first[i] + size[i]]
        mine = mine[n[mine] > 1]
        length = n[mine]
        at = np.repeat(starts[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        near = SIMILAR[1] * both >= SIMILAR[0] * (size[i] + size - both)
        near[: i + 1] = False
        if across:
            near &= part != part[i]
        if near.any():
            joined = np.unique(label[np.append(np.nonzero(near)[0], i)])
            label[np.isin(label, joined)] = joined[0]
    return label


def _digest(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for every set of a group but the first of its component; a group has one part (a = b) or two."""
    for group in runs(batches, ["root", "low", "high"]):
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")]
        label = forest(sets, group.column("part").to_numpy(), group.column("low")[0].as_py() != group.column("high")[0].as_py())
        rest = np.nonzero(label != np.arange(len(sets)))[0]
        ids = group.column("set_id").combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rest)), ids.take(pa.array(label[rest]))], ["a", "b"])


def row_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(quoted(doc_id), quoted(text).cast("binary"))


def near_duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprint: Callable[[bytes | None], int] | None = None, fingerprint_links: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(doc_id, row, set_id, group, component_id): one row per input row; component_id is the smallest id reachable over links.

    `row` is a hash of id and text, `group` names the component even where ids repeat. Texts without words and null texts
    have the same, empty, set and link with each other; long texts are compared as a whole. A null id is never the
    smallest; a group of null ids only has a null component_id. Repeated rows are returned as often as given. Only the two
    columns named are read. An empty table gives an empty one. `fingerprint` (of a text) and `fingerprint_links` (a, b of
    distinct fingerprints in column fp) add candidates; `simhash` passes its own.
    """

    @F.arrow_udf("struct<set_id:binary,n:int,keys:array<long>,fp:long>")
    def marks(texts: pa.Array) -> pa.Array:
        ids, sizes, keys, fps = [], [], [], []
        for x in texts:
            found = shingles(x.as_py())
            fps.append(fingerprint(x.as_py()) if fingerprint else 0)
            ids.append(_digest(found))
            sizes.append(len(found))
            keys.append(band_keys(found))
        ends = np.cumsum([0] + [len(k) for k in keys])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(np.array(fps, np.uint64).view(np.int64))], ["set_id", "n", "keys", "fp"])

    @F.arrow_udf("binary")
    def hashes_of(texts: pa.Array, ids: pa.Array) -> pa.Array:
        """The set of a text as bytes; null if it isn't the set of that id."""
        found = [shingles(x.as_py()) for x in texts]
        return pa.array([f.tobytes() if _digest(f) == i.as_py() else None for f, i in zip(found, ids, strict=True)], pa.binary())

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("binary").alias("text"), row_hash(doc_id, text).alias("row"))
    marked = spool(rows.select("doc_id", "row", marks("text").alias("m")).select("doc_id", "row", "m.*"), "shingle-sets")
    sets = marked.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.min("fp").alias("fp"))
    sets = spool(sets, "distinct-sets")

    cells = sets.select("set_id", F.explode("keys").alias("key"))
    buckets = cells.groupBy("key").agg(F.min("set_id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    candidates = cells.join(buckets, "key").where("set_id <> centre").select(F.col("set_id").alias("a"), F.col("centre").alias("b"))
    if fingerprint_links:
        alike = spool(sets.groupBy("fp").agg(F.min("set_id").alias("first")), "set-fingerprints")
        same = sets.join(alike, "fp").where("set_id <> first").select(F.col("set_id").alias("a"), F.col("first").alias("b"))
        ends = lambda end: alike.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}"))
        near = fingerprint_links(alike.select("fp")).join(ends("a"), "a").join(ends("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        candidates = candidates.unionByName(same).unionByName(near)
    candidates = candidates.distinct()
    members = spool(components(candidates).join(sets, F.col("v") == F.col("set_id")).select("set_id", "root", "row", "n"), "crowds")
    parts = F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum("n") / HASHES)).cast("int")
    members = members.join(members.groupBy("root").agg(parts.alias("parts")), "root").withColumn("part", F.pmod(F.xxhash64("set_id"), "parts").cast("int"))
    wanted = spool(members.select("set_id", "root", "parts", "part", F.col("row").alias("_row")), "crowd-parts")

    # The optimizer would make the hashes once for the test and once more for the column, if it knew that they are the same.
    # The crowds grow with the documents, so this join always shuffles; the window then finds its rows in place.
    texts = rows.join(wanted.hint("merge"), rows["row"] == wanted["_row"])
    first = F.row_number().over(Window.partitionBy("row", "set_id").orderBy("row"))
    whole = texts.withColumn("_nth", first).where("_nth = 1").withColumn("hashes", hashes_of.asNondeterministic()("text", "set_id")).where("hashes IS NOT NULL")
    met = whole.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("set_id", "root", "part", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "hashes")
    group = ["root", "low", "high"]
    dealt = met.repartition(shuffle_partitions(docs.sparkSession), *group).sortWithinPartitions(*group)
    links = dealt.mapInArrow(_verify, "a binary, b binary")

    linked = components(links).join(sets, F.col("v") == F.col("set_id")).select("set_id", "root", "least")
    linked = spool(linked, "linked-sets")
    smallest = linked.groupBy("root").agg(F.min("least").alias("reached"))
    linked = linked.join(smallest, "root").select("set_id", "root", "reached")
    by_set = sets.join(linked, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("group"), F.coalesce("reached", "least").alias("component_id"))
    return marked.join(by_set, "set_id").select("doc_id", "row", "set_id", "group", "component_id")
