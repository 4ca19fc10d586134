"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint is the 64-bit majority of the XXH64 values of its word shingles. Fingerprints link at
RADIUS (3) or fewer differing bits. Copies share a fingerprint, so only distinct fingerprints are searched.

Search: 64 bits are cut into three segments (22, 21, 21 bits, padded to the 23 of the binary Golay code). The code is
perfect, so a segment has exactly one codeword within distance 3, its nearest; a segment one bit away has that codeword
within distance 4. A segment has 1 codeword within distance 4, or 6 when its nearest is at distance 3. By pigeonhole,
3 errors fall on the segments in one of three ways, and each way has keys of its own:
- two segments hold none: their bits are the key (42 or 43 bits);
- one holds none, another one at most: its bits and a codeword of the other (33 or 34 bits);
- each holds one: codewords of the first two and that half of the third which holds none (34 or 35 bits).
The left side of a pair takes the nearest codeword, the right side all near ones; with two codewords in a key, each side
takes the near ones of one segment. Keys that long stay selective when the corpus grows. Fingerprints that share a key are
compared by an exact bit count, so no link is lost and none is false. Few fingerprints under a key give their links as
pairs; more than SMALL are cut into parts, every two of which meet in a group that reports a spanning forest only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import columns, free_prefix, quoted, shuffle_partitions, spool, table
from gleanspark.llm.components import components
from gleanspark.llm.near_copies import near_duplicate_groups, row_hash
from gleanspark.llm.vectors import runs

SHINGLE, RADIUS, SEED = 3, 3, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # fixed value: generator polynomial of the [23, 12, 7] Golay code
SMALL, SIDE = 64, 4096  # fingerprints under a key that are paired in place; those of a part of a larger group
LEFT, RIGHT = 1, 2
_BLOCK = 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; 0 without words. Splits at ASCII white space, lower-cases A-Z only."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    ones, digest = np.zeros(64, np.int64), partial(xxhash.xxh64_intdigest, seed=SEED)
    for at in range(0, len(parts), _BLOCK):
        block = parts[at : at + _BLOCK]
        h = np.fromiter(map(digest, block), np.uint64, len(block))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(parts), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """`docs` with the fingerprint as a signed long. A null text has fingerprint 0, as one without words."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return docs.withColumn(out, of(quoted(text).cast("binary")))


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndromes of each of the 3 bytes of a word, error patterns of weight 4 or less by syndrome; -1 pads).

    A word's syndrome is its remainder by the generator polynomial.
    """

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    by_byte = np.array([[rest(v << s & (1 << 23) - 1) for v in range(256)] for s in (0, 8, 16)], np.int64)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            found[rest(e)].append(e)
    return by_byte, np.array([f + [-1] * (6 - len(f)) for f in found], np.int64)


def near_codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4, the nearest first; -1 pads. An index is the word's top 12 bits."""
    by_byte, errors = _golay()
    e = errors[by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, sides, key) of all keys of unsigned fingerprints; sides is LEFT, RIGHT or both."""
    bits = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [near_codewords(b) for b in bits]
    rows, sides, keys, kind = [], [], [], 0

    def add(key: np.ndarray, ok: np.ndarray, side: int) -> None:
        rows.append(np.nonzero(ok)[0])
        keys.append((np.int64(kind) << 45 | key)[ok])
        sides.append(np.full(len(rows[-1]), side, np.int32))

    for i, j in combinations(range(3), 2):
        add((bits[i] << 22 | bits[j])[:, None], np.ones((len(fps), 1), bool), LEFT | RIGHT)
        kind += 1
    for i, j in permutations(range(3), 2):
        add(bits[i][:, None] << 12 | near[j][:, :1], near[j][:, :1] >= 0, LEFT | RIGHT)
        add(bits[i][:, None] << 12 | near[j][:, 1:], near[j][:, 1:] >= 0, RIGHT)
        kind += 1
    width = SEGMENTS[2][1] // 2
    for half in (bits[2] >> width, bits[2] & (1 << width) - 1):
        part = half[:, None] << 24
        add(part | near[0][:, :1] << 12 | near[1][:, :1], (near[0][:, :1] >= 0) & (near[1][:, :1] >= 0), LEFT | RIGHT)
        add(part | near[0][:, 1:] << 12 | near[1][:, :1], near[0][:, 1:] >= 0, LEFT)
        add(part | near[0][:, :1] << 12 | near[1][:, 1:], near[1][:, 1:] >= 0, RIGHT)
        kind += 1
    return np.concatenate(rows), np.concatenate(sides), np.concatenate(keys)


def spanning_links(fps: np.ndarray) -> np.ndarray:
    """For each unsigned fingerprint of a group the first one of its component over links of RADIUS bits or fewer."""
    label = np.arange(len(fps))
    for at in range(0, len(fps), 512):
        i, j = np.nonzero(np.bitwise_count(fps[at : at + 512, None] ^ fps[None]) <= RADIUS)
        i += at
        i, j = i[i < j], j[i < j]
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for every fingerprint of a group but the first of its component; a group has one part or two."""
    for group in runs(batches, ["key", "low", "high"]):
        fp = group.column("fp").to_numpy()
        label = spanning_links(fp.view(np.uint64))
        rest = np.flatnonzero(label != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[rest]), pa.array(fp[label[rest]])], ["a", "b"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b), links that connect what links of RADIUS bits or fewer connect, of distinct fingerprints (column fp, one row each)."""

    def expand(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), _BLOCK):
                part = fp[at : at + _BLOCK]
                rows, sides, keys = fuzzy_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(sides), pa.array(keys), pa.array(part[rows])], ["side", "key", "fp"])

    keys = fps.select("fp").mapInArrow(expand, "side int, key long, fp long")
    same = Window.partitionBy("key")
    shared = keys.withColumns({"n": F.count("*").over(same), "sides": F.bit_or("side").over(same)}).where(f"n > 1 AND sides = {LEFT | RIGHT}")
    shared = spool(shared.select("key", "fp", "n"), "shared-keys")
    few = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("fp").alias("fps"))  # SMALL of them at most
    near = lambda x: F.filter("fps", lambda y: (x < y) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS))
    pairs = few.select(F.inline(F.flatten(F.transform("fps", lambda x: F.transform(near(x), lambda y: F.struct(x.alias("a"), y.alias("b")))))))
    many = shared.where(F.col("n") > SMALL).withColumn("parts", F.ceil(F.col("n") / SIDE).cast("int"))
    many = many.withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = ["key", "low", "high"]
    dealt = many.select("key", "fp", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high")).repartition(shuffle_partitions(fps.sparkSession), *group)
    forests = dealt.sortWithinPartitions(*group).mapInArrow(_forests, "a long, b long")
    return pairs.unionByName(forests).distinct()


def fingerprint_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; component_id is the smallest id reachable over links.

    Null texts and texts without words have fingerprint 0 and link like any other. A null id is never the smallest; a
    group of null ids only has a null component_id. Repeated rows are returned as often as given; long texts are read
    whole. Only the two columns named are read, so others may have any name. An empty table gives an empty one.
    """
    marked = spool(with_fingerprint(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))).select("doc_id", "fp"), "fingerprints")
    groups = spool(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    linked = components(fingerprint_links(groups)).join(groups, F.col("v") == F.col("fp"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("reached"))
    linked = spool(linked.select("fp", "root").join(smallest, "root").select("fp", "reached"), "linked")
    by_fp = groups.join(linked, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id"))
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each group of near-copies (five-word shingles, similarity 0.8 or more): one of its smallest id.

    Documents whose fingerprints link (RADIUS bits or fewer, by codewords) are candidates, and so are those that share a
    MinHash key; both are compared by their shingles.

    Where several rows of a group have that id, the one with the least hash of its text stays, once if it is repeated;
    rows of other groups that have the same id are not touched. Null texts and texts without words are near-copies of each
    other. Rows with a null id are compared like any other but always kept, as their id can't name them. Columns may have
    any name. An empty table gives an empty one.
    """
    p = free_prefix(docs)
    key, one = f"{p}row", f"{p}id"
    groups = near_duplicate_groups(docs, doc_id, text, fingerprint, fingerprint_links).where("doc_id = component_id")
    kept = groups.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    kept = spool(kept.select(F.col("first.doc_id").alias(one), F.col("first.row").alias(f"{p}of")), "kept")
    # The kept ids grow with the documents, so this join always shuffles; the window then finds its rows in place.
    rows = docs.where(quoted(doc_id).isNotNull()).select(*columns(docs), row_hash(doc_id, text).alias(key))
    mine = rows.join(kept.hint("merge"), (rows[doc_id] == kept[one]) & (rows[key] == kept[f"{p}of"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy(quoted(doc_id), key).orderBy(key))
    once = mine.withColumn(f"{p}nth", nth).where(F.col(f"{p}nth") == 1).select(*columns(docs))
    return once.unionByName(docs.where(quoted(doc_id).isNull()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; odd rows as in fingerprint_groups."""
    found = fingerprint_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE: dict[str, str] = {}
