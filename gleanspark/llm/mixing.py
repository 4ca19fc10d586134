"""Mix documents to target weights of overlapping sources by a min-cost flow.

A document may belong to several sources. Documents are summed by membership pattern (the set of their sources); only
those sums, a row a pattern, reach the driver, where a min-cost flow routes words of patterns to the quotas of
sources. A pattern offers its words up to COPIES times; the n-th copy costs n squared, so repetition is spread before
it is stacked. Documents are then laid end to end per pattern in a seeded order and the routed words are cut from that
line: the copy number c of a document at position p covers [p + c * words of the pattern, ...). Positions come from
running totals over BINS slices of the seeded order, so no task sees a whole pattern.

Sources and patterns are bounded by the mixture's configuration (thousands), not by documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import quoted, spool, table

WEIGHTS = (5, 2, 1)
COPIES = 3
BINS = 4096
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(names) -> list:
    """By code point, null last."""
    return sorted(names, key=lambda s: (s is None, s or ""))


def share_out(sizes: dict, total: int, weights: Sequence[float] = WEIGHTS, copies: int = COPIES) -> dict:
    """Target words of each source: its weight's share of `total`, at most `copies` times its own.

    What the limit cuts off goes to the sources below it by weight, until none is above. Weights repeat over the
    sources in order of code points, null last. No words or no sources: all targets are 0.
    """
    names = in_order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    full: set = set()
    while len(full) < len(names):
        free = [s for s in names if s not in full]
        rest = total - sum(target[s] for s in full)
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] = rest * weight[s] / whole
        over = [s for s in free if target[s] > copies * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = float(copies * sizes[s])
        full.update(over)
    return target


def route(words: dict[str, int], members: dict[str, list], quota: dict, copies: int = COPIES) -> dict[str, dict]:
    """Words that each pattern gives to each source: a min-cost flow by shortest augmenting paths.

    Arcs: start -> pattern (one per copy, capacity its words, cost the copy number squared), pattern -> member source
    (cost 0), source -> end (capacity the quota). Integers throughout; ties go to the first in order, so reruns agree.
    """
    nodes = {("start",): 0, ("end",): 1}
    arcs: list[list] = []  # [to, capacity, cost]; arc i ^ 1 is the reverse
    out: list[list[int]] = [[], []]

    def node(*key) -> int:
        if key not in nodes:
            nodes[key] = len(nodes)
            out.append([])
        return nodes[key]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, k in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, c, k])
        return len(arcs) - 2

    given: dict[tuple, int] = {}
    for s in in_order(quota):
        arc(node("source", s), 1, int(quota[s]), 0)
    for p in sorted(words):
        for c in range(copies):
            arc(0, node("pattern", p), words[p], (c + 1) ** 2)
        for s in in_order(members[p]):
            given[p, s] = arc(node("pattern", p), node("source", s), copies * words[p], 0)
    height = [0] * len(out)
    while True:
        far: list = [None] * len(out)
        came = [-1] * len(out)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i in out[a]:
                b, capacity, cost = arcs[i]
                if capacity > 0 and (far[b] is None or d + cost + height[a] - height[b] < far[b]):
                    far[b], came[b] = d + cost + height[a] - height[b], i
                    heapq.heappush(heap, (far[b], b))
        if far[1] is None:
            break
        height = [h + d if d is not None else h for h, d in zip(height, far, strict=True)]
        path, b = [], 1
        while b:
            path.append(came[b])
            b = arcs[came[b] ^ 1][0]
        push = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= push
            arcs[i ^ 1][1] += push
    found: dict[str, dict] = {p: {} for p in words}
    for (p, s), i in given.items():
        found[p][s] = arcs[i ^ 1][1]
    return found


def plan_mix(sums: list[tuple[str, list, int]], weights: Sequence[float] = WEIGHTS, copies: int = COPIES) -> tuple[dict, dict, dict]:
    """(size by source, target by source, words by pattern and source) from (pattern, members, words) rows."""
    words = {p: n for p, _, n in sums}
    members = {p: m for p, m, _ in sums}
    size: dict = {}
    for p, m, n in sums:
        for s in m:
            size[s] = size.get(s, 0) + n
    target = share_out(size, sum(words.values()), weights, copies)
    return size, target, route(words, members, {s: round(t) for s, t in target.items()}, copies)


def mix(docs: DataFrame, sources: Column, size: Column, doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS, copies: int = COPIES, seed: int = SEED, tie: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, sources). Documents, one row per row of `docs`: doc_id, size, tie, pattern, sources, at (its place on the
    pattern's line), whole (the line's length), routed (words the pattern gives), taken (words). Sources: source,
    source_size, target.

    `sources` is an array of source names per document (nulls allowed, an empty or null array belongs nowhere and is
    never taken). A negative or null size counts as 0. Each source's words come within a word of its target wherever
    the flow can route them; a document gives at most `copies` times its size. Order is by a hash of seed, id, size
    and `tie` (a number that tells rows of one id apart, 0 if not given), then by these: reruns agree, and repeated rows
    are laid out one after the other. Texts may be of any length, as only sizes are read, and so are no other columns than
    those named. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    sized = docs.select(
        quoted(doc_id).alias("doc_id"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("size"),
        names.alias("sources"),
        F.coalesce(tie if tie is not None else F.lit(0), F.lit(0)).cast("long").alias("tie"),
    ).withColumns({"pattern": F.to_json("sources"), "u": F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "size", *([] if tie is None else ["tie"]))})
    sized = spool(sized.withColumn("bin", F.pmod("u", F.lit(BINS)).cast("int")), "sized")
    bins = sized.groupBy("pattern", "bin").agg(F.sum("size").alias("words"), F.first("sources").alias("sources"))
    bins = spool(bins, "bins")
    sums = [(r.pattern, list(r.sources), r.words) for r in bins.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("words").alias("words")).collect()]
    size_of, target, routed = plan_mix(sums, weights, copies)
    words = {p: n for p, _, n in sums}
    plan = [(p, words[p], sum(routed[p].values())) for p in words]
    before = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bins.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(spark.createDataFrame(plan, "pattern string, whole long, routed long"), "pattern")
        .select("pattern", "bin", "start", "whole", "routed")
    )
    inside = Window.partitionBy("pattern", "bin").orderBy("u", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("in_bin", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["pattern", "bin"])
    placed = placed.withColumn("at", F.col("start") + F.col("in_bin"))
    cut = [F.greatest(F.least(F.col("routed") - F.col("at") - c * F.col("whole"), F.col("size")), F.lit(0)) for c in range(copies)]
    facts = spark.createDataFrame([(s, size_of[s], target[s]) for s in in_order(target)], "source string, source_size long, target double")
    taken = placed.select("doc_id", "size", "tie", "pattern", "sources", "at", "whole", "routed", sum(cut[1:], cut[0]).cast("long").alias("taken"))
    return taken, facts


def whole_copies(docs: DataFrame, sources: Column, size: Column, doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS, copies: int = COPIES, seed: int = SEED, tie: Column | None = None) -> DataFrame:
    """(doc_id, size, tie, copies) for mixes of whole documents: a copy is taken if its middle lies in what is routed.

    A document without words is kept once where its place on the line is taken. Odd rows as in `mix`.
    """
    taken, _ = mix(docs, sources, size, doc_id, weights, copies, seed, tie)
    middle = lambda c: 2 * (F.col("at") + c * F.col("whole")) + F.col("size") < 2 * F.col("routed")
    times = sum((middle(c).cast("int") for c in range(1, copies)), middle(0).cast("int"))
    return taken.select("doc_id", "size", "tie", F.when(F.col("size") == 0, middle(0).cast("int")).otherwise(times).alias("copies"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and words taken of every document, each belonging to its one source; odd rows as in `mix`."""
    docs = table(spark, sf_dir, "documents")
    taken, facts = mix(docs, F.array("source"), n_words(F.col("text")))
    own = taken.withColumn("source", F.element_at("sources", 1))
    return own.join(facts, own["source"].eqNullSafe(facts["source"])).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mixing": op10_mixing}
ORACLE: dict[str, str] = {}
