"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints on chosen features.

A document is described by counts of its words, lines and characters (STATISTICS); features are ratios of these, so that
length alone decides little. Trees are grown on histograms of a bounded sample of labelled documents. A feature with the
sign -1 may only lower the score as it rises: a split that would do otherwise is refused, and the values below a split
stay on their side of its middle. All trees are then flattened into arrays of nodes (feature, threshold, left, right,
value), and a batch of documents walks all of them level by level.

Counting and scoring happen inside the row: no shuffle, so neither hot keys nor group sizes matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import columns, free_prefix, held_out, quoted, spool, table

MIN_WORDS, MAX_REPEATED, KEEP = 50, 0.5, 0.5
SYMBOLS = b"#*$%&|<>"
MAX_ROWS = 20_000
ROUNDS, DEPTH, RATE, BINS, LEAST, RIDGE = 80, 4, 0.15, 64, 4.0, 1.0
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_open_lines", "n_upper", "n_digits", "n_marks", "n_short", "longest")
#: Features and the direction in which each may move the score; 0: any.
FEATURES = (
    ("log_words", 0),
    ("word_length", 0),
    ("symbols", -1),
    ("dup_lines", -1),
    ("repeated", -1),
    ("distinct", 0),
    ("line_words", 0),
    ("open_lines", -1),
    ("upper", -1),
    ("digits", -1),
    ("marks", -1),
    ("short", 0),
    ("longest", 0),
)
_SPACE, _INNER = b" \t\n\v\f\r", bytes(range(0x80, 0xC0))  # white space; bytes that continue a code point
_UPPER, _DIGITS, _MARKS, _ENDS = bytes(range(65, 91)), b"0123456789", b"!?", b".!?:;\"')"


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:  # so that three numbers don't fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, n = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = n[which] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    """STATISTICS of a UTF-8 text; all are 0 for a null text or one without words."""
    b = text or b""
    words = b.split()
    count = lambda chars: len(b) - len(b.translate(None, chars))
    if not words:
        return (0,) * len(STATISTICS)
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b.translate(None, _SPACE + _INNER)),
        count(SYMBOLS),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(set(words)),
        len(lines),
        sum(x.rstrip()[-1] not in _ENDS for x in lines),
        count(_UPPER),
        count(_DIGITS),
        count(_MARKS),
        sum(len(w) < 4 for w in words),
        max(map(len, words)),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """(n, FEATURES) from (n, STATISTICS)."""
    s = dict(zip(STATISTICS, stats.T.astype(float), strict=True))
    words, chars, lines = (np.maximum(s[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    made = {
        "log_words": np.log1p(s["n_words"]),
        "word_length": s["word_chars"] / words,
        "symbols": s["n_symbols"] / words,
        "dup_lines": s["n_dup_lines"] / lines,
        "repeated": s["n_repeat_words"] / words,
        "distinct": s["n_distinct"] / words,
        "line_words": s["n_words"] / lines,
        "open_lines": s["n_open_lines"] / lines,
        "upper": s["n_upper"] / chars,
        "digits": s["n_digits"] / chars,
        "marks": s["n_marks"] / words,
        "short": s["n_short"] / words,
        "longest": np.log1p(s["longest"]),
    }
    return np.stack([made[name] for name, _ in FEATURES], 1)


@dataclass(eq=False)
class Forest:
    """Trees as arrays of nodes; a leaf is its own child. `base` is the log odds before any tree."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int = DEPTH

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.base + (self.value[at].sum(1) if len(self.roots) else np.zeros(len(x))), -30, 30)))


class _Grower:
    """Grows one tree at a time on binned features, appending its nodes to the arrays of the forest."""

    def __init__(self, x: np.ndarray, signs: list[int]):
        self.signs = np.array(signs)
        self.cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
        self.bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(self.cuts, x.T, strict=True)], 1)
        self.nodes: list[list] = []  # feature, threshold, left, right, value
        self.roots: list[int] = []

    def tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Adds a tree fitted to gradients and curvatures; its value for each row."""
        out = np.zeros(len(g))
        self.roots.append(self._node(np.arange(len(g)), g, h, DEPTH, -np.inf, np.inf, out))
        return out

    def _node(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float, out: np.ndarray) -> int:
        me = len(self.nodes)
        value = lambda a, b: np.clip(-a / (b + RIDGE), low, high)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(value(total_g, total_h))
        self.nodes.append([0, np.inf, me, me, RATE * own])
        out[rows] = RATE * own
        best = (1e-6, None)
        if depth:
            loss = lambda a, b, v: a * v + 0.5 * (b + RIDGE) * v * v
            for f, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                b = self.bins[rows, f]
                lg, lh = (np.cumsum(np.bincount(b, w[rows], len(cuts) + 1))[:-1] for w in (g, h))
                rg, rh = total_g - lg, total_h - lh
                lv, rv = value(lg, lh), value(rg, rh)
                gain = loss(total_g, total_h, own) - loss(lg, lh, lv) - loss(rg, rh, rv)
                gain[(lh < LEAST) | (rh < LEAST) | (self.signs[f] * (rv - lv) < 0)] = -np.inf
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (f, i, float(lv[i]), float(rv[i])))
        if best[1]:
            f, i, lv, rv = best[1]
            middle, sign = (lv + rv) / 2, self.signs[f]
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(sign)]
            goes_left = self.bins[rows, f] <= i
            sides = [self._node(part, g, h, depth - 1, *b, out) for part, b in zip((rows[goes_left], rows[~goes_left]), bounds, strict=True)]
            self.nodes[me][:4] = [f, float(self.cuts[f][i]), *sides]
        return me

    def forest(self, base: float) -> Forest:
        kinds = (np.int32, float, np.int32, np.int32, float)
        arrays = [np.array([n[i] for n in self.nodes], k) for i, k in enumerate(kinds)]
        return Forest(base, np.array(self.roots, np.int32), *arrays)


def grow(x: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> Forest:
    """Trees boosted on the logistic loss; none, and the share of good ones as score, where a class is lacking."""
    share = (good.sum() + 0.5) / (len(good) + 1.0)
    base = float(np.log(share / (1 - share)))
    if not 0 < good.sum() < len(good):
        return Forest(base, *(np.zeros(0, k) for k in ("i4", "i4", "f8", "i4", "i4", "f8")))
    grower, line = _Grower(x, [s for _, s in FEATURES]), np.full(len(x), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-line))
        line = line + grower.tree(p - good, p * (1 - p))
    return grower.forest(base)


def _statistics_of(texts: pa.Array) -> np.ndarray:
    found = [statistics(x.as_py()) for x in texts]
    return np.array(found, np.int64).reshape(len(found), len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_ROWS) -> Forest:
    """Learn quality from at most `rows` labelled documents outside the held-out fold, chosen by a hash of the id.

    An id that is repeated teaches with one of its texts; one labelled twice is good only if all labels say so. Null ids
    and labels teach nothing, a null text is one without words. Empty tables give a forest without trees.
    """

    @F.arrow_udf("array<long>")
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(_statistics_of(texts).tolist(), pa.list_(pa.int64()))

    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `rows` ids
    one = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = spool(one.select("doc_id", "quality", counts(F.col("text").cast("binary")).alias("stats")), "quality-sample").orderBy("doc_id").toPandas()  # at most `rows`
    stats = np.array(got["stats"].tolist(), np.int64).reshape(len(got), len(STATISTICS))
    return grow(features(stats), (got["quality"].to_numpy() > 0).astype(float))


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    """True for texts of fewer than MIN_WORDS words, or of which more than half stand in repeated windows."""
    return (n_words < MIN_WORDS) | (n_repeat_words > MAX_REPEATED * n_words)


def with_quality(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """`docs` with STATISTICS (long), `score` (0 to 1), `base_failed` and `kept`; columns of these names are replaced.

    A null or empty text has no words and fails; long texts are counted whole. Every row is kept, repeated ones with
    equal verdicts, with its other columns of any name. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # ROUNDS trees of at most 2 ** (DEPTH + 1) nodes

    @F.arrow_udf(f"struct<{','.join(f'{s}:long' for s in STATISTICS)},score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        stats = _statistics_of(texts)
        return pa.StructArray.from_arrays([*(pa.array(c) for c in stats.T.copy()), pa.array(sent.value.score(features(stats)))], [*STATISTICS, "score"])

    p = free_prefix(docs)
    judged = docs.select(*columns(docs, *STATISTICS, "score", "base_failed", "kept"), judge(quoted(text).cast("binary")).alias(f"{p}j"))
    base = failed(F.col(f"{p}j.n_words"), F.col(f"{p}j.n_repeat_words"))
    return judged.select(*columns(judged, f"{p}j"), f"{p}j.*", base.alias("base_failed"), (~base & (F.col(f"{p}j.score") >= KEEP)).alias("kept"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document of `documents`; odd rows as in `fit` and `with_quality`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return with_quality(docs, forest).select("doc_id", *base, "base_failed", "kept", "score")


QUERIES = {"op11_quality": op11_quality}
ORACLE: dict[str, str] = {}
