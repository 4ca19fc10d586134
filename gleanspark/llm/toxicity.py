"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

The kernel compares strings by their letter subsequences of length 3: one that spans n characters weighs DECAY ** n, so a
gap, an inserted character or a space costs weight but loses no match. A string's vector over the 28 ** 3 letter triples
is scaled by the square root of the sum of its squared weights. Texts are cut into sentences, and these into units (what
stands between white space, long ones cut again); a window is one of SIZES units in a row within a sentence.

The machine is trained on the sentences of labelled documents. Only the document's label is known, so a toxic document is
a bag of sentences of which one at least is toxic (multiple-instance learning): the first scores are the log odds of
triples between sentences of toxic and of clean documents; then, ROUNDS times, the highest window of every toxic document
stands for it, the highest windows of clean documents and others drawn by hash stand against them, and a squared-hinge
machine on their Nystrom features is fitted anew. As every kernel value is an inner product over triples, landmarks,
whitening and weights fold into one table of triple weights. Running sums of that table along a text give the margin of
every window in it at once; a document's margin is its highest, and a logistic curve fitted on the labelled sample turns
margin and length into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import free_prefix, held_out, quoted, spool, table

MAX_ROWS = 20_000
THRESHOLD = 0.3
DECAY, SPAN = 0.6, 8
SYMBOLS = 28  # 0: not a letter (only a gap), 1-26: a-z, 27: any other letter
UNIT = 24  # characters of a unit at most
SIZES = (1, 2, 5)  # units of a window
PART = 1 << 16  # characters that are read together
ALL = 1 << 62  # a place behind every text
ROUNDS, POSITIVES, NEGATIVES, LANDMARKS = 3, 4000, 12_000, 256
SMOOTH = 20.0  # added to the weight of each triple in the first log odds
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SPACE, _STOPS = (9, 10, 11, 12, 13, 32), (10, 13, 33, 46, 63)
_ENDS = ("\n", "\r", *(stop + space for stop in "!.?" for space in " \t\v\f"))  # places that no window crosses
_LONG_SPACE, _LONG_BREAK = re.compile(r"[ \t\v\f]{65,}"), re.compile(r"[\r\n]{65,}")


def _symbol_table() -> np.ndarray:
    found = np.zeros(0x250, np.int32)
    for c in range(0x250):
        s = LOOK_ALIKE.get(chr(c), chr(c))
        found[c] = ord(s) - 96 if "a" <= s <= "z" else 27 if s.isalpha() else 0
    return found


_SYMBOL = _symbol_table()


def symbols(points: np.ndarray) -> np.ndarray:
    return np.where(points < len(_SYMBOL), _SYMBOL[np.minimum(points, len(_SYMBOL) - 1)], np.int32(27))


def spans(s: np.ndarray) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """(k, numbers of the triples that end k characters after their start, start by start, for each middle between)."""
    pairs = {j: (s[: max(len(s) - j, 0)] * SYMBOLS + s[j:]) * SYMBOLS for j in range(1, SPAN - 1)}
    for k in range(2, min(SPAN, len(s))):
        yield k, (pairs[j][: len(s) - k] + s[k:] for j in range(1, k))


_ANY = np.arange(SYMBOLS**3)  # numbers of triples; one that has a gap as a letter is none
_WHOLE = ((_ANY % SYMBOLS > 0) & (_ANY // SYMBOLS % SYMBOLS > 0) & (_ANY // SYMBOLS**2 > 0)).astype(np.float32)


class Text:
    """Several texts end to end, as symbols, with their units; `windows` are (first, last) characters and their text's number."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        self.text = "\n".join(lowered) + "\n"
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.symbols = symbols(points)
        blank = np.isin(points, _SPACE)
        at = np.arange(len(points))
        begins = ~blank & np.concatenate([[True], blank[:-1]])
        run = np.maximum.accumulate(np.where(begins, at, 0))
        begins |= ~blank & ((at - run) % UNIT == 0)
        self.starts = np.flatnonzero(begins)
        ends = ~blank & np.concatenate([blank[1:] | begins[1:], [True]])
        self.ends = np.flatnonzero(ends) + 1
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
        self.owner = np.searchsorted(np.cumsum(sizes), self.starts, "right")
        stop = np.concatenate([[0], np.cumsum(np.isin(points, _STOPS))])  # a window may end with a stop, but not run over one
        self.sentence = stop[self.starts]
        self.last_stop = stop[np.maximum(self.ends - 1, 0)]

    def windows(self, before: int = ALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that begin at a place less than `before`."""
        first, last, owner = [], [], []
        for m in SIZES:
            n = len(self.starts) - m + 1
            if n <= 0:
                break
            same = self.starts[:n] < before
            if m > 1:
                same &= (self.sentence[:n] == self.last_stop[m - 1 :]) & (self.owner[:n] == self.owner[m - 1 :])
            first.append(self.starts[:n][same])
            last.append(self.ends[m - 1 :][same])
            owner.append(self.owner[:n][same])
        return tuple(np.concatenate(a) if a else np.zeros(0, np.int64) for a in (first, last, owner))

    def margins(self, weights: np.ndarray, bias: float, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Margin of each window under a table of triple weights; that of a window without triples is -1."""
        raw, energy = np.zeros(len(first)), np.zeros(len(first))
        letter = self.symbols > 0
        so_far = np.cumsum(letter)
        for k, ids in spans(self.symbols):
            w, n = DECAY ** (k + 1), len(self.symbols) - k
            begin, end = np.minimum(first, n), np.minimum(np.maximum(last - k, first), n)
            weight = sum(weights.take(i) for i in ids)
            number = np.where(letter[:n] & letter[k:], so_far[k - 1 : -1] - so_far[:n], 0)  # letters between the outer two
            for values, total, scale in ((weight, raw, w), (number, energy, w * w)):
                sums = np.zeros(n + 1)
                np.cumsum(values, out=sums[1:])
                total += scale * (sums.take(end) - sums.take(begin))
        return np.where(energy > 1e-12, raw / np.sqrt(np.maximum(energy, 1e-12)) + bias, -1.0)


def features(strings: list[str]) -> np.ndarray:
    """(n, 28 ** 3) scaled vectors over triples; meant for landmarks and training windows only."""
    out = np.zeros((len(strings), SYMBOLS**3), np.float32)
    for row, x in zip(out, strings, strict=True):
        energy = 0.0
        for k, ids in spans(symbols(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32))):
            ids = np.concatenate(list(ids))
            ids = ids[_WHOLE[ids] > 0]
            np.add.at(row, ids, DECAY ** (k + 1))
            energy += len(ids) * DECAY ** (2 * k + 2)
        row /= np.sqrt(max(energy, 1e-12))
    return out


def pieces(text: str) -> Iterator[tuple[str, int]]:
    """A long lower-case text in pieces of PART characters at most, each with the place from which windows are the next one's.

    A piece ends behind a stop, which no window crosses. Where there is none, the next piece begins four whole units before
    the end, so that every window lies in the piece that holds its first unit. Long white space is cut to what no
    triple spans.
    """
    text = _LONG_BREAK.sub("\n" * 64, _LONG_SPACE.sub(" " * 64, text))
    at = 0
    while len(text) - at > PART:
        cut = max((text.rfind(s, at, at + PART) for s in _ENDS), default=-1)
        if cut >= at:
            yield text[at : cut + 1], ALL
            at = cut + 1
        else:
            chunk = text[at : at + PART]
            after = int(Text([chunk]).starts[-max(SIZES)])
            yield chunk, after
            at += after
    yield text[at:], ALL


def parts(texts: list[str]) -> Iterator[tuple[list[int], Text, int]]:
    """(numbers of texts, these texts or a piece of one, place of the first window that isn't its own), PART characters or so at a time."""
    held: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) > PART:
            yield from (([i], Text([x]), after) for x, after in pieces(t.lower()))
            continue
        if held and size + len(t) > PART:
            yield held, Text([texts[j] for j in held]), ALL
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        yield held, Text([texts[j] for j in held]), ALL


@dataclass(eq=False)
class Model:
    """Triple weights, the bias of a window's margin, and the logistic curve over a document's margin and the log of its windows."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    longer: float = 0.0
    shift: float = 0.0

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(margin of each text's highest window, number of its windows); -1 for a text without windows."""
        texts = [t or "" for t in texts]
        count = np.zeros(len(texts), np.int64)
        high = np.full(len(texts), -np.inf)
        for numbers, t, before in parts(texts):
            first, last, owner = t.windows(before)
            if len(first):
                own = np.array(numbers)[owner]
                np.maximum.at(high, own, t.margins(self.table, self.bias, first, last))
                count += np.bincount(own, minlength=len(texts))
        return np.where(np.isinf(high), -1.0, high), count

    def highest(self, texts: list[str], seed: int) -> list[tuple[str, str]]:
        """(highest window, a window drawn by hash) of each text that has any."""
        found: dict[int, tuple] = {}
        for numbers, t, before in parts(texts):
            first, last, owner = t.windows(before)
            margins = t.margins(self.table, self.bias, first, last)
            order = np.lexsort((first, -margins, owner))
            own = owner[order]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
            ends = [*heads[1:], len(own)] if len(own) else []
            for h, e in zip(heads, ends, strict=True):
                other = order[h + (int(first[order[h]]) * 2654435761 + seed) % (e - h)]
                text, margin = numbers[own[h]], float(margins[order[h]])
                if text not in found or margin > found[text][0]:
                    found[text] = (margin, *(t.text[first[w] : last[w]] for w in (order[h], other)))
        return [x[1:] for _, x in sorted(found.items())]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        inside = y * (x @ w) < 1
        a = x[inside] * (c * weight[inside])[:, None]
        step = np.linalg.solve(np.eye(len(w)) + a.T @ x[inside], w - a.T @ (y[inside] - x[inside] @ w))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_windows(positive: list[str], negative: list[str]) -> Model:
    """The machine between two lists of windows, each class with half of the weight."""
    half = LANDMARKS // 2
    f = features(list(dict.fromkeys(positive))[:half] + list(dict.fromkeys(negative))[:half]).astype(np.float64)
    values, vectors = np.linalg.eigh(f @ f.T)
    keep = values > 1e-6 * values.max()
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).T @ f  # Nystrom map: scaled vector -> whitened kernel values
    strings, y = positive + negative, np.repeat([1.0, -1.0], [len(positive), len(negative)])
    narrow = whiten.T.astype(np.float32)
    x = np.vstack([features(strings[i : i + 1000]) @ narrow for i in range(0, len(strings), 1000)]).astype(np.float64)
    balance = np.where(y > 0, 0.5 * len(y) / len(positive), 0.5 * len(y) / len(negative)) / 100
    w = _svm(np.hstack([x, np.ones((len(x), 1))]), y, balance)
    return Model((w[:-1] @ whiten).astype(np.float32), float(w[-1]))


def _logistic(x: np.ndarray, label: np.ndarray) -> list[float]:
    """Weights of a logistic curve, the last one of the constant 1 in x."""
    ridge = np.append(np.full(x.shape[1] - 1, 1e-2), 1e-4)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - label) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def sample(docs: DataFrame, labels: DataFrame, rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most `rows` labelled documents that aren't held out, in order of a hash of doc_id.

    One row for each id however often `docs` repeats it: the text whose hash is least, so the bound holds for the rows too.
    """
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "toxic")


def _first_odds(labelled: DataFrame) -> np.ndarray:
    """Log odds of each triple between sentences of toxic and of clean documents."""

    def count(batches):
        total = np.zeros((2, SYMBOLS**3))
        for batch in batches:
            texts, toxic = batch.column("text").to_pylist(), np.array(batch.column("toxic").to_pylist()) > 0
            for t in (0, 1):
                mine = [x for x, y in zip(texts, toxic, strict=True) if y == t]
                for _, piece, _ in parts(mine):
                    for k, ids in spans(piece.symbols):
                        total[t] += sum(DECAY ** (k + 1) * np.bincount(i, minlength=SYMBOLS**3) for i in ids)
        yield pa.RecordBatch.from_arrays([pa.array(_ANY), pa.array(total[1]), pa.array(total[0])], ["triple", "toxic", "clean"])

    made = labelled.select("text", "toxic").mapInArrow(count, "triple long, toxic double, clean double")
    sums = made.groupBy("triple").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()  # 28 ** 3 rows
    toxic, clean = (np.zeros(SYMBOLS**3) for _ in range(2))
    toxic[sums["triple"]], clean[sums["triple"]] = sums["toxic"], sums["clean"]
    share = lambda x: (x + SMOOTH * DECAY**3) / (x.sum() + 1.0)
    return (_WHOLE * np.log(share(toxic) / share(clean))).astype(np.float32)


def _windows(labelled: DataFrame, model: Model, seed: int) -> tuple[list[str], list[str]]:
    """(highest windows of toxic documents, highest and drawn windows of clean ones), each at most a document's two."""

    def run(batches):
        for batch in batches:
            for toxic in (True, False):
                mine = [x for x, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True) if (y > 0) == toxic]
                for high, other in model.highest(mine, seed):
                    yield pa.RecordBatch.from_arrays([pa.array([toxic]), pa.array([high]), pa.array([other])], ["toxic", "high", "other"])

    found = labelled.select("text", "toxic").mapInArrow(run, "toxic boolean, high string, other string")
    rows = found.select("toxic", "high", "other", F.xxhash64(F.lit(seed), "high", "other").alias("h")).toPandas().sort_values(["h", "high", "other"])  # at most MAX_ROWS
    toxic, clean = rows[rows["toxic"]], rows[~rows["toxic"]]
    half = NEGATIVES // 2
    return toxic["high"].tolist()[:POSITIVES], [x for pair in zip(clean["high"].tolist()[:half], clean["other"].tolist()[:half], strict=True) for x in pair]


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_ROWS) -> Model:
    """Learn from the sentences of at most `rows` labelled documents outside the held-out fold.

    Documents without a label, labels without a document, and null ids or labels teach nothing; a null text is one
    without sentences; a document labelled twice is toxic if one label says so, and an id that is repeated teaches with one
    of its texts. Long texts are read whole. If toxic or clean documents are lacking, tables empty among others, the score is the
    share of toxic ones. Other columns may have any name.
    """
    labelled = spool(sample(docs, labels, rows), "toxicity-sample").where("toxic IS NOT NULL")
    counts = labelled.groupBy("toxic").count().collect()
    nt, nc = (sum(r["count"] for r in counts if (r["toxic"] > 0) == t) for t in (True, False))
    share = (nt + 0.5) / (nt + nc + 1.0)
    flat = Model(np.zeros(SYMBOLS**3, np.float32), 0.0, 0.0, 0.0, float(np.log(share / (1 - share))))
    if not nt or not nc:
        return flat
    model, kept = Model(_first_odds(labelled), 0.0), []
    for n in range(ROUNDS):
        positive, negative = _windows(labelled, model, n)
        if not positive or not negative:
            return flat
        kept = list(dict.fromkeys(negative + kept))[:NEGATIVES]
        model = fit_windows(positive, kept)
    got = with_margin(labelled, model).select("margin.*", "toxic").toPandas()  # at most `rows` pairs of numbers
    x = np.stack([got["margin"].to_numpy(float), np.log1p(got["windows"].to_numpy(float)), np.ones(len(got))], 1)
    model.slope, model.longer, model.shift = _logistic(x, (got["toxic"] > 0).to_numpy(float))
    return model


def with_margin(docs: DataFrame, model: Model, text: str = "text", out: str = "margin") -> DataFrame:
    """`docs` with (margin, windows) of each text in `out`; a column of that name is replaced, all others stay whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    @F.arrow_udf("struct<margin:double,windows:long>")
    def of(texts: pa.Array) -> pa.Array:
        best, count = sent.value.of_texts(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(best), pa.array(count)], ["margin", "windows"])

    return docs.withColumn(out, of(quoted(text)))


def score_of(margin: str, model: Model) -> Column:
    line = F.col(f"{margin}.margin") * model.slope + F.log1p(f"{margin}.windows") * model.longer + model.shift
    return 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 if score >= THRESHOLD); columns of these names are replaced.

    A null text counts as empty and has a score too; long texts are read whole. Every row is kept, repeated ones with the
    same score, with its other columns of any name. An empty table gives an empty one.
    """
    margin = f"{free_prefix(docs)}margin"
    scored = with_margin(docs, model, text, margin).withColumn("score", score_of(margin, model)).drop(margin)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document of `documents`; odd rows as in `fit` and `with_score`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return with_score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
