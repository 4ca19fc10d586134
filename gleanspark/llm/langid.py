"""Language identification with hyperdimensional profiles.

Every letter of any script has a random vector of +1 and -1 of its own, seeded by its code point; what lies between words
has one too. A 3-gram is bound from its letters: the first letter's vector is rotated twice, the second's once, and the
three are multiplied component by component. A text is the sum (bundle) of its 3-grams; a language's prototype is the sum
over its training texts. A text gets the language whose prototype has the largest cosine with it.

Vectors are the same in every worker, and a worker keeps those of the last GRAMS 3-grams. Prototypes are summed in tasks
over the training fold; a vector a language is all that reaches the driver, so more than MAX_LANGUAGES are refused.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import free_prefix, held_out, quoted, table

DIMENSIONS = 1024
SEED = 20240101
SHARPNESS = 12.0
UNKNOWN = "und"
MAX_ROWS = 40_000  # training texts, in order of a hash of doc_id
MAX_LANGUAGES = 2000
GRAMS, AT_ONCE = 1 << 15, 4096  # 3-grams whose vectors a worker keeps (32 MB); those that are bundled at a time


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point that of its letter in lower case, 0 for anything but letters."""
    return np.fromiter((ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(0x110000))), np.int64, 0x110000)


def symbols(text: str) -> np.ndarray:
    """The text's letters as code points, with runs of anything but letters as one 0, and a 0 at both ends."""
    s = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([[0], s, [0]])
    return s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]


def grams(text: str) -> np.ndarray:
    """The text's 3-grams as numbers of three times 21 bits, repeats included."""
    s = symbols(text)
    return s[:-2] << 42 | s[1:-1] << 21 | s[2:]


@lru_cache(1 << 14)
def letter(point: int) -> np.ndarray:
    """The vector of a letter; 0 stands for what lies between words."""
    return np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def bound(keys: np.ndarray) -> np.ndarray:
    """(n, DIMENSIONS) vectors of 3-grams."""
    parts = []
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        points, which = np.unique(keys >> shift & 0x1FFFFF, return_inverse=True)
        parts.append(np.stack([np.roll(letter(p), turn) for p in points.tolist()])[which])
    return parts[0] * parts[1] * parts[2]


class GramVectors:
    """Vectors of 3-grams, bound once while they stay in memory; at GRAMS of them all are dropped."""

    def __init__(self):
        self.vectors = np.empty((GRAMS, DIMENSIONS), np.int8)
        self.keys, self.rows = np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct 3-grams, AT_ONCE of them at most."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not known.all():
            if len(self.keys) + int((~known).sum()) > GRAMS:
                self.keys, self.rows, known, at = self.keys[:0], self.rows[:0], np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
            new, n = keys[~known], len(self.keys)
            self.vectors[n : n + len(new)] = bound(new)
            self.keys, self.rows = np.insert(self.keys, at[~known], new), np.insert(self.rows, at[~known], np.arange(n, n + len(new)))
            at = np.searchsorted(self.keys, keys)
        return self.vectors[self.rows[at]]


@lru_cache(1)
def gram_vectors() -> GramVectors:
    return GramVectors()


def bundle_of(ids: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """The sum of the vectors of 3-grams."""
    keys, n = np.unique(ids, return_counts=True)
    out = np.zeros(DIMENSIONS, kind)
    for at in range(0, len(keys), AT_ONCE):
        out += n[at : at + AT_ONCE].astype(kind) @ gram_vectors().of(keys[at : at + AT_ONCE]).astype(kind)
    return out


def bundle(text: str) -> np.ndarray:
    """The text's vector."""
    return bundle_of(grams(text))


def prototypes(docs: DataFrame, rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, unit vectors of their prototypes) from columns doc_id, text and lang.

    Rows where text or lang is null, and texts without letters, teach nothing; long texts are read whole; repeated rows
    count as often as given; other columns may have any name. An empty table has no languages. More than MAX_LANGUAGES
    different values of lang raise a ValueError.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    total = known.select("doc_id").count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(total)) < rows)
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"column lang has more than {MAX_LANGUAGES} values")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            held: dict[str, list] = {}
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                found = grams(text.as_py())
                if found.any():
                    held.setdefault(lang.as_py(), []).append(found)
            for lang, found in held.items():
                sums[lang] = sums.get(lang, 0.0) + bundle_of(np.concatenate(found), np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS)), pa.array(v)], ["lang", "i", "v"])

    sums = known.select("text", "lang").mapInArrow(count, "lang string, i long, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()
    names = sorted(sums["lang"].unique())
    out = np.zeros((len(names), DIMENSIONS))
    out[sums["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int), sums["i"].to_numpy(int)] = sums["v"]
    return names, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def with_language(docs: DataFrame, names: list[str], profiles: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (share of the winner among exp(SHARPNESS * cosine)) and cosine.

    A null text, one without letters, or no profiles at all: `und` with score 0. Every row is kept, repeated ones too, with
    its columns of any name; those of the three names are replaced. Long texts are read whole. Ties go to the first
    language in order. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles.astype(np.float32))  # languages x DIMENSIONS

    @F.arrow_udf("struct<lang:string,score:double,cosine:double>")
    def of(texts: pa.Array) -> pa.Array:
        langs, scores, cosines = [], [], []
        for x in texts:
            text = x.as_py()
            if not text or not names or not symbols(text).any():
                langs.append(UNKNOWN), scores.append(0.0), cosines.append(0.0)
                continue
            v = bundle(text)
            cos = (sent.value @ v).astype(float) / max(float(np.linalg.norm(v)), 1e-12)
            best = int(cos.argmax())
            share = 1.0 / np.exp(SHARPNESS * (cos - cos[best])).sum()
            langs.append(names[best]), scores.append(float(share)), cosines.append(float(cos[best]))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(cosines, pa.float64())], ["lang", "score", "cosine"])

    made = f"{free_prefix(docs)}made"
    found = docs.withColumn(made, of(quoted(text)))
    return found.withColumns({"lang_pred": F.col(f"{made}.lang"), "score": F.col(f"{made}.score"), "cosine": F.col(f"{made}.cosine")}).drop(made)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document of `documents`, learned from those that aren't held out; odd rows as in the two above."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, profiles = prototypes(docs.where(~held_out()))
    return with_language(docs.select("doc_id", "text"), names, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cosine")


QUERIES = {"op1_langid": op1_langid}
ORACLE: dict[str, str] = {}
