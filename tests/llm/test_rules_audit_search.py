"""Quality rules, the filter audit and lexical search against brute force, and the cases that each must bear."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.llm import filter_audit, lexical, quality
from gleanspark.llm.common import held_out, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, key string, kind int, h int"
LONG = "word other " * 20_000 + "x" * 40_000
ODD = [(1, "one two three four", "en", "a", 3, 0.5, 1, "k", 0, 1), (1, "one two three four", "en", "a", 3, 0.5, 1, "k", 0, 1)]
ODD += [(2, None, None, None, None, None, None, None, None, None), (None, "one two three four", "en", None, 1, None, None, None, None, None)]
ODD += [(3, "", "de", "b", 0, 0.0, 0, "", 0, 0), (4, LONG, "en", "b", len(LONG), 0.0, 0, "", 0, 0), (5, " \n\t ", "en", "a", 4, 0.0, 0, "", 0, 0), (6, "four three", "", "a", 4, 0.0, 0, "", 0, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- quality rules


def _plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


HARD = ["a b c a b c", "a a a", "a a a a", "x y  z\x1fq", "l1\nl1 \n l1\nl1\n\n\n", "ä# Ö|ß <\U0001f600>", "\x0b\x0c", "a b c\ta\nb\x0bc d a b", None, "", LONG]


def test_counts_are_those_of_the_plain_patterns(spark, sf_dir):
    texts = HARD + [r.text for r in table(spark, sf_dir, "documents").collect()]
    for t in texts:
        assert quality.statistics(t.encode() if t is not None else None)[:5] == _plain_counts(t)


def test_windows_of_many_distinct_words():
    words = [str(i) for i in range(1_100_000)] + ["0", "1", "2"]
    assert quality.statistics(" ".join(words).encode())[4] == 6


@pytest.fixture(scope="module")
def forest():
    rng = np.random.default_rng(11)
    x = rng.random((3000, len(quality.FEATURES)))
    bad = 3 * x[:, 2] + 2 * x[:, 4] - 2 * x[:, 2] * x[:, 0] + np.sin(9 * x[:, 3]) + rng.normal(0, 0.3, 3000)
    return quality.grow(x, (bad < 1.7).astype(float), rounds=40), x


def _walk(f, root, row):
    at = root
    while f.left[at] != at:
        at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
    return f.value[at]


def test_flat_arrays_score_as_the_trees_do(forest):
    f, x = forest
    for row, got in zip(x[:200], f.score(x[:200]), strict=True):
        assert got == pytest.approx(1 / (1 + math.exp(-f.base - sum(_walk(f, r, row) for r in f.roots))))


def test_constrained_features_never_raise_the_score(forest):
    f, x = forest
    for i, (_, sign) in enumerate(quality.FEATURES):
        scores = np.stack([f.score(np.where(np.arange(x.shape[1]) == i, v, x[:300])) for v in np.linspace(0, 1, 40)])
        if sign < 0:
            assert (np.diff(scores, axis=0) <= 1e-12).all()
    moved = f.score(np.where(np.arange(x.shape[1]) == 2, 1.0, x)) < f.score(np.where(np.arange(x.shape[1]) == 2, 0.0, x)) - 0.1
    assert moved.mean() > 0.5  # the constraint leaves the feature its use


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = quality.op11_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where(held_out()).toPandas()
    good = got.quality > 0
    assert (got.score[good] >= quality.KEEP).mean() > 0.99 and (got.score[~good] < quality.KEEP).mean() > 0.9
    assert not (got.kept & got.base_failed).any()
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()


def test_quality_learns_from_other_folds_and_bounded_rows(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "grow", lambda x, good: seen.append(len(x)))
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    quality.fit(docs.union(docs), labels.union(labels))
    quality.fit(docs.union(docs), labels, rows=7)
    assert seen == [labels.where(~held_out()).join(docs, "doc_id").select("doc_id").distinct().count(), 7]


def test_quality_bears_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.with_quality(odd, quality.fit(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert [r.kept for r in got if r.doc_id != 4] == [False] * 7
    assert {(r.doc_id, r.key, r.kind, r.h) for r in got} == {(r[0], r[7], r[8], r[9]) for r in ODD}
    empty = quality.fit(none, labels.limit(0))
    assert quality.with_quality(none, empty).count() == 0 and len(quality.with_quality(odd, empty).collect()) == len(ODD)


# --- filter audit


def _copies(rows):
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    return sorted(((i, i is not None and i > least[t or ""]) for i, t in rows), key=str)


@pytest.mark.parametrize("collide", [False, True])
def test_copies_are_those_of_comparing_texts(spark, monkeypatch, collide):
    monkeypatch.setattr(filter_audit, "FIRST", 4)
    monkeypatch.setattr(filter_audit, "GROWTH", 2)
    if collide:  # every text of a length falls into one class, so that only the texts themselves can tell
        monkeypatch.setattr(filter_audit, "block_hashes", lambda text, longest: F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    texts = [None, "", "same", "same", "sama", "xame", "abcdefghij" * 5, "abcdefghij" * 5, "abcdefghij" * 4 + "abcdefghix", "ä😀bc", "ä😀bc", "ä😀bd"]
    rows = [(i * 3 % 50, t) for i, t in enumerate(texts * 3)] + [(None, "same"), (7, "same"), (7, "same"), (None, None)]
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, kind string")
    got = filter_audit.with_copies(docs, ("kind",)).collect()
    assert sorted(((r.doc_id, r.copy) for r in got), key=str) == _copies(rows) and {r.kind for r in got} == {"p"}


def test_refinement_drops_classes_of_one_at_every_step(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "FIRST", 2)
    monkeypatch.setattr(filter_audit, "GROWTH", 2)
    left, write = [], filter_audit.spool
    monkeypatch.setattr(filter_audit, "spool", lambda df, name: write(df, name) if name != "alive" else left.append(write(df, name)) or left[-1])
    texts = ["abcdefgh", "abcdefgh", "abcdefgx", "abcdxxxx", "abxxxxxx", "xxxxxxxx", "short"]
    filter_audit.with_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [df.count() for df in left] == [6, 5, 4, 2]


def test_audit_counts_every_order(spark):
    masks = [("p", 0b01, True, False, 5), ("p", 0b11, False, True, 3), ("p", 0b10, True, True, 2), ("p", 0b00, False, False, 4), ("q", 0b00, True, False, 1)]
    rows = {(r.part, r.filter_order, r.step): r.asDict() for r in filter_audit.audit(spark.createDataFrame(masks, "part string, mask int, good boolean, toxic boolean, n long"), "AB").collect()}
    assert set(rows) == {(p, "".join(o), s) for p in "pq" for o in permutations("AB") for s in (1, 2)}
    value = lambda *key: [rows[key][c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    assert value("p", "AB", 1) == [6, 8, 0, 5, 5, 3, 13]
    assert value("p", "AB", 2) == [4, 2, 3, 2, 2, 2, 7]
    assert value("p", "BA", 1) == [9, 5, 0, 2, 2, 5, 7]
    assert value("p", "BA", 2) == [4, 5, 3, 5, 5, 0, 13]
    assert value("q", "BA", 2) == [1, 0, 0, 0, 0, 0, 0]


def test_audit_bears_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = filter_audit.filter_audit(odd, labels).where("filter_order = 'EABCD' AND step = 1").collect()
    got = {r.part: (r.kept, r.removed, r.good_lost, r.toxic_lost) for r in rows}
    assert got == {"en": (5, 0, 0, 0), "de": (0, 1, 0, 0), "": (2, 0, 0, 0)}  # the empty text of id 3 repeats the null one of id 2
    first = filter_audit.filter_audit(odd, labels).where("filter_order = 'ABCDE' AND step = 1 AND part = 'en'").first()
    assert (first.removed, first.good_lost, first.toxic_lost) == (4, 2, 2)
    assert filter_audit.filter_audit(none, labels).count() == 0


# --- lexical search


def _bm(documents, queries, k):
    found = [[t for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for _, t in documents]
    with_terms = [f for f in found if f]
    n_docs, n_terms, df = len(with_terms), sum(map(len, with_terms)), Counter(t for f in with_terms for t in set(f))
    out = []
    for item, text in queries:
        asked = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        scores = []
        for (i, _), f in zip(documents, found, strict=True):
            tf = Counter(f)
            m = 75 + 25 * len(f) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in asked if tf[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def _clustered(n=1200, topics=12):
    rng = np.random.default_rng(13)
    texts = []
    for i in range(n):
        own = [f"t{i % topics}w{x}" for x in rng.integers(0, 40, 30)]
        texts.append((i, " ".join(own + [f"common{x}" for x in rng.integers(0, 20, 8)])))
    return texts


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 40)


def test_search_is_that_of_scoring_every_document(spark, small_shards):
    documents = _clustered() + [(5, "T3W1 t3w2!"), (None, "t3w1 t3w2"), (5, "t3w1 t3w2"), (7000, None), (7001, "--"), (7002, "é\x00É x1X"), (None, "t3w1 t3w2")]
    queries = [(1, "t3w1 t3w2 t3w2 common1"), (2, "t5w7, COMMON3"), (3, "é x1x É"), (4, ""), (5, None), (6, "nowhere"), (1, "t3w1"), (None, "common2 common4 t0w1")]
    index = lexical.build_index(spark.createDataFrame(documents, "doc_id long, text string"))
    assert index.n_shards >= 20
    got = lexical.search(index, spark.createDataFrame(queries, "item_id long, text string"), k=7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _bm(documents, queries, 7)


def test_search_stops_before_shards_that_cannot_win(spark, small_shards, monkeypatch):
    documents = spark.createDataFrame(_clustered(), "doc_id long, text string")
    visited, plain = [], lexical._visit
    monkeypatch.setattr(lexical, "_visit", lambda block, visits, least, k: visited.append(sum(map(len, visits.value.values()))) or plain(block, visits, least, k))
    index = lexical.build_index(documents)
    found = lexical.search(index, spark.createDataFrame([(i, f"t{i}w1 t{i}w2 t{i}w3") for i in range(12)], "item_id long, text string"), k=5)
    assert found.count() == 60
    assert sum(visited) < 0.35 * 12 * index.n_shards


def test_bisection_brings_documents_of_a_topic_together():
    documents = [np.unique(lexical.dims_of(t.encode().split())) for _, t in _clustered(400, 4)]
    splits = lexical.bisect(documents, 2)
    leaves = splits.leaves(np.concatenate(documents), np.repeat(np.arange(400), [len(d) for d in documents]), 400)
    assert max(Counter(leaves.tolist()).values()) < 140
    topics = np.array([[((leaves == leaf) & (np.arange(400) % 4 == t)).sum() for t in range(4)] for leaf in range(4)])
    assert topics.max(1).sum() > 0.9 * 400


def test_sums_beyond_doubles_are_exact():
    block = lexical._Block([np.array([0, 1])], [np.array([2**34 + 1, 1])])
    assert not block.exact[0]
    assert block.scores(0, np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([999_999, 1, 1]), 2).tolist() == [(2**34 + 1) * 999_999, 2**34 + 2]


def test_blocks_of_queries_give_the_same_rows(spark, small_shards, monkeypatch):
    documents, queries = _clustered(300), [(i, f"t{i % 12}w{i} common{i}") for i in range(30)]
    index = lexical.build_index(spark.createDataFrame(documents, "doc_id long, text string"))
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 8)
    got = lexical.search(index, spark.createDataFrame(queries, "item_id long, text string"), k=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _bm(documents, queries, 3)


def test_search_bears_odd_rows(spark, odd, none):
    index = lexical.build_index(odd)
    items = spark.createDataFrame([(1, "one four", 3), (2, LONG, 4), (None, None, None)], "item_id long, text string, shard int")
    got = sorted((tuple(r) for r in lexical.search(index, items).collect()), key=str)
    assert got == _bm([r[:2] for r in ODD], [(1, "one four"), (2, LONG)], 20)
    assert lexical.search(lexical.build_index(none), items).count() == 0 and lexical.search(index, items.limit(0)).count() == 0
