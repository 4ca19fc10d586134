"""URL rules, vectors, components and the pipeline against brute force, and the cases that each must bear."""

import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanspark.llm import ann, embedding_dedup, mixing, near_copies, pii, registry, simhash, toxicity, url_filter
from gleanspark.llm.common import table
from gleanspark.llm.components import components

# --- URL rules


def _judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, url_filter.DEFAULT_VERDICT))
    return host, path, best[2], best[3]


URLS = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "x://net/", "x://a.net:80/", "x://notnet/", "x://b.org/fr/1", "x://b.org/de/", "x://ÄB.net/é", "x:///p", "x://a..net./", "http://deep.sub.example.com/de/?q=1", "x://example.com/fr/", "a://b://c.net/"]
URLS += ["x://example.com/fr/a/b", "x://w.example.com/fr/a\U0010ffff", "x://example.com/fr/\U0010ffff", "x://example.com/fra", "x://example.com.b/fr/", "x://com/fr/", "x://" + "a." * 300 + "org/fr/" + "z" * 5000]
RULES = [*url_filter.RULES, ("block", "sub.example.com", "/"), ("allow", "deep.sub.example.com", "/de/"), ("block", "example.com", "/fr/"), ("allow", "b", "/"), ("allow", "example.com", "/fr/a"), ("block", "example.com", "/fr/a"), ("block", "com", "")]


@pytest.mark.parametrize("rules", [url_filter.RULES, RULES, []])
def test_verdicts_are_those_of_trying_every_rule(spark, rules):
    rows = [(i, u, "k", 3, "mine") for i, u in enumerate(URLS * 2)] + [(None, "x://a.net/", None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, kind int, verdict string")
    got = url_filter.judge_urls(pages, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == _judge(r.url, rules), r.url
        assert r.key in ("k", None)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_the_native_queries_start_no_python(spark, sf_dir):
    for query in (url_filter.op7_url_filters, pii.op3_pii):
        assert "Python" not in query(spark, sf_dir)._jdf.queryExecution().toRdd().toDebugString()


# --- components


def test_components_of_chains_stars_and_repeats(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 7)]
    pairs += [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))] * 2
    parent = {v: v for p in pairs for v in p if p[0] != p[1]}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a != b:
            parent[top(a)] = top(b)
    links = spark.createDataFrame(pairs + [(None, 1)], "a long, b long")
    got = {r.v: r.root for r in components(links).collect()}
    assert set(got) == set(parent)
    assert len(set(got.values())) == len({top(v) for v in parent})
    assert all(len({got[v] for v in parent if top(v) == t}) == 1 for t in parent.values() if parent[t] == t)
    assert components(links.limit(0)).count() == 0


# --- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 16))
    near = base[:3].repeat(30, 0) + 0.05 * rng.standard_normal((90, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(np.vstack([base, near]))]
    rows += [(200 + i, rows[0][1], 0) for i in range(40)]  # copies
    rows += [(300, (2 * np.array(rows[0][1])).tolist(), 0), (301, rows[0][1], None), (302, None, 0), (303, [], 0)]
    rows += [(304, [0.0] * 16, 0), (305, [float("nan")] * 16, 0), (306, [float("inf")] * 16, 0), (307, [None] * 16, 0), (308, [1.0, 2.0], 0), (309, [2.0, 4.0], 0)]
    rows += [(None, [5.0, 1.0, 0.0], 0), (310, rows[1][1], 1), (310, rows[1][1], 1)]
    apart = np.eye(16)[:3] + 0.01
    rows += [(311, apart[0].tolist(), 2), (311, apart[1].tolist(), 2), (312, (apart[0] + 0.01).tolist(), 2), (313, (apart[1] + 0.01).tolist(), 2)]  # one id, two vectors
    rows += [(None, apart[2].tolist(), 2), (314, apart[2].tolist(), 2), (None, [1.0, 1.0, 0.0, 5.0], 2), (None, [1.0, 1.0, 0.0, 5.0], 2)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, n int")


def _usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def _cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if len(a) == len(b) else -2.0


def test_links_and_components_are_those_of_all_pairs(vectors, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SIDE", 16)  # so that buckets are cut
    rows = vectors.collect()
    n = len(rows)
    ok = [_usable(r.embedding) and r.label is not None for r in rows]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            near[i, j] = i != j and ok[i] and ok[j] and rows[i].label == rows[j].label and _cosine(rows[i].embedding, rows[j].embedding) >= 0.93
    none = 10**9
    label = np.array([r.vec_id if r.vec_id is not None else none for r in rows])
    for _ in range(n):
        label = np.minimum(label, np.where(near, label[None], none).min(1))
    number = lambda x: none if x is None else x
    expected = sorted((number(r.vec_id), int(d), int(c)) for r, d, c in zip(rows, near.sum(1), label, strict=True))
    got = embedding_dedup.near_duplicates(vectors).collect()
    assert sorted((number(r.vec_id), r.n_links, number(r.component_id)) for r in got) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_bucket_keys_recall_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (100, 50_000, 10**8):
        keys = [embedding_dedup.bucket_keys(x, *embedding_dedup.layout(n)) for x in (a, b)]
        assert (keys[0] == keys[1]).any(1).mean() > 0.96
        strangers = (keys[0] == np.roll(keys[0], 1, 0)).mean() * n
        assert strangers < 8  # a vector meets few unrelated ones a table, however many there are


def test_nearest_recalls_brute_force(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    norm, got = np.linalg.norm(x, axis=1), {}
    for r in ann.op2_ann(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        cos = (x * x[i]).sum(1) / (norm * norm[i])
        cos[i] = -2
        found = sorted(got[ids[i]])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(f[2] == pytest.approx(cos[ids == f[1]][0], abs=1e-15) for f in found)
        hits += len({f[1] for f in found} & set(ids[np.lexsort((ids, -cos))[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)


def test_clustered_vectors_need_few_candidates():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 64)).repeat(50, 0) + 0.1 * rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, hits, seen = ann.SortedProjections(x), 0, 0
    low, high = index.windows(x[::50])
    for i, q in enumerate(range(0, 3000, 50)):
        cos = x @ x[q]
        cos[q] = -np.inf
        rows, got = ann.verified(index, (low[i], high[i]), 5, 460, lambda r, cos=cos: cos[r])
        seen += len(rows)
        hits += len(set(rows[np.argsort(-got)[:5]].tolist()) & set(np.argsort(-cos)[:5].tolist()))
    assert hits >= 0.95 * 5 * 60
    assert seen / 60 < 100  # the cluster and little more, not the share of all


def test_nearest_bears_odd_rows(vectors, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)  # so that blocks are merged
    found = ann.nearest(vectors, F.col("vec_id") % 50 == 0).collect()
    own = [r for r in found if r.query_id == 0]
    assert [(r.vec_id, r["rank"]) for r in sorted(own, key=lambda r: r["rank"])] == [(200 + i, i + 1) for i in range(5)]  # ties by id
    assert {r.query_id for r in found} == {0, 50, 100, 200, 300}
    assert all(r.vec_id not in (302, 303, 304, 305, 306, 307, 308, 309) for r in found)
    few = ann.nearest(vectors.where("vec_id in (0, 1, 301)"), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]
    assert ann.nearest(vectors.limit(0), F.lit(True)).count() == 0


# --- queries and the pipeline


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    theirs = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    mine = registry.queries()[name](spark, sf_dir)
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(str, map(tuple, mine.select(*names).collect()))) == sorted(map(str, theirs.fetchall()))


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 14))


def test_pipeline_stages_do_what_their_operators_say(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}

    clean = corpus_pipeline.without_toxic(spark, docs, sf_dir).cache()
    scored = toxicity.with_score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}

    single = corpus_pipeline.without_near_copies(spark, clean, sf_dir).cache()
    groups = simhash.near_duplicate_groups(clean).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})

    safe = corpus_pipeline.without_personal_data(spark, single, sf_dir).cache()
    assert safe.columns == columns and safe.count() == single.count()
    spans = {r.doc_id: r.pii_spans for r in pii.with_spans(single).collect()}
    for r in safe.collect():
        assert (r.text == texts[r.doc_id]) == (not spans[r.doc_id])
        for s in spans[r.doc_id]:
            assert texts[r.doc_id][s.start : s.end] not in r.text

    mix = corpus_pipeline.mixed(spark, safe, sf_dir).cache()
    assert mix.columns == columns
    sizes = safe.withColumn("n", mixing.n_words(F.col("text"))).groupBy("source").agg(F.sum("n").alias("n"), F.max("n").alias("largest")).collect()
    target = mixing.share_out({r.source: r.n for r in sizes}, sum(r.n for r in sizes))
    got = {r.source: r.n for r in mix.withColumn("n", mixing.n_words(F.col("text"))).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    assert all(abs(got.get(r.source, 0) - target[r.source]) <= r.largest for r in sizes)

    ids = corpus_pipeline.as_token_ids(spark, mix, sf_dir)
    assert ids.count() == mix.count() and ids.where("round_trip").count() == mix.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "sentencepiece"]


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_are_those_of_all_pairs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rng = np.random.default_rng(3)
    for i in range(60):  # one or more words changed in 60 to 150
        words = [f"w{n}" for n in rng.integers(0, 5000, int(rng.integers(60, 150)))]
        texts[1000 + 10 * i] = " ".join(words)
        for k in range(1, 5):
            changed = list(words)
            for at in rng.integers(0, len(words), k):
                changed[at] = f"other{k}"
            texts[1000 + 10 * i + k] = " ".join(changed)
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    ids = sorted(sets)
    root = {i: i for i in ids}
    for n, b in enumerate(ids):
        for a in ids[:n]:
            if root[a] != root[b] and _jaccard(sets[a], sets[b]) >= 0.8:
                least, gone = sorted((root[a], root[b]))
                root = {i: least if r == gone else r for i, r in root.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.without_near_copies(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_parts_of_a_crowd_meet(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(40)]
    monkeypatch.setattr(near_copies, "SIDE", 3)
    found = near_copies.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(found) == 40 and {r.component_id for r in found} == {0}


#: Names that operators give to columns that come and go, or gave once.
CLASHES = "_t _m_ip _g_ip _s_ip _p_ip pii_spans _spans _nth _size _id _words _copies _copy _tie _margin _l _sp _made _row _of _n fp key row group set_id component_id kind bucket id open best copies size at whole routed taken bin u pattern sources tie margin windows".split()


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """A folder of small tables whose documents have all these columns, one with a dot and one in capitals besides."""
    folder = str(tmp_path_factory.mktemp("clashing"))
    texts = {1: "one two three four five six", 2: "One two three four five six", 3: "mail me@x.de or call +1 415 555 0132 now", 4: "ein anderer Text mit Wörtern", 5: None, 6: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES], F.lit("own dot").alias("a.b"), F.lit("own big").alias("_SIZES"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _own(rows, names):
    return all(r[c] == f"own {c}" for r in rows for c in names if c in r) and all(r["a.b"] == "own dot" and r["_SIZES"] == "own big" for r in rows if "a.b" in r)


def test_stages_leave_columns_of_any_name_alone(spark, clashing):
    docs = given = table(spark, clashing, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, clashing)
        assert docs.columns == given.columns
        rows = [r.asDict() for r in docs.collect()]
        assert rows and _own(rows, CLASHES)
        docs = docs.limit(12) if not rows else docs
    assert corpus_pipeline.STAGES[-1][1](spark, docs, clashing).count() == docs.count()


def test_operators_leave_columns_of_any_name_alone(spark, clashing):
    from gleanspark.llm import huffman_store, langid, unigram

    docs = table(spark, clashing, "documents")
    made = {
        "pii": pii.with_spans(docs, out="found"),
        "mask": pii.mask(pii.with_spans(docs, out="found"), spans="found"),
        "langid": langid.with_language(docs, *langid.prototypes(docs)),
        "toxicity": toxicity.with_score(docs, toxicity.fit(docs, table(spark, clashing, "labels"))),
        "unigram": unigram.decode(unigram.encode(docs, unigram.model_path()), unigram.model_path()),
        "fingerprint": simhash.with_fingerprint(docs, out="print"),
        "near copies": simhash.one_of_each_group(docs),
        "urls": url_filter.judge_urls(docs, url="text"),
    }
    for name, df in made.items():
        rows = [r.asDict() for r in df.collect()]
        assert _own(rows, CLASHES), name
        assert len(rows) == (4 if name == "near copies" else 12), name
    assert simhash.fingerprint_groups(docs).count() == huffman_store.encode(docs, huffman_store.tokenizer_path()).count() == 12
    assert near_copies.near_duplicate_groups(docs).count() == mixing.mix(docs, F.array("source"), mixing.n_words(F.col("text")))[0].count() == 12
    vectors = docs.select("*", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    assert embedding_dedup.near_duplicates(vectors, "doc_id", "embedding", "n_chars").count() == 12
    assert ann.nearest(vectors, F.col("doc_id") == 1, vec_id="doc_id").count() == 10


def test_pipeline_bears_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    rows = [(1, "a b c", "en", "s", 5, "k"), (1, "a b c", "en", "s", 5, "k"), (2, None, None, None, None, None), (None, "mail me@x.de", None, "s", 12, None), (3, "", "en", "t", 0, "")]
    for name, kept in (("odd", rows), ("none", [])):
        spark.createDataFrame(kept, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if kept else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = table(spark, f"{tmp_path}/{name}", "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(found) <= 3 * len(kept)


def test_vectors_whose_squares_overflow_or_vanish(spark):
    rows = [(0, [1e200, 0.0, 1e190], "a"), (1, [2e200, 0.0, 2e190], "a"), (2, [1e-200, 1e-200, 0.0], "a"), (3, [3e-200, 3e-200, 0.0], "a"), (4, [0.0, 1.0, 0.0], "a")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.query_id: (r.vec_id, r.score) for r in ann.nearest(vectors, F.lit(True), k=1).collect()}
    assert {q: v for q, (v, _) in got.items() if q < 4} == {0: 1, 1: 0, 2: 3, 3: 2} and all(got[q][1] == pytest.approx(1) for q in range(4))
    linked = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert linked == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_shared_folder_where_the_setting_is_unset(tmp_path):
    """A session of its own, as the setting of a running one can't be taken away."""
    code = """
from gleanspark.session import build_session
from gleanspark.llm import common, simhash
spark = build_session("unset", "local[2]", spark__sql__shuffle__partitions="2")
assert not spark.conf.get("spark.checkpoint.dir", "")
docs = spark.createDataFrame([(i, "one two three four five six seven " + str(i % 2)) for i in range(6)], "doc_id long, text string")
assert common.shared_dir(spark) == common.shared_dir(spark)
assert simhash.one_of_each_group(docs).count() == 2
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(sys.path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_near_copies_are_searched_once(spark, monkeypatch):
    calls = []
    search = simhash.near_duplicate_groups
    monkeypatch.setattr(simhash, "near_duplicate_groups", lambda *a: calls.append(a) or search(*a))
    assert simhash.one_of_each_group(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).count() == 1
    assert len(calls) == 1
