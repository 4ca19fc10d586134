"""The pipeline's near-copy stage follows the links of SimHash fingerprints."""

import random

import numpy as np

import corpus_pipeline
from gleanspark.llm import near_copies, simhash


def test_fingerprint_links_are_candidates_of_the_near_copy_stage(spark, sf_dir, monkeypatch):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    text = " ".join(words)
    apart = lambda x: (simhash.fingerprint(text.encode()) ^ simhash.fingerprint(x.encode())).bit_count()
    changed = (" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(600))
    near = next(x for x in changed if 0 < apart(x) <= simhash.RADIUS)
    far = " ".join(reversed(words))
    docs = spark.createDataFrame([(1, text), (2, near), (3, far)], "doc_id long, text string")
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: np.empty(0, np.int64))  # no candidates but the fingerprints'
    kept = corpus_pipeline.without_near_copies(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
