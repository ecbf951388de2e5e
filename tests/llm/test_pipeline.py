"""The pipeline and the classifier against plain versions of what they compute."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from test_against_brute_force import DOCS, brute_components, brute_lines, edited, jaccard, prose

import corpus_pipeline
from lodestone.llm import mixing, ngram_join, packing, toxicity
from lodestone.llm.words import WordHashes


def corpus(rng):
    texts = []
    for i in range(90):
        t = "\n".join(prose(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 5)))
        if i % 5 == 0:
            t += "\nzorg blurk " + prose(rng, 5)
        texts.append(t)
    passage = "\n".join(prose(rng, 20) for _ in range(3))
    texts += ["\n".join([prose(rng, 30), passage, prose(rng, 12)]) for _ in range(6)] + [passage]
    texts += [edited(rng, texts[i], 0.03) for i in range(0, 60, 3)] + texts[:10]
    rows = [(i, t, "en", f"src{min(i % 7, 3)}", len(t)) for i, t in enumerate(texts)]
    return rows + [(200, None, "en", "src1", None), (201, "", "en", "src1", 0), (202, " \n ", "en", "src2", 3)]


def plain_score(text, model):
    return 1 / (1 + math.exp(-(model[""] + sum(model.get(f, 0.0) for f in toxicity.features(text)))))


def test_pipeline_by_brute_force(spark, tmp_path):
    rng = random.Random(31)
    rows = corpus(rng)
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i < 90 and i % 5 == 0)) for i in range(110)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.train(docs, labels)
    kept = sorted(r for r in rows if plain_score(r[1], model) < 0.5)
    assert 0 < len(kept) < len(rows) and all("zorg" not in (r[1] or "") for r in kept)
    lines = brute_lines([r[1] or "" for r in kept])
    kept = [(i, None if t is None else new, source) for (i, t, _, source, _), new in zip(kept, lines) if new == (t or "") or new.strip()]
    sets = [ngram_join.ngram_set(t, 3, WordHashes()) for _, t, _ in kept]
    pairs = [(a, b) for a in range(len(kept)) for b in range(a + 1, len(kept)) if len(sets[a]) and len(sets[b]) and jaccard(sets[a], sets[b]) >= 0.5]
    gone = {k for k, v in brute_components(pairs).items() if k != v}
    kept = [r for k, r in enumerate(kept) if k not in gone]
    size = {i: len((t or "").split()) for i, t, _ in kept}
    have = Counter()
    for i, _, source in kept:
        have[source] += size[i]
    weight = {s: n**0.7 for s, n in have.items() if n}
    want = {}
    for source, w in weight.items():
        counts = Counter(size[i] for i, _, s in kept if s == source)
        budget = min(have[source], math.floor(sum(have.values()) * mixing.SHARE * w / sum(weight.values()) + 1e-6))
        for n, c in zip(sorted(counts), mixing.fit(sorted(counts), [counts[n] for n in sorted(counts)], budget)):
            if c and n:
                want[source, n] = c
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    source = {i: s for i, _, s in kept}
    chosen = {r.doc_id for r in out}
    assert Counter((source[i], size[i]) for i in chosen) == want
    covered, bins = Counter(), {}
    for r in out:
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        bins.setdefault((r.shard, r.bin, r.capacity), []).append((r.position, r.length))
    assert covered == Counter((i, k) for i in chosen for k in range(size[i]))
    assert all(packing.check_bins(v, k[2]) for k, v in bins.items())


def test_classifier_by_brute_force(spark):
    rng = random.Random(32)
    rows = [r for r in corpus(rng) if r[1] is not None]
    texts = [r[1] + (" the muslim women" if r[0] % 4 == 0 else "") for r in rows]
    toxic = [int("zorg" in t) for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)], "doc_id bigint, toxic int")
    pos, neg = Counter(), Counter()
    for t, y in zip(texts, toxic):
        (pos if y else neg).update(toxicity.features(t))
    p, q = sum(toxic), len(toxic) - sum(toxic)
    names = []
    for f in sorted(pos.keys() | neg.keys()):
        pool = (pos[f] + neg[f]) / (p + q)
        z = abs(pos[f] / p - neg[f] / q) / math.sqrt(pool * (1 - pool) * (1 / p + 1 / q) + 1e-12)
        if pos[f] + neg[f] >= toxicity.LEAST_DOCS and z >= toxicity.LEAST_Z:
            names.append(f)
    place = {f: k for k, f in enumerate(names)}
    ids = lambda fs: np.array(sorted(place[f] for f in fs if f in place), int)
    own = [ids(toxicity.features(t)) for t in texts]
    diffs = []
    for t in texts:
        for other in toxicity.swapped(t):
            there, fresh = set(ids(toxicity.features(t))), set(ids(other))
            if there != fresh:
                diffs.append((np.array(sorted(fresh - there), int), np.array(sorted(there - fresh), int)))
    w = toxicity.fit_logistic(own, np.array(toxic, float), diffs, len(names), 10.0)
    model = toxicity.train(docs, labels)
    assert model == pytest.approx(dict(zip([*names, ""], w)), abs=1e-6)
    got = {r.doc_id: r.toxicity for r in toxicity.classify(docs, labels).collect()}
    assert got == {i: pytest.approx(plain_score(t, model), abs=2e-6) for i, t in enumerate(texts)}
