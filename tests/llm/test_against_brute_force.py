"""Each operator against a plain version of what it computes, on small or planted data."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lodestone.llm import components, licenses, line_dedup, mixing, neardup, ngram_join, packing, pii, queries, suffix_tree, topk, toxicity
from lodestone.llm.words import WordHashes, words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ner", "tus", "ve"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in enumerate(texts)], DOCS).repartition(4)


def edited(rng, text, share):
    return " ".join(prose(rng, 1) + "x" if rng.random() < share else w for w in text.split(" "))


def brute_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_labels(pairs):
    pairs = [p for p in pairs if p[0] != p[1]]
    if pairs:
        a, b = np.array(pairs).T
        node, root = components.least_labels(a, b)
        assert dict(zip(node.tolist(), root.tolist())) == brute_components(pairs)


def test_components_both_ways(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 450)]
    want = {k: v for k, v in brute_components([p for p in pairs if p[0] != p[1]]).items() if k != v}
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    for limit in (10**6, 0):
        assert {r.node: r.root for r in components.components(edges, limit).collect()} == want


def test_neardup(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 32))
    near = np.concatenate([base[k % 40] + 0.12 * rng.standard_normal(32) for k in range(160)]).reshape(160, 32)
    many = base[50] + 0.02 * rng.standard_normal((700, 32))
    x = np.concatenate([base, near, many]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    monkeypatch.setattr(neardup, "BLOCK", 150)  # the largest cluster takes several blocks
    rows = neardup.near_duplicates(frame, window=32).collect()
    got = {r.vec_id: r.cluster_id for r in rows}
    degree = Counter(a.tolist() + b.tolist())
    assert sum(r.links for r in rows) >= 0.97 * 2 * len(a) and all(r.links <= degree[r.vec_id] for r in rows)
    together = sum(got[i] == got[j] for i, j in zip(a.tolist(), b.tolist()))
    want = brute_components(zip(a.tolist(), b.tolist()))
    assert together >= 0.97 * len(a)
    assert all(want.get(k, k) == want.get(v, v) for k, v in got.items())  # none united that aren't joined


def test_neardup_in_a_cone(spark):
    rng = np.random.default_rng(17)
    x = rng.standard_normal((3000, 32)) / 32**0.5 + 2 * np.eye(32)[0]  # mean cosine 0.8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal((300, 32))
    u -= (u * x[:300]).sum(axis=1, keepdims=True) * x[:300]
    y = 0.952 * x[:300] + (1 - 0.952**2) ** 0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r.cluster_id for r in neardup.near_duplicates(frame, window=16).collect()}
    assert sum(got[i] == got[3000 + i] for i in range(300)) >= 0.97 * 300


def bm25(texts, query, k):
    docs = [Counter(words(t)) for t in texts]
    n, mean = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    out = []
    for i, d in enumerate(docs):
        s = 0.0
        for w, c in Counter(words(query)).items():
            df = sum(w in x for x in docs)
            s += c * math.log(1 + (n - df + 0.5) / (df + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) if d[w] else 0.0
        if s > 0:
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_top_k(spark, monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(300)]
    texts += texts[:20]
    asked = [prose(rng, 6) for _ in range(15)]
    ask = spark.createDataFrame(list(enumerate(asked)), "item_id bigint, text string")
    for chunk, most in ((2000, 10**6), (4, 10**6), (4, 0)):
        monkeypatch.setattr(topk, "MOST_TERMS", most)  # 0: all terms are indexed
        got = topk.top_k(table(spark, texts), ask, k=7, block=16, chunk=chunk).collect()
        for q, text in enumerate(asked):
            mine = sorted((r for r in got if r.item_id == q), key=lambda r: r["rank"])
            want = bm25(texts, text, 7)
            assert [r.doc_id for r in mine] == [i for i, _ in want]
            assert [r.score for r in mine] == pytest.approx([s for _, s in want], abs=2e-6)


def test_blocks_are_pruned():
    ids = np.arange(1000)
    blocks = []
    for k in range(10):
        tf = np.ones(100) * (5 if k == 3 else 1)
        blocks.append(topk.Block(ids[k * 100 : k * 100 + 100], np.full(100, 10), np.ones(100, int), np.zeros(100, int), tf, np.array([1.0]), 10.0))
    _, _, used = topk.search_blocks(blocks, (np.array([0]), np.array([1.0])), 10, 1)
    assert used == 1


def test_licenses(spark):
    rng = random.Random(6)
    texts, want = [], set()
    for i in range(60):
        body = prose(rng, 40)
        if i % 3 == 0:
            name, text = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
            if i % 2 and len(text.split()) > 30:  # a few words changed
                w = text.split()
                w[10] = "somewhat"
                text = " ".join(w[:20] + ["added"] + w[20:])
            body += "\n" + text + "\n" + prose(rng, 30)
            want.add((i, name))
        texts.append(body + " the license of this the public license version")
    got = licenses.scan(table(spark, texts)).collect()
    assert {(r.doc_id, r.license) for r in got} == want
    for r in got:
        found = words(texts[r.doc_id])[r.first_word : r.end_word]
        assert max(licenses.compare(found, words(t))[0] / len(words(t)) for n, t in licenses.TEMPLATES if n == r.license) >= licenses.COVER


def brute_licenses(texts, templates, k=licenses.K):
    """Votes, diagonals, spans and passages by plain loops."""
    out = set()
    for i, text in enumerate(texts):
        own, found = words(text), []
        for t, (_, template) in enumerate(templates):
            want, lines = words(template), {}
            for at in range(len(own) - k + 1):
                for pos in range(len(want) - k + 1):
                    if own[at : at + k] == want[pos : pos + k]:
                        lines.setdefault(at - pos, []).append(at)
            spans, before = [], None
            for d in sorted(lines):
                a, b = min(lines[d]), max(lines[d])
                if before is None or d - before[0] > licenses.DRIFT or max(a, before[1]) - min(b, before[2]) > licenses.GAP + k:
                    spans.append([a, b, d, d])
                else:
                    spans[-1] = [min(a, spans[-1][0]), max(b, spans[-1][1]), spans[-1][2], d]
                before = (d, a, b)
            for a, b, low, high in spans:
                got = licenses.passage(own, want, a, b, low, high, k)
                if got:
                    found.append((-got[0], t, got[1], got[2]))
        taken = []
        for c, t, a, b in sorted(set(found)):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.add((i, templates[t][0], a, b))
    return out


def test_licenses_by_brute_force(spark):
    rng = random.Random(22)
    a, b, c, d = (prose(rng, n) for n in (16, 14, 8, 40))
    b = " ".join(a.split()[-6:] + b.split()[:4] + c.split()[:4])
    templates = (("A", a), ("B", b), ("C", c), ("D", d))
    changed = d.split()
    for k in range(0, 30, 3):
        changed[k] = f"other{k}"
    texts = [
        f"{prose(rng, 9)} {a} {' '.join(b.split()[6:10])} {c} {prose(rng, 9)}",  # A and C whole, B across both
        f"{prose(rng, 5)} {' '.join(changed)} {prose(rng, 5)}",  # 30 of 40 words, few votes
        f"{c}. {c}. {c}",  # short and repeated nearby
        f"{prose(rng, 50)} {a} {prose(rng, 50)} {a}",
        "",
    ]
    texts += [edited(rng, f"{prose(rng, 20)} {rng.choice([a, b, c, d])} {prose(rng, 8)} {rng.choice([a, b, c, d])}", 0.06) for _ in range(60)]
    got = {(r.doc_id, r.license, r.first_word, r.end_word) for r in licenses.scan(table(spark, texts), templates).collect()}
    assert got == brute_licenses(texts, templates)
    assert {x[1] for x in got if x[0] == 0} == {"A", "C"} and {x[1] for x in got if x[0] == 1} == {"D"}
    assert len([x for x in got if x[0] == 2]) == 3


def brute_scores(texts, beta, gain):
    order = suffix_tree.ORDER
    raw = [t.encode() for t in texts]
    count = [Counter() for _ in range(order + 1)]
    for r in raw:
        p = b"\xff" * order + r
        for i in range(order, len(p)):
            for d in range(order + 1):
                count[d][p[i - d : i + 1]] += 1
    total = [Counter() for _ in range(order + 1)]
    for d in range(order + 1):
        for g, n in count[d].items():
            total[d][g[:-1]] += n
    size = sum(count[0].values())
    kept = [set() for _ in range(order + 1)]
    for d in range(order, 0, -1):
        score = Counter()
        for g, n in count[d].items():
            score[g[:-1]] += n * math.log(n * total[d - 1][g[1:-1]] / (total[d][g[:-1]] * count[d - 1][g[1:]]))
        kept[d] = {c for c, s in score.items() if s >= gain * math.log(max(2, size))}
        if d < order:
            kept[d] |= {c[1:] for c in kept[d + 1]}

    def p(g):
        if len(g) == 1:
            return (count[0][g] + beta / 256) / (size + beta)
        d = len(g) - 1
        return (count[d][g] + beta * p(g[1:])) / (total[d][g[:-1]] + beta)

    out = []
    for r in raw:
        padded, s = b"\xff" * order + r, 0.0
        for i in range(order, len(padded)):
            d = next((d for d in range(order, 0, -1) if padded[i - d : i] in kept[d]), 0)
            s -= math.log2(p(padded[i - d : i + 1]))
        out.append(s / len(r) if r else None)
    return out


def test_suffix_tree(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(60)] + ["", "é ü", "kalomi" * 200]
    want = brute_scores(texts, suffix_tree.BETA, suffix_tree.GAIN)
    for limit in (10**6, 0):  # by broadcast and by joins
        got = {r.doc_id: r.bits_per_byte for r in suffix_tree.score(table(spark, texts), model_rows=limit).collect()}
        for i, w in enumerate(want):
            assert got[i] == (None if w is None else pytest.approx(w, abs=2e-6))


def test_toxicity_held_out_and_fair(spark):
    rng = random.Random(8)
    bad = ["zorg", "blurk", "snazt"]
    texts, toxic = [], []
    for i in range(500):
        t, y = prose(rng, 30), rng.random() < 0.3
        if y:
            t += " " + " ".join(rng.sample(bad, 2))
        if rng.random() < (0.9 if y else 0.05):
            t += " the muslim women"  # mentions go with insults in the labels
        texts.append(t)
        toxic.append(int(y))
    neutral = [prose(rng, 30) + " the muslim women spoke" for _ in range(100)]
    docs = table(spark, texts + neutral)
    labels = spark.createDataFrame([(i, 1, toxic[i]) for i in range(300)], "doc_id bigint, quality int, toxic int")
    scores = {}
    for fairness in (0.0, 10.0):
        got = {r.doc_id: r for r in toxicity.classify(docs, labels, fairness=fairness).collect()}
        scores[fairness] = np.mean([got[500 + k].toxicity for k in range(100)])
        held = [(got[i].toxic, bool(toxic[i])) for i in range(300, 500)]
        assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert scores[10.0] < 0.2 and scores[10.0] <= scores[0.0]


def test_line_dedup(spark):
    rng = random.Random(9)
    passage = "\n".join(prose(rng, n) for n in (30, 12, 45, 8, 22))
    texts = ["\n".join([prose(rng, 20), prose(rng, 15), passage, prose(rng, 18)]) if i % 4 == 0 else "\n".join(prose(rng, 20) for _ in range(5)) for i in range(80)]
    texts.append(texts[1])
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].text == texts[1]  # first occurrences stay
    longest = passage.split("\n")[2]
    for i in range(4, 80, 4):
        assert longest not in got[i].text and texts[i].split("\n")[0] in got[i].text
        assert sum(line in got[i].text for line in passage.split("\n")) <= 2
    assert got[80].text == ""
    for i in range(80):
        if i % 4:
            assert got[i].text == texts[i] and got[i].removed_lines == 0
        assert set(got[i].text.split("\n")) <= set(texts[i].split("\n"))


@given(st.lists(st.text("ab\n", max_size=8), max_size=6))
@settings(max_examples=80, deadline=None)
def test_chunks_cover_all_lines(parts):
    text = "\n".join(parts)
    found = line_dedup.chunks(text)
    assert [i for a, b, _ in found for i in range(a, b)] == list(range(len(text.split("\n"))))


def brute_lines(texts):
    """Lines of passages (two lines with 25 words, or one with 40) that came before."""
    seen, out = {}, []
    for i, text in enumerate(texts):
        lines = text.split("\n")
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                n = sum(len(x.split()) for x in lines[a:b])
                if n >= line_dedup.LONG_WORDS if b - a == 1 else n >= line_dedup.RUN_WORDS:
                    at = seen.setdefault(tuple(lines[a:b]), (i, b))
                    if at[0] != i or a >= at[1]:
                        gone |= set(range(a, b))
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_short_repeated_passages_go_whole(spark):
    rng = random.Random(14)
    texts = []
    for lines, n in [(2, 28), (2, 35), (3, 25), (4, 20), (2, 13), (2, 12), (1, 39), (1, 40), (3, 9)] * 6:
        passage = "\n".join(prose(rng, n) for _ in range(lines))
        texts += ["\n".join([prose(rng, 20), prose(rng, 9), passage, prose(rng, 30), prose(rng, 3)]) for _ in range(2)]
        if lines * n >= (line_dedup.RUN_WORDS if lines > 1 else line_dedup.LONG_WORDS):
            assert passage not in brute_lines(texts)[-1]
    line = prose(rng, 15)
    texts += ["\n".join([line] * 5), "\n\n" + texts[3] + "\n", "\n".join(reversed(texts[5].split("\n")))]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


@given(st.lists(st.sampled_from([0, 1, 3, 12, 24, 25, 30, 45]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_passages_cover_longer_ones(count):
    short = line_dedup.passages(count)
    for a in range(len(count)):
        for b in range(a + 1, len(count) + 1):
            n = sum(count[a:b])
            if n >= line_dedup.LONG_WORDS if b - a == 1 else n >= line_dedup.RUN_WORDS:
                covered = {k for x, y in short if a <= x and y <= b for k in range(x, y)}
                assert all(k in covered for k in range(a, b) if count[k])


def test_private_data(spark):
    rng = random.Random(10)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    want, texts = set(), []
    for i in range(200):
        w = prose(rng, 40).split(" ")
        value, label = rng.choice(
            [
                (f"{prose(rng, 1)}.{d(2)}@mail{d(1)}.example.com", "EMAIL"), (f"+1 ({d(3)}) 555-{d(4)}", "PHONE"),
                (".".join(str(rng.randrange(256)) for _ in range(4)), "IP"), ("4" + d(15), "CARD"), ("".join(rng.choices("0123456789abcdef", k=40)), "SECRET"),
            ]
        )
        if i % 2:
            w.insert(20, value if label != "SECRET" else f'token = "{value}"')
            want.add((i, label, value))
        w.insert(5, rng.choice(["version 2.0.", "1998", "12", "page 7", "3,500"]))
        texts.append(" ".join(w))
    got = {(r.doc_id, r.label, r.value) for r in pii.private_data(table(spark, texts)).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def brute_marginals(model, g):
    n, labels = len(g.where), len(pii.LABELS)
    own = np.zeros((n, labels))
    for k, seen in enumerate(g.seen):
        own[k] = model.unary[seen].sum(axis=0)
    for k in g.opens:
        own[k] += np.log(model.into)
    for k in g.closes:
        own[k] += np.log(model.back)
    total = np.zeros((n, labels))
    for ys in itertools.product(range(labels), repeat=n):
        s = sum(own[k, y] for k, y in enumerate(ys))
        s += sum(np.log(model.chain[ys[a], ys[b]]) for a, b in g.chain) + sum(np.log(model.skip[ys[a], ys[b]]) for a, b in g.skip)
        for k, y in enumerate(ys):
            total[k, y] += math.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees():
    g = pii.Graph()
    model = pii.trained()
    g.add("+1 (555) 555-1234", 0, pii.Shapes())
    g.opens = [0]
    assert not g.skip and len(g.where) == 3
    assert np.allclose(model.marginals(g), brute_marginals(model, g), atol=1e-6)


def test_skip_edges_tie_repeated_tokens():
    model = pii.trained()
    g = pii.Graph()
    far = " ".join(["lo"] * 40)
    g.add(f"12345678901 {far} 12345678901", 0, pii.Shapes())
    assert len(g.skip) == 1
    m = model.marginals(g)
    a, b = g.skip[0]
    apart = pii.Graph()
    apart.add(f"12345678901 {far} 98765432", 0, pii.Shapes())
    assert np.abs(m[a] - m[b]).max() < 0.2 and not apart.skip


def test_short_graphs_find_what_whole_chains_do():
    rng, model = random.Random(24), pii.trained()
    texts = []
    for tokens, _ in pii.made_sentences(150, seed=99):
        texts.append(" ".join(x for t in tokens for x in [t, *prose(rng, rng.choice([0, 0, 1, 15])).split()]))
    texts += [prose(rng, 50), "", "Dear Mr. Baker, " + prose(rng, 60) + " As Baker said"]
    assert pii.find(texts, model) == pii.find(texts, model, whole=True)


def test_private_data_held_out():
    model = pii.trained()
    right = wrong = missed = 0
    for tokens, labels in pii.made_sentences(300, seed=100):
        text = " ".join(tokens)
        marked = set()
        for _, a, b, label in pii.find([text], model):
            marked |= {(k, label) for k in range(a, b)}
        at = 0
        for t, y in zip(tokens, labels):
            got = {label for k in range(at, at + len(t)) for label in pii.LABELS if (k, label) in marked}
            at += len(t) + 1
            right, wrong, missed = right + (y != "O" and y in got), wrong + (y == "O" and bool(got)), missed + (y != "O" and y not in got)
    assert right / (right + missed) > 0.93 and wrong / (right + wrong) < 0.05


@pytest.mark.parametrize(
    "text, want",
    [
        ("password: hunter2", [("hunter2", "SECRET")]), ("pay 4111 1111 1111 1111 by card", [("4111 1111 1111 1111", "CARD")]), ("ssn 123-45-6789", [("123-45-6789", "ID")]),
        ("call 0151 23456789", [("0151 23456789", "PHONE")]), ("host 2001:db8::1", [("2001:db8::1", "IP")]), ("at 10.0.0.1:8080", [("10.0.0.1", "IP")]), ("+49 151 2345678", [("+49 151 2345678", "PHONE")]),
        ("write a@x.com,bb@y.org now", [("a@x.com", "EMAIL"), ("bb@y.org", "EMAIL")]), ("Dear Mr. Baker, hello. As Baker said", [("Baker", "NAME"), ("Baker", "NAME")]),
        ("we met at 12 Oak Street in May", [("12 Oak Street", "ADDRESS")]), ("version 2.0.1 page 7 in 1998", []), ("the password must be long", []), ("10:20:30 and 3,500", []),
    ],
)
def test_private_shapes(text, want):
    assert [(text[a:b], label) for _, a, b, label in pii.find([text], pii.trained())] == want


def jaccard(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_ngram_join(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([5, 12, 40, 150, 600])) for _ in range(120)]
    for i in range(120):
        texts += [edited(rng, texts[i], rng.choice([0, 0.02, 0.05, 0.08])) for _ in range(rng.randrange(3))]
    texts += [edited(rng, texts[4], 0.03) for _ in range(60)]
    shared = prose(rng, 50)
    texts += [prose(rng, 200) + " " + shared + " " + prose(rng, 200) for _ in range(40)]
    cache = WordHashes()
    sets = [ngram_join.ngram_set(t, 3, cache) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(sets[a], sets[b]) >= 0.5]
    check_join(spark, texts, sets, pairs)


def check_join(spark, texts, sets, pairs):
    """Groups, links and what stays, exactly."""
    want, names = brute_components(pairs), [s.tobytes() for s in sets]
    partners = {}
    for a, b in pairs:
        if names[a] != names[b]:
            partners.setdefault(a, set()).add(names[b])
            partners.setdefault(b, set()).add(names[a])
    got = {r.doc_id: (r.group_id, r.links) for r in ngram_join.similar_groups(table(spark, texts)).collect()}
    assert got == {k: (v, len(partners.get(k, ()))) for k, v in want.items()}
    kept = {r.doc_id for r in ngram_join.one_of_each(table(spark, texts)).collect()}
    assert kept == set(range(len(texts))) - {k for k, v in want.items() if k != v}


def test_ngram_join_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FLUSH", 500)
    monkeypatch.setattr(ngram_join, "LEAST_PARTS", 3)
    rng = random.Random(21)
    texts = [prose(rng, rng.choice([3, 30, 90])) for _ in range(40)]
    texts += [edited(rng, texts[i % 40], rng.choice([0, 0.05, 0.12, 0.2])) for i in range(80)] + ["ka", "ka", "ka lo", "lo ka", "Ka!"]
    sets = [ngram_join.ngram_set(t, 3, WordHashes()) for t in texts]
    check_join(spark, texts, sets, [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(sets[a], sets[b]) >= 0.5])


def test_ngram_join_with_a_shared_template(spark):
    # sets of 300 with a passage of 62 % in common: alike, but similar only to planted partners
    rng = random.Random(15)
    shared, texts = prose(rng, 188), []
    for _ in range(60):
        own = prose(rng, 114)
        texts.append(shared + " " + own)
        texts += [shared + " " + " ".join(own.split(" ")[:k]) + " " + prose(rng, 114 - k) for k in rng.sample((30, 50, 80), 2)]
    rng.shuffle(texts)
    sets = [ngram_join.ngram_set(t, 3, WordHashes()) for t in texts]
    check_join(spark, texts, sets, [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(sets[a], sets[b]) >= 0.5])


@pytest.mark.parametrize("flush", [8, 2_000_000])
def test_pairs_within_blocks_and_across(monkeypatch, flush):
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        bases = [rng.integers(0, 1 << 63, rng.integers(1, 30)).astype(np.uint64) for _ in range(4)]
        sets = [np.unique(np.r_[b[rng.random(len(b)) < 0.85], rng.integers(0, 1 << 63, rng.integers(1, 6)).astype(np.uint64)]) for b in bases for _ in range(8)]
        want = {(a, b): jaccard(sets[a], sets[b]) for a, b in itertools.combinations(range(len(sets)), 2) if jaccard(sets[a], sets[b]) >= 0.5}
        block = rng.integers(0, 6, len(sets))
        rows = sorted((int(block[i]), len(s), i) for i, s in enumerate(sets))
        low = [(sets[i] >> np.uint64(32)).astype(np.uint32).view(np.int32) for _, _, i in rows]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(low, pa.list_(pa.int32()))]
        batch = pa.RecordBatch.from_arrays(columns, ["block", "h", "size", "low"])
        within = [r for x in ngram_join._within(0.5)(iter([batch.slice(0, 5), batch.slice(5)])) for r in x.to_pylist()]
        assert {(min(r["a"], r["b"]), max(r["a"], r["b"])): r["jaccard"] for r in within} == {k: v for k, v in want.items() if block[k[0]] == block[k[1]]} and len(within) == len({(r["a"], r["b"]) for r in within})
        often = Counter(np.concatenate(sets).tolist())
        signed = []
        for i, s in enumerate(sets):
            order = sorted(s.tolist(), key=lambda g: (often[g], g))
            signed += [(g - (1 << 63), int(block[i]), i, len(s), k) for k, g in enumerate(order[: len(s) - math.ceil(len(s) / 2) + 1])]
        signed.sort()
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*signed), [pa.int64()] * 3 + [pa.int32()] * 2)], ["g", "block", "h", "size", "place"])
        across = {(r["a"], r["b"]) for x in ngram_join._across(0.5)(batch.slice(k, 7) for k in range(0, len(batch), 7)) for r in x.to_pylist()}
        assert all(block[a] != block[b] for a, b in across) and across >= {k for k in want if block[k[0]] != block[k[1]]}


def test_near_copies_meet_in_their_block(spark, monkeypatch):
    # each of their pairs was sent once for every task with a signature of both
    rows, written = {}, ngram_join.written

    def counted(df, name):
        found = written(df, name)
        rows[name] = found.count()
        return found

    monkeypatch.setattr(ngram_join, "written", counted)
    rng = random.Random(31)
    text = prose(rng, 300)
    found = ngram_join.similar_groups(table(spark, [edited(rng, text, 0.01) for _ in range(40)])).collect()
    assert [r.links for r in found] == [39] * 40 and rows["join-pairs"] < 40


def test_ngram_join_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 150)
    test_ngram_join_in_small_steps(spark, monkeypatch)


@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 60))
@settings(max_examples=100, deadline=None)
def test_knapsack(classes, budget):
    lengths, counts = [c[0] for c in classes], [c[1] for c in classes]
    best = max(s for take in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(n * x for n, x in zip(lengths, take))) <= budget)
    for take in (mixing.knapsack(lengths, counts, budget), mixing.fit(lengths, counts, budget)):
        assert all(0 <= x <= c for x, c in zip(take, counts))
        assert sum(n * x for n, x in zip(lengths, take)) <= budget
    assert sum(n * x for n, x in zip(lengths, mixing.knapsack(lengths, counts, budget))) == best


def test_mixture_meets_its_budgets(spark):
    rng = random.Random(12)
    data = [(i, prose(rng, rng.randrange(1, 90)), "en", f"s{min(3, int(rng.expovariate(0.7)))}", 0) for i in range(600)]
    docs = spark.createDataFrame(data, DOCS)
    have = Counter()
    for _, t, _, s, _ in data:
        have[s] += len(t.split())
    got = Counter()
    for r in mixing.mixture(docs).collect():
        got[r.source] += r.n_tokens
    w = {s: n**0.7 for s, n in have.items()}
    total = min(have[s] * sum(w.values()) / w[s] for s in have)
    for s in have:
        want = min(have[s], math.floor(total * w[s] / sum(w.values()) + 1e-6))
        assert want - 1 <= got[s] <= want
    assert {tuple(r) for r in mixing.mixture(docs).collect()} == {tuple(r) for r in mixing.mixture(docs.repartition(7)).collect()}


def test_a_tiny_source_does_not_cut_the_others(spark, tmp_path):
    rng = random.Random(16)
    data = [(i, prose(rng, 50), "en", f"s{i % 3}", 0) for i in range(600)]
    kept = []
    for k, extra in enumerate(([], [(600, prose(rng, 20), "en", None, 0)])):
        spark.createDataFrame(data + extra, DOCS).write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        got = Counter()
        for r in queries.op9_mix_sources(spark, str(tmp_path / str(k))).collect():
            got[r.source] += r.n_tokens
        kept.append(got)
    assert sum(kept[0].values()) == 30_000 and kept[1][None] == 20
    w = 10_000**0.7 / (3 * 10_000**0.7 + 20**0.7)
    assert all(math.floor(30_020 * w) - 50 <= kept[1][f"s{k}"] <= 30_020 * w for k in range(3))
    docs = spark.createDataFrame(data + extra, DOCS)
    assert corpus_pipeline.mix_sources(spark, docs, "").count() > 590


def replayed(pieces, where, opened):
    """Contents of the bins if each piece went where it says; fails if an open bin was a better fit."""
    bins = []
    for n, b, size in zip(pieces, where, opened):
        rooms = [c - f for c, f in bins if c - f >= n]
        if rooms:
            assert bins[b][0] - bins[b][1] == min(rooms)
            bins[b][1] += n
        else:
            assert b == len(bins)
            bins.append([size, n])
    return [f for _, f in bins]


@given(st.lists(st.integers(1, 16), max_size=40))
@settings(max_examples=100, deadline=None)
def test_best_fit(pieces):
    pieces, sizes = sorted(pieces, reverse=True), (4, 8, 16)
    opened = [next(c for c in sizes if c >= n) for n in pieces]
    where, filled = packing.best_fit(pieces, sizes, opened)
    assert filled == replayed(pieces, where, opened)
    where, filled, final = packing.pack_lengths(pieces, sizes)
    for b, (f, c) in enumerate(zip(filled, final)):
        assert sum(n for n, w in zip(pieces, where) if w == b) == f <= c and (c == 4 or f > c // 2)


def test_pack_covers_every_token(spark):
    rng = random.Random(13)
    texts = [prose(rng, rng.choice([3, 100, 700, 3000, 20_000])) for _ in range(60)]
    got = packing.pack(table(spark, texts), shard_pieces=20).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in enumerate(texts):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == len(t.split())
    assert len({r.shard for r in got}) > 1


def test_words_agree_with_re2_pattern():
    assert words("Ab_1, cd-éf\n") == ["ab_1", "cd", "éf"] and re.findall(r"\w+", "x") == ["x"]


def test_packed_sequences_hold_every_token_once(spark):
    rng = random.Random(23)
    texts = [prose(rng, rng.choice([1, 7, 40, 300])) for _ in range(60)] + [prose(rng, 1500), "", " \n "]
    docs = table(spark, texts)
    packed = packing.pack(docs, lengths=(64, 128, 512))
    rows = packing.sequences(docs, packed).collect()
    assert all(len(r.text.split()) == r.n_tokens <= r.capacity for r in rows)
    assert Counter(w for r in rows for w in r.text.split()) == Counter(w for t in texts for w in t.split())


@given(st.lists(st.integers(1, 16), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_packing_against_the_optimum(pieces):
    pieces = sorted(pieces, reverse=True)
    sizes = (4, 8, 16)

    def least(rest, bins):
        if not rest:
            return sum(packing.cost(next(c for c in sizes if c >= b)) for b in bins)
        out = least(rest[1:], bins + [rest[0]])
        for k in range(len(bins)):
            if bins[k] + rest[0] <= 16:
                out = min(out, least(rest[1:], bins[:k] + [bins[k] + rest[0]] + bins[k + 1 :]))
        return out

    where, filled, final = packing.pack_lengths(pieces, sizes)
    assert [sum(n for n, w in zip(pieces, where) if w == b) for b in range(len(filled))] == filled
    assert all(f <= c for f, c in zip(filled, final))
    assert sum(map(packing.cost, final)) <= 1.3 * least(pieces, []) + 1e-9


def test_knapsack_beyond_the_first_window():
    lengths, counts = [997, 1009, 4001, 7919], [40, 30, 20, 10]
    budget = 151_000
    best = 0
    for d in range(11):
        for c in range(21):
            for b in range(31):
                left = budget - 7919 * d - 4001 * c - 1009 * b
                if left >= 0:
                    best = max(best, budget - left + 997 * min(40, left // 997))
    take = mixing.fit(lengths, counts, budget, window=16)
    assert all(x <= c for x, c in zip(take, counts)) and sum(n * x for n, x in zip(lengths, take)) <= budget
    whole = mixing.knapsack(lengths, counts, budget)
    assert sum(n * x for n, x in zip(lengths, whole)) == best
    assert sum(n * x for n, x in zip(lengths, take)) >= best - 997
