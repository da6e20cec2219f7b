"""Whole operators against plain Python: mixing, contextual extraction, the forest."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np

from keystrata.llm import mixing, pii_context, quality_forest
from tests.llm.test_operators import base_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Mixing


def shares(children, above):
    """Whole tokens of each child (name, capacity, weight) of a node with a budget."""
    left, open_, out = Fraction(above), sorted(children, key=lambda c: (Fraction(c[1], c[2]), c[0])), {}
    while open_:
        name, capacity, weight = open_[0]
        if left * weight < capacity * sum(c[2] for c in open_):
            break
        out[name], left, open_ = capacity, left - capacity, open_[1:]
    if open_:
        total = sum(c[2] for c in open_)
        exact = {c[0]: left * c[2] / total for c in open_}
        out |= {n: math.floor(x) for n, x in exact.items()}
        extra = int(left - sum(math.floor(x) for x in exact.values()))
        for n in sorted(exact, key=lambda n: (math.floor(exact[n]) - exact[n], n))[:extra]:
            out[n] += 1
    return out


def mixed(docs, weights, share, max_epochs, seed):
    """doc_id: (epochs, prefix tokens) of (doc_id, text, lang, source) rows with distinct ids."""
    rows = [(i, len(WORD.findall(t or "")), (("curated" if re.search("src1[0-9]$", s or "") else "web"), la or "", s or "")) for i, t, la, s in docs]
    leaf = defaultdict(int)
    for _, n, key in rows:
        leaf[key] += n
    budget = {(): math.floor(sum(leaf.values()) * share)}
    for depth, level in enumerate(("domain", "lang", "source")):
        below = defaultdict(dict)
        for key, n in leaf.items():
            below[key[:depth]][key[depth]] = below[key[:depth]].get(key[depth], 0) + n * max_epochs
        budget = {(*node, name): b for node, own in below.items() for name, b in shares([(k, c, weights.get(level, {}).get(k, 1)) for k, c in own.items()], budget[node]).items()}
    out = {}
    for key, total in leaf.items():
        epochs = budget[key] // total if total else 0
        rest = budget[key] - epochs * total
        own = [(hashlib.md5(f"{seed}:{epochs + 1}:{i}".encode()).hexdigest(), i, n) for i, n, k in rows if k == key]
        for _, i, n in sorted(own):
            out[i] = (epochs, max(min(n, rest), 0))
            rest -= n
    return out


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 60)) if rng.random() < 0.95 else None, rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src1", "src11", "src12", None])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4)
    for share, epochs in ((0.5, 2), (0.83, 1), (1.0, 1), (1.7, 3)):
        got = {r.doc_id: (r.epochs, r.prefix_tokens) for r in mixing.allocate(df, share=share, max_epochs=epochs).collect()}
        assert got == mixed(docs, mixing.WEIGHTS, share, epochs, mixing.SEED)


# Contextual extraction


def contexts(docs, accept=0.9, least=5):
    """Context spans of each document."""
    rows = []
    for i, text in docs:
        base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text)]
        words = [(m.start(), m.group()) for m in WORD.finditer(text)]
        for k, (at, w) in enumerate(words):
            if not re.search("[0-9@]", w):
                continue
            m = re.search(r"[^\W_](?:.*[^\W_])?|[+](?:.*[^\W_])?", w)
            inner = m.group() if m else ""
            if not inner:
                continue
            start, end = at + m.start(), at + m.end()
            before = [x.lower() for _, x in words[max(k - 2, 0) : k]]
            after = words[k + 1][1].lower() if k + 1 < len(words) else ""
            patterns = ([("b", *before)] if before else []) + ([("a", before[-1], after)] if before and after else [])
            hit = any(a < end and b > start for a, b in base)
            key = bool(re.fullmatch("[A-Za-z0-9_-]{20,}", inner) and re.search("[0-9]", inner) and re.search("[A-Za-z]", inner))
            rows.append((i, start, end, inner, patterns, hit, hit or key))
    edges, weight = defaultdict(set), defaultdict(float)
    for *_, inner, patterns, _, seed in rows:
        weight[inner] = max(weight[inner], float(seed and bool(patterns)))
        for p in patterns:
            edges[p].add(inner)
    before = -1
    while True:
        accepted = {}
        for p, own in edges.items():
            support = sum(weight[x] for x in own)
            confidence = min(1.0, support / len(own) * math.log2(max(support, 1)) / math.log2(least))
            if confidence >= accept and sum(weight[x] > 0 for x in own) >= least:
                accepted[p] = confidence
        for p, c in accepted.items():
            for x in edges[p]:
                weight[x] = max(weight[x], c)
        now = sum(w > 0 for w in weight.values())
        if now == before:
            break
        before = now
    out = {i: [] for i, _ in docs}
    for i, start, end, _, patterns, hit, _ in rows:
        if not hit and any(p in accepted for p in patterns):
            out[i].append(f"context:{start}:{end}")
    return out


def test_contexts(spark):
    rng = random.Random(12)
    lead = ["mail to", "call me", "id of", "key =", "see the", "by a"]
    docs = []
    for i in range(600):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            where = rng.choice(lead)
            value = rng.choice([f"u{rng.randrange(300)}@m.example", f"x{rng.randrange(400)}", "+1 (555) 010-%04d" % rng.randrange(9999), f"({rng.randrange(99)})", "".join(rng.choices("ab12", k=24)), "plain", f"10.0.0.{rng.randrange(300)}"])
            if where in ("mail to", "call me") and rng.random() < 0.7:
                value = f"v{rng.randrange(500)}@m.example"
            parts.append(f"{rng.choice(['so', 'and then', 'UP', '7'])} {where}{rng.choice([' ', '  ', chr(10)])}{value}{rng.choice(['', ',', ' now'])}")
        docs.append((i, " ".join(parts)))
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("context")] for r in pii_context.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = contexts(docs)
    assert sum(map(len, want.values())) > 50
    assert got == want


# Forest


def test_forest_scores():
    """Scores of the vectorised trees against a walk of each row."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 3)), rng.normal(6, 1, size=(6, 3))])
    forest = quality_forest.IsolationForest(x[:300], trees=40, leaf_sample=64, seed=1)
    got = forest.score(x)
    for i in [*range(0, 300, 23), *range(300, 306)]:
        total = 0.0
        for f, cut, left, right, path in forest.trees:
            node = 0
            while left[node] != node:
                node = left[node] if x[i, f[node]] < cut[node] else right[node]
            total += path[node]
        c = 2 * (math.log(63) + 0.5772156649015329) - 2 * 63 / 64
        assert abs(got[i] - 2 ** (-total / 40 / c)) < 1e-12
    assert got[300:].min() > np.quantile(got[:300], 0.95)
