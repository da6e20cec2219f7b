"""Line dedup: any number of variants, brute force, both ways of applying it."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from keystrata.llm import line_templates

RNG = random.Random(5)


def word(n=7):
    return "".join(RNG.choices("abcdefghijklmnop", k=n))


def story(n=30):
    return " ".join(word() for _ in range(n))


def brute(docs, least=10, similarity=0.7, depth=3, copies=False):
    """Texts without recurring lines; with ``copies``, near copies count once."""
    mask = lambda w: "\0" if any(c.isdigit() and c.isascii() for c in w) else w
    lines = []
    for i, text in enumerate(docs):
        for k, raw in enumerate(text.split("\n")):
            literal = raw.split()
            tokens = tuple(map(mask, literal))
            if tokens and len(tokens) < 3 and set(tokens) == {"\0"}:
                tokens = tuple(literal)
            if tokens:
                lines.append((i, k, tokens))
    often = Counter((len(t), t[:depth], p, w) for _, _, t in lines for p, w in enumerate(t))
    found = defaultdict(set)
    shape = {}
    for _, _, t in lines:
        wild = min(int(len(t) * (1 - similarity) + 1e-9), max(len(t) - depth, 0))
        order = sorted(range(depth, len(t)), key=lambda p: (often[len(t), t[:depth], p, t[p]], p))
        shape[t] = (len(t), t[:depth], tuple((p, w) for p, w in enumerate(t) if p not in order[:wild]))
    slots = slots_of(docs) if copies else {}
    for i, k, t in lines:
        found[shape[t]].add(slots[i, k] if copies else i)
    gone = {(i, k) for i, k, t in lines if (unled(found[shape[t]]) if copies else len(found[shape[t]])) >= least}
    return ["\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in enumerate(docs)]


def slots_of(docs):
    """The MinHash slots of the other lines of every line with tokens."""
    found = line_templates.lines_of(pa.array(docs, pa.string()), 3, 3)
    n = found["count"]
    tokens = np.concatenate([found["masked"][b : b + c] for b, c in zip(found["begin"], n)])
    rows = line_templates.signatures(tokens, np.cumsum(n) - n, n, found["doc"])
    return {(i, k): tuple(r) for i, k, r in zip(found["doc"].tolist(), found["line"].tolist(), rows.tolist())}


def unled(signatures):
    """Documents that share fewer than four slots with those before them."""
    seen, out = defaultdict(set), 0
    for s in sorted(signatures):
        out += sum(v in seen[j] for j, v in enumerate(s)) < 4
        for j, v in enumerate(s):
            seen[j].add(v)
    return out


def kept(spark, docs, **how):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    return [r.text for r in line_templates.drop_recurring(df, **how).orderBy("doc_id").collect()]


@pytest.mark.parametrize("n", [500, 513, 5000])
def test_any_number_of_variants(spark, n):
    docs = [f"{story(12)}\nthe user named {word()} has left the room {word()} just now ok" for _ in range(n)]
    assert kept(spark, docs) == [d.split("\n")[0] for d in docs]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_brute_force(spark, limit):
    pool = ["all the rights are kept by {} and {} for good", "page {}", "see the list of {} in part two", "share this", "a b c {} {} d e f g h", "call {} now", "12 13"]
    pool += [f"the very same {word()} {word()} {{}} in use" for _ in range(4)]
    docs = []
    for _ in range(120):
        lines = [story(RNG.randrange(20, 40)) for _ in range(3)]
        for t in RNG.sample(pool, RNG.randrange(4)):
            lines.insert(RNG.randrange(4), t.format(RNG.choice([word(), "x1", str(RNG.randrange(99))]), word()))
        docs.append("\n".join(lines) + "\n" * RNG.randrange(3))
    want = brute(docs)
    assert sum(a != b for a, b in zip(docs, want)) > 40
    assert kept(spark, docs, broadcast_limit=limit) == want


def test_texts_that_share_an_id(spark):
    rows = [(3, f"keep this second line of text {word()}\n{story()}\nwritten by the whole crew") for _ in range(40)]
    rows += [(3, f"{story()}\nkeep this other line {word()} {word()} {word()}"), (None, f"{story()}\nwritten by the whole crew")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (0, 1 << 20):
        got = Counter(r.text for r in line_templates.drop_recurring(df, broadcast_limit=limit).collect())
        want = [t.split("\n") for _, t in rows]
        assert got == Counter(w[1] if len(w) == 3 else "\n".join(w) if "other" in w[1] else w[0] for w in want)


def test_both_ways_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(line_templates.digests(docs).collect(), key=str) == sorted(line_templates.digests(docs, broadcast_limit=0).collect(), key=str)
