"""Contexts of any width, keys as seeds, very many matches, held-out identifiers."""

import random
import time

from keystrata.llm import pii_context


def find(spark, docs, **how):
    return {r.doc_id: r.spans for r in pii_context.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **how).collect()}


def test_wide_gaps(spark):
    gap = " " * 90 + "\n" * 40
    docs = [(i, f"please contact via{' ' * (i % 3 + 1)}user{i}@mail.example today") for i in range(20)]
    docs += [(100, f"please contact{gap}via{gap}handle77 now"), (101, "x" * 500 + " contact via handle78"), (102, f"contact {'y' * 300} handle79")]
    got = find(spark, docs)
    at = len("please contact") + len(gap) + 3 + len(gap)
    assert got[100] == f"context:{at}:{at + 8}" and got[101] == "context:513:521" and got[102] == ""


def test_contexts_between_matches(spark):
    docs = [(i, f"id 7 9x user{i}@mail.example z") for i in range(20)] + [(100, "id 7 9x handle5 q"), (101, "id 8 9x handle6 q")]
    # Both words before the last one are matches themselves.
    got = find(spark, docs)
    assert got[100] == "context:8:15" and got[101] == ""


def test_keys_are_seeds(spark):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n - 2)) + "a1"
    docs = [(i, f'w{"abc"[i % 3]} token = "{key(40)}" end') for i in range(30)] + [(100, 'so token = "short1" end'), (101, f"lone {key(40)} word")]
    got = find(spark, docs)
    assert got[100] == "context:12:18" and got[101] == "" and all(got[i].startswith("context:") for i in range(30))


def test_held_out_identifiers(spark):
    """Identifiers that no base pattern matches, planted in a quarter of the contexts of seeds."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqr", k=6))
    lead = [f"{word()} {word()}" for _ in range(12)]
    docs, hidden = [], {}
    for i in range(800):
        value = f"{word()}{i}@mail.example" if i % 4 else f"{word()}{i}"
        text = f"{word()} {rng.choice(lead)} {value} {word()}"
        docs.append((i, text))
        if i % 4 == 0:
            hidden[i] = f"context:{text.index(value)}:{text.index(value) + len(value)}"
    docs += [(10_000 + i, f"{word()} {word()} {word()}{i} {word()}") for i in range(400)]
    got = find(spark, docs)
    caught = sum(got[i] == want for i, want in hidden.items())
    assert caught >= 0.95 * len(hidden), (caught, len(hidden))
    assert all(got[10_000 + i] == "" for i in range(400))
    assert got == find(spark, docs, limit=0), "joined instead of broadcast"


def test_very_many_matches(spark):
    text = " ".join(f"u{i}@m.example" for i in range(100_000))
    began = time.time()
    got = find(spark, [(1, text), (2, "a b")])
    assert got[1].count("email:") == 100_000 and got[2] == ""
    assert time.time() - began < 60
