"""Recurring lines go wherever they stand; copies and near copies count once."""

import random

import pytest

from keystrata.llm import line_templates


@pytest.fixture(scope="module")
def lines(spark):
    """doc_id and lines kept of documents with boilerplate, and of near copies."""
    rng = random.Random(1)
    story = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    docs = {i: f"{story(40)}\n{story(40)}\nReleased under the terms\nof the {2000 + i} public licence\nwith all rights kept\nPage {i}\nShare" for i in range(60)}
    docs[100] = "of the 1999 public licence"
    base = [story(12).split() for _ in range(12)]
    for i in range(200, 300):
        own = [list(x) for x in base]
        for _ in range(7):
            own[rng.randrange(12)][rng.randrange(12)] = f"new{story(1)}"
        docs[i] = "\n".join(map(" ".join, own))
    docs |= {300 + i: str(1000 + i) for i in range(30)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return docs, {r.doc_id: r.text for r in line_templates.drop_recurring(df).collect()}


def test_block_and_short_lines(lines):
    docs, got = lines
    assert all(got[i] == "\n".join(docs[i].split("\n")[:2]) for i in range(60))


def test_text_of_one_line(lines):
    assert lines[1][100] == ""


def test_near_copies_stay(lines):
    docs, got = lines
    assert all(got[i] == docs[i] for i in range(200, 300))


def test_bare_numbers_stay(lines):
    docs, got = lines
    assert all(got[300 + i] == docs[300 + i] for i in range(30))
