"""Contexts find unseen identifiers with few seeds, and through found ones."""

import pytest

from keystrata.llm import pii_context


@pytest.fixture(scope="module")
def found(spark):
    """Contexts found, by doc_id."""
    docs = [(i, f"please write to user{i}@mail.example today") for i in range(10)] + [(10, "please write to handle77 now")]
    docs += [(100 + i, f"some text reach me at some{i}@mail.example now") for i in range(200)] + [(300 + i, f"do reach me at nick{i}x now") for i in range(40)]
    # Each link of the chain knows only what the one before has found.
    for k in range(6):
        docs += [(1000 + 100 * k + i, f"link{'abcdefg'[k]} chain id{k * 8 + i}z end") for i in range(24)]
    docs += [(2000 + i, f"start here id{i}z end") for i in range(16)] + [(2100 + i, f"start here me{i}@mail.example end") for i in range(20)]
    docs += [(3000 + i, f"the number {1000 + i} is free") for i in range(60)] + [(3100 + i, f"the number num{i}@mail.example is free") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.spans for r in pii_context.find(df).collect()}


def test_ten_seeds_and_one_unseen(found):
    assert found[10] == "context:16:24"


def test_a_fifth_unseen(found):
    assert all(found[300 + i].startswith("context:") for i in range(40))


def test_found_ones_support_until_nothing_is_added(found):
    assert all(found[2000 + i].startswith("context:") for i in range(16))
    assert all(found[1000 + 100 * k + i].startswith("context:") for k in range(6) for i in range(24))


def test_mostly_unseen_stays(found):
    assert all(found[3000 + i] == "" for i in range(60))
