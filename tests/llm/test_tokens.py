"""Token counts and BPE ids against the library, over all kinds of characters."""

import hashlib
import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from keystrata.llm import bpe_codec, token_counts

ALPHABETS = [[chr(c) for c in (*range(0, 48), *range(97, 123), *range(127, 161))], list("אבגदकीกขابت😀é́ñΣσςİıǅ aaa'sll!!,.019\t\r\n"), list("aab  '"), ["aaaa", "ab", " ", "<|endoftext|>", "<|startoftext|>", "<|end", " ", " ", "　", "\x85"]]


def texts(n=800):
    rng = random.Random(9)
    fixed = ["x \0abc", "\0", " \0", "a\0 b", "", "a" * 5000, "<|endoftext|><|endoftext|>", " <|endoftext|> <|ENDOFTEXT|>", "  ", "a  b", "a ", " a", "\n\n a\n"]
    return fixed + [f"a{chr(c)}b {chr(c)} c{chr(c)}" for c in range(161)] + ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("table", [0, 50, 65_536])
def test_counts_as_the_library(table):
    own = texts()
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    lengths = {p: len(tok.encode(p).ids) for t in own[::3] for p in token_counts.splitter()(t)}
    counter = token_counts.Counting(open(path("byte_bpe_50k.json")).read(), dict(list(lengths.items())[:table]), 200)
    for i in range(0, len(own), 50):
        assert counter.counts(own[i : i + 50]) == [len(tok.encode(t, add_special_tokens=False).ids) for t in own[i : i + 50]]


@pytest.mark.parametrize("limit", [7, 150_000])
def test_ids_as_the_library(limit):
    own = texts()
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    encoder = bpe_codec.Encoder(open(path("word_bpe_49k.json")).read(), limit)
    for t, (ids, shown) in zip(own, encoder.results(iter(own)), strict=True):
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert shown == tok.decode(want, skip_special_tokens=False), t


def test_table_is_fitted_on_whole_texts(spark):
    docs = spark.createDataFrame([(i, "common words " * 50 + "tail" * 9 + f" end{i}") for i in range(300)] + [(None, None)], "doc_id long, text string")
    spec = open(path("byte_bpe_50k.json")).read()
    table = token_counts.frequent_table(docs, spec, 1000, 4, 64)
    assert set(table) <= {" words", " common", "common", " end", " ", " tail", "tail" * 9, " " + "tail" * 9} and len(table) == 4
    assert token_counts.count_tokens(docs, spec).where("n_tokens > 100").count() == 300


def test_digests_hold_few_texts(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 40) for i in range(500)], "doc_id long, text string")
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    for r in bpe_codec.encode_digests(docs, open(path("word_bpe_49k.json")).read(), word_limit=50).collect():
        ids = tok.encode(f"word{r.doc_id} " * 40, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)
