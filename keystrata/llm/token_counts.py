"""Token counts by a map-side two-tier lookup.

Tier 1 is a broadcast table of frequent pre-tokens and their token counts,
fitted on a sample of whole texts (about ``sample_docs`` of them, drawn by hash)
that is counted on the executors; it has ``table_size`` entries of
``entry_bytes`` at most, a fixed bound whatever the corpus.  Tier 2 is a bounded
cache in each Python worker for what the table lacks; what neither has is
encoded by the tokenizers library.  The tables only save work: every count
equals the library's.  There is no shuffle of the corpus' pre-tokens; the
sample's counts are summed.

Null text counts as empty (0 bytes, 0 tokens); repeated rows are counted row by
row; an empty table gives an empty result; further columns are ignored.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.textkernel import released, slices, small_batches, text_buffers, worker_cache

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Control characters and rare blanks, and characters outside long-settled
#: blocks: libraries and Unicode versions may class them differently, so what
#: holds one is cut into pre-tokens by the tokenizers library.
ODD = re.compile("[^\t\n\r\x20-\x7e¡-ԯ‐-‧‰-⁞、-ヿ一-龥가-힣]").search

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
SLICE_BYTES = 2 << 20


def splitter():
    import regex

    return regex.compile(BYTE_LEVEL_PATTERN).findall


def load_tokenizer(spec: str):
    """The tokenizer of a JSON text, kept for the worker's life."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    cache = worker_cache()
    key = ("tokenizer", hash(spec))
    if key not in cache:
        tok = Tokenizer.from_str(spec)
        tok.no_truncation()
        tok.no_padding()
        cache[key] = tok
    return cache[key]


def frequent_table(docs: DataFrame, spec: str, sample_docs: int, table_size: int, entry_bytes: int) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a sample of whole texts."""
    share = max(1, docs.count() // max(sample_docs, 1))
    # Copies of a text have ids of their own, so none fills the sample.
    drawn = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(share)) == 0

    def run(batches):
        split, counts = splitter(), Counter()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                for text in part.column(0).to_pylist():
                    counts.update(p for p in split(text) if len(p.encode()) <= entry_bytes)
            counts = Counter(dict(counts.most_common(4 * table_size)))
        rows = counts.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["part", "n"])

    sample = small_batches(docs.where("text is not null").where(drawn).select("text")).mapInArrow(released(run), "part string, n long")
    top = sample.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(table_size)
    keys = [r.part for r in top.collect()]
    return dict(zip(keys, map(len, load_tokenizer(spec).encode_batch_fast(keys, add_special_tokens=False)), strict=True))


class Counting:
    """The two tiers in a worker.

    A text is cut before every space; where each piece starts with a single
    space, no pre-token spans a cut, so a piece is one pre-token or a few whole
    ones.  Other texts are split whole.
    """

    def __init__(self, spec: str, frequent: dict[str, int], cache_size: int):
        self.tok, self.split, self.frequent, self.cache_size = load_tokenizer(spec), splitter(), frequent, cache_size
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache = worker_cache().setdefault(("token counts", hash(spec)), {})
        self.uneven = re.compile(r" (?:\s|$)|\s $").search

    def lookup(self, parts: set[str]) -> dict[str, int]:
        """Counts of parts of text that begin and end with pre-tokens: table, cache, then library."""
        known = {p: self.frequent[p] for p in parts & self.frequent.keys()}
        missing = parts - known.keys()
        cached = missing & self.cache.keys()
        known.update((p, self.cache[p]) for p in cached)
        new = list(missing - cached)
        if new:
            if len(self.cache) + len(new) > self.cache_size:
                self.cache.clear()
            coded = dict(zip(new, self.encode(new)))
            self.cache.update(coded if len(coded) <= self.cache_size else {})
            known |= coded
        return known

    def encode(self, parts: list[str]) -> list[int]:
        """Counts of parts that are in no tier, by their pre-tokens."""
        rows = [self.split(p) for p in parts]
        tokens = {t for row in rows if len(row) > 1 for t in row}
        whole = [row[0] for row in rows if len(row) == 1]
        lengths = dict(zip(whole, map(len, self.tok.encode_batch_fast(whole, add_special_tokens=False))))
        lengths |= self.lookup(tokens - lengths.keys()) if tokens else {}
        return [sum(map(lengths.__getitem__, row)) for row in rows]

    def alone(self, text: str) -> bool:
        """Whether the library must see the text whole."""
        return any(s in text for s in self.special) or ODD(text) is not None

    def counts(self, texts: list[str]) -> list[int]:
        rows: list = []
        for text in texts:
            if self.alone(text):
                rows.append(len(self.tok.encode(text, add_special_tokens=False)))
            elif self.uneven(text):
                rows.append(self.split(text))
            else:
                first, *rest = text.split(" ")
                rows.append(([first] if first else []) + [" " + p for p in rest])
        lists = [r for r in rows if isinstance(r, list)]
        get = self.lookup(set().union(*lists)).__getitem__ if lists else None
        return [sum(map(get, r)) if isinstance(r, list) else r for r in rows]


def count_tokens(docs: DataFrame, spec: str, limit: int = 512, sample_docs: int = 2000, table_size: int = 65_536, entry_bytes: int = 64, cache_size: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    ``spec`` is the JSON text of a byte-level BPE tokenizer.  Texts that hold
    one of its special strings or an odd character are encoded whole by the
    library.
    """
    docs = docs.select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast((spec, frequent_table(docs, spec, sample_docs, table_size, entry_bytes)))

    def run(batches):
        spec, frequent = table.value
        counter = Counting(spec, frequent, cache_size)
        for batch in batches:
            sizes, totals = np.diff(text_buffers(batch.column(1))[1]), []
            for part in slices(batch, "text", SLICE_BYTES):
                totals += counter.counts([t or "" for t in part.column(1).to_pylist()])
            n_tokens = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), n_tokens, pa.compute.greater(n_tokens, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return small_batches(docs).mapInArrow(released(run), SCHEMA)
