"""BPE encoding and decoding with a pair occurrence index.

Each task interns the distinct words of its documents and encodes the new ones
together: one symbol array holds them all, an index maps each mergeable pair to
all its positions, active ranks are taken in ascending order, and each merge
updates the lists of the neighbouring pairs.  Since the lowest active rank of
all words is also the lowest of its own word, every word gets the ids that the
tokenizers library gives.  Chunks of rare scripts or control characters are cut
into words by the library and encoded by the index; special strings are cut out
first.

Null text counts as empty (no ids, empty decoded text); repeated rows are
encoded row by row; an empty table gives an empty result; further columns are
ignored by the digest form and kept by ``encode_column``.  Words of a task are
dropped from memory once ``word_limit`` distinct ones are held.
"""

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keystrata.llm.textkernel import fields_of, ranges, released, small_batches, worker_cache
from keystrata.llm.token_counts import ODD, load_tokenizer

#: Fixed value: the split pattern of the word-end vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters of text that are held at a time (more only for one long text).
HELD = 4 << 20

DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def printable_bytes() -> list[str]:
    """The character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class PairIndex:
    """Merges of one vocabulary, and the encoder that uses the index."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        chars = printable_bytes()
        self.names = {i: s for s, i in vocab.items()}
        self.byte = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        self.out = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.base + right
        # A small open table: slot -> rank, checked by key.
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int32)
        slots = self.slot(keys)
        self.table[slots[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.rank_keys = keys
        self.clash = np.bincount(slots, minlength=1 << bits) > 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it can't be merged."""
        keys = a.astype(np.int64) * self.base + b
        slots = self.slot(keys)
        got = self.table[slots]
        hit = (got >= 0) & (self.rank_keys[got] == keys)
        out = np.where(hit, got, -1)
        retry = np.flatnonzero(~hit & self.clash[slots])
        if len(retry):
            at = np.minimum(np.searchsorted(self.keys, keys[retry]), len(self.keys) - 1)
            out[retry] = np.where(self.keys[at] == keys[retry], self.order[at], -1)
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, n+1 offsets) of non-empty words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym = self.byte[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        # nxt/prv: neighbours in the word; n means none.  Slot n is a sentinel.
        nxt = np.arange(1, n + 2, dtype=np.int32)
        prv = np.arange(-1, n, dtype=np.int32)
        nxt[ends - 1] = n
        prv[0], prv[ends[:-1]] = n, n
        nxt[n] = prv[n] = n
        sym = np.append(sym, np.int32(-1))
        at = np.flatnonzero(nxt[:n] < n).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(pos: np.ndarray, ranks: np.ndarray) -> None:
            live = ranks >= 0
            pos, ranks = pos[live], ranks[live]
            if len(pos) == 0:
                return
            if len(pos) == 1:
                groups = [(int(ranks[0]), pos)]
            else:
                order = np.argsort(ranks, kind="stable")
                ranks, pos = ranks[order], pos[order]
                cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                bounds = [0, *cut.tolist(), len(pos)]
                groups = [(r, pos[i:j]) for r, i, j in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:])]
            for r, part in groups:
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(at, self.ranks(sym[at], sym[nxt[at]]))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, new = self.left[r], self.right[r], self.out[r]
            after = nxt[pos]
            ok = (sym[pos] == a) & (sym[after] == b)
            if not ok.all():
                pos, after = pos[ok], after[ok]
            if len(lists) > 1 and len(pos) > 1:
                pos = np.unique(pos)
                after = nxt[pos]
            if a == b and len(pos) > 1:
                pos = np.sort(pos)
                pos = leftmost(pos, nxt[pos])
                after = nxt[pos]
            if len(pos) == 0:
                continue
            beyond = nxt[after]
            before = prv[pos]
            sym[pos] = new
            sym[after] = -1
            nxt[pos] = beyond
            prv[beyond] = pos
            nxt[n] = prv[n] = n
            left = before[before < n]
            right = pos[beyond < n]
            both = np.concatenate([left, right])
            if len(both):
                add(both, self.ranks(sym[both], sym[nxt[both]]))
        alive = sym[:n] >= 0
        counts = np.concatenate([[0], np.cumsum(alive)])
        return sym[:n][alive], counts[np.concatenate([[0], ends])]


def leftmost(pos: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Non-overlapping occurrences of a pair of equal symbols, from the left; ``pos`` is sorted."""
    if not np.isin(after, pos, assume_unique=True).any():
        return pos
    taken, kept = set(), []
    for p, q in zip(pos.tolist(), after.tolist()):
        if p not in taken:
            kept.append(p)
            taken.add(q)
    return np.array(kept, pos.dtype)


def pair_index(spec: str) -> PairIndex:
    cache = worker_cache()
    key = ("pair index", hash(spec))
    if key not in cache:
        cache[key] = PairIndex(spec)
    return cache[key]


def normalise(text: str) -> str:
    """NFC and per-character lower case; white space only separates words."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class Encoder:
    """Interned chunks of a task: their ids as bytes and their decoded text."""

    def __init__(self, spec: str, word_limit: int):
        import regex

        self.index, self.tok, self.word_limit = pair_index(spec), load_tokenizer(spec), word_limit
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = self.index.names | {i: c for c, i in self.special.items()}
        self.find = regex.compile(WORD_PATTERN + r"|\n").findall
        self.unprintable = {c: b for b, c in enumerate(printable_bytes())}
        self.reset()

    def reset(self) -> None:
        self.chunks: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.decoded: list[str] = []

    def thin(self, numbers: np.ndarray) -> None:
        """Keep a third of the chunks at most: those that came up again."""
        uses = np.bincount(numbers, minlength=len(self.ids))
        keep = set(np.flatnonzero(uses > 1)[: self.word_limit // 3].tolist())
        chunks, ids, decoded = list(self.chunks), self.ids, self.decoded
        self.reset()
        for i in sorted(keep):
            self.chunks[chunks[i]] = len(self.ids)
            self.ids.append(ids[i])
            self.decoded.append(decoded[i])

    def intern(self, text: str) -> list[int]:
        """Numbers of the chunks between spaces and newlines.

        No word spans white space, so chunks split alike alone and in a text;
        special strings are cut out first, as the library does.
        """
        d = self.chunks
        if not self.cut or self.cut.search(text) is None:
            return [d.setdefault(w, len(d)) for w in text.replace("\n", " ").split(" ")]
        parts = self.cut.split(text)
        return [n for k, part in enumerate(parts) for n in ([d.setdefault(part, len(d))] if k % 2 else [d.setdefault(w, len(d)) for w in part.replace("\n", " ").split(" ")])]

    def odd_words(self, chunk: str) -> list[bytes]:
        """Words of a chunk of odd characters, as the library normalises and splits it."""
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(chunk))
        return [bytes(map(self.unprintable.__getitem__, p)) for p, _ in pieces]

    def encode_new(self) -> None:
        """Ids and decoded text of the chunks interned since the last call."""
        new = list(self.chunks)[len(self.ids) :]
        if not new:
            return
        special = {i: self.special[c] for i, c in enumerate(new) if c in self.special}
        odd = {i: self.odd_words(c) for i, c in enumerate(new) if ODD(c)}
        apart = odd.keys() | special.keys()
        joined = "\n".join("" if i in apart else c for i, c in enumerate(new)) if apart else "\n".join(new)
        words: dict[str, int] = {"\n": 0}
        found = np.array([words.setdefault(w, len(words)) for w in self.find(normalise(joined))], np.int64)
        more: dict[bytes, int] = {}
        odd = {i: np.array([len(words) + more.setdefault(w, len(more)) for w in own], np.int64) for i, own in odd.items()}
        flat, at = self.index.encode([w.encode() for w in words] + list(more))
        # Words of a chunk stand between two newlines (word 0, of no ids).
        counts = np.diff(at)
        counts[0] = 0
        ends = np.append(np.flatnonzero(found == 0), len(found))
        used = flat[ranges(at[found], counts[found])]
        cuts = np.concatenate([[0], np.cumsum(counts[found])])[np.concatenate([[0], ends])].tolist()
        raw, shown = used.astype("<u4").tobytes(), list(map(self.index.names.__getitem__, used.tolist()))
        ids = [raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:])]
        text = [" ".join(shown[i:j]) + " " if j > i else "" for i, j in zip(cuts, cuts[1:])]
        for i, own in odd.items():
            got = flat[ranges(at[own], counts[own])]
            ids[i] = got.astype("<u4").tobytes()
            text[i] = "".join(self.names[x] + " " for x in got.tolist())
        for i, own in special.items():
            ids[i], text[i] = own.to_bytes(4, "little"), self.names[own] + " "
        self.ids += ids
        self.decoded += text

    def results(self, texts):
        """(ids as little-endian bytes, decoded text) of each text, in order.

        Texts are held as chunk numbers until ``word_limit`` distinct chunks or
        ``HELD`` characters have come together, then encoded at once.
        """
        held, size = [], 0
        for text in texts:
            text = text or ""
            held.append(np.array(self.intern(text), np.int32))
            size += len(text)
            if len(self.chunks) >= self.word_limit or size > HELD:
                yield from self.flush(held)
                held, size = [], 0
        yield from self.flush(held)

    def flush(self, held):
        self.encode_new()
        for numbers in held:
            numbers = numbers.tolist()
            yield b"".join(map(self.ids.__getitem__, numbers)), "".join(map(self.decoded.__getitem__, numbers))[:-1]
        if len(self.chunks) >= self.word_limit:
            self.thin(np.concatenate([np.zeros(0, np.int32), *held]))


def in_runs(batches, schema, make, encoder):
    """Rows of all batches through ``encoder.results``, put back into batches."""
    batches = iter(batches)
    waiting: list = []

    def texts():
        for batch in batches:
            waiting.append(batch)
            yield from batch.column(batch.schema.get_field_index("text")).to_pylist()

    rows = []
    for got in encoder.results(texts()):
        rows.append(make(got))
        while waiting and len(rows) >= waiting[0].num_rows:
            batch = waiting.pop(0)
            n = batch.num_rows
            yield schema(batch, rows[:n])
            del rows[:n]


def encode_digests(docs: DataFrame, spec: str, word_limit: int = 150_000) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        def out(batch, rows):
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            doc = batch.column(0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        def make(got):
            ids, text = got
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

        yield from in_runs(batches, out, make, Encoder(shared.value, word_limit))

    return small_batches(docs.select("doc_id", "text")).mapInArrow(released(run), DIGEST_SCHEMA)


def encode_column(docs: DataFrame, spec: str, word_limit: int = 150_000, decoded: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, if wanted, ``decoded`` (text) appended.

    Columns of those names in ``docs`` are replaced.
    """
    docs = docs.drop("ids", "decoded")
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    fields = fields_of(docs.schema)

    def run(batches):
        def out(batch, rows):
            ids, text = zip(*rows) if rows else ((), ())
            at = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            more = [lists, pa.array(text, pa.string())] if decoded else [lists]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "ids", "decoded"][: len(batch.columns) + len(more)])

        yield from in_runs(batches, out, lambda got: got if decoded else (got[0], None), Encoder(shared.value, word_limit))

    return small_batches(docs).mapInArrow(released(run), f"{fields}, ids array<int>" + ", decoded string" * decoded)


def decode_column(encoded: DataFrame, spec: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its id arrays; null ids give null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec)
    kept = encoded.drop(to)
    fields = fields_of(kept.schema)

    def run(batches):
        tok = load_tokenizer(shared.value)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            text = [None if r is None else tok.decode(r, skip_special_tokens=False) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, to])

    return small_batches(kept).mapInArrow(released(run), f"{fields}, `{to}` string")
