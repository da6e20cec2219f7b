"""Quality rules: an isolation forest over rule statistics.

Rule statistics of every whole text are computed on the Arrow side.  A forest
of random splits is grown on a bounded sample of labelled rows (``fit_rows``,
the smallest hashes of their doc_id) that pass the base rule; anomalous
documents have short paths.  It splits on the statistics whose distance from the
good rows' median tells the labels apart (area under the curve of ``useful`` or
more): the others would only add anomalies of their own.  So labels choose the
statistics and the threshold; the trees themselves are grown without labels.
Texts stay on the executors: the driver gets nine numbers a sampled doc_id.
The threshold is calibrated on the labelled sample: the lowest score at which
at most ``good_loss`` of the rows labelled good would be rejected.  The fitted
model has a fixed size (``trees`` x 2 x ``leaf_sample`` nodes) and travels in
the function's closure; scoring is one pass without a shuffle.

Null text counts as empty: no words, so it fails the base rule.  Repeated rows
are judged row by row; without usable labels only the base rule rejects; an
empty table gives an empty result; further columns are ignored by
``judge`` and kept by ``keep_good``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.textkernel import mix64, ranges, released, slices, small_batches, text_buffers, window_hashes, word_hashes, word_spans

#: Symbols and limits of the base rule.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

SLICE_BYTES = 2 << 20
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
EXTRA = ("n_upper", "n_shouts", "n_lines", "n_digits")


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flagged bytes each document has."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, off))


def rule_statistics(arr: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of each text of an Arrow string array."""
    buf, off = text_buffers(arr)
    starts, ends, first = word_spans(buf, off)
    n_words = np.diff(first)
    seen = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(seen[ends] - seen[starts])])
    table = np.zeros(256, np.bool_)
    table[list(SYMBOLS)] = True
    out = {
        "n_words": n_words,
        "word_chars": chars[first[1:]] - chars[first[:-1]],
        "n_symbols": per_doc(table[buf], off),
        "n_dup_lines": duplicate_lines(buf, off),
        "n_repeat_words": repeated_words(word_hashes(buf, starts, ends), first),
        "n_upper": per_doc((buf >= 65) & (buf <= 90), off),
        "n_shouts": per_doc((buf == 33) | (buf == 63), off),
        "n_lines": per_doc(buf == 10, off) + 1,
        "n_digits": per_doc((buf >= 48) & (buf <= 57), off),
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def duplicate_lines(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    raw, out = buf.tobytes(), np.zeros(len(off) - 1, np.int64)
    bounds = off.tolist()
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        lines = raw[a:b].split(b"\n")
        distinct = set(lines)
        if len(distinct) < len(lines):
            blank = sum(not line.strip(b" \t\n\x0b\x0c\r") for line in lines)
            blank_kinds = sum(not line.strip(b" \t\n\x0b\x0c\r") for line in distinct)
            out[i] = (len(lines) - blank) - (len(distinct) - blank_kinds)
    return out


def repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that lie in a 3-word window found twice or more in their text."""
    counts = np.maximum(np.diff(first) - 2, 0)
    at = ranges(first[:-1], counts)
    if len(at) == 0:
        return np.zeros(len(first) - 1, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    key = window_hashes(h, 3)[at] ^ mix64(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), np.bool_)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    covered = np.zeros(len(h), np.bool_)
    for k in range(3):
        covered[hit + k] = True
    return np.diff(np.searchsorted(np.flatnonzero(covered), first))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: shares that don't depend on length."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([
        s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / s["n_lines"], s["n_repeat_words"] / words,
        s["n_upper"] / chars, s["n_shouts"] / words, s["n_digits"] / chars,
    ], axis=1)


def mean_depth(n: int) -> float:
    """Average path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Random axis-parallel splits; anomalies are isolated in few of them."""

    def __init__(self, x: np.ndarray, trees: int = 100, leaf_sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(leaf_sample, len(x))
        self.depth = int(np.ceil(np.log2(max(self.sample, 2)))) + 1
        self.trees = [self.grow(x[rng.choice(len(x), self.sample, replace=False)], rng) for _ in range(trees)]

    def grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        nodes: list[list] = []

        def add(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([0, np.inf, at, at, level + mean_depth(len(rows))])
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_to = np.flatnonzero(high > low)
            if len(rows) > 1 and level < self.depth and len(open_to):
                f = int(rng.choice(open_to))
                cut = rng.uniform(low[f], high[f])
                side = rows[:, f] < cut
                if side.any() and not side.all():
                    nodes[at][:2] = f, cut
                    nodes[at][2] = add(rows[side], level + 1)
                    nodes[at][3] = add(rows[~side], level + 1)
            return at

        add(x, 0)
        f, cut, left, right, path = zip(*nodes)
        return np.array(f), np.array(cut), np.array(left), np.array(right), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Near 1 for anomalies, near 0.5 and below for the rest."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, cut, left, right, path in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth + 1):
                node = np.where(x[rows, f[node]] < cut[node], left[node], right[node])
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(mean_depth(self.sample), 1e-9))


def separation(distance: np.ndarray, good: np.ndarray) -> float:
    """Chance that a bad row lies farther out than a good one; ties count half."""
    inner = np.sort(distance[good])
    low, high = np.searchsorted(inner, distance[~good]), np.searchsorted(inner, distance[~good], side="right")
    return float((low + high).mean() / 2 / len(inner))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 4096, good_loss: float = 0.002, trees: int = 100, leaf_sample: int = 64, useful: float = 0.6):
    """(forest, its statistics, threshold) from a bounded sample of labelled rows, or None."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    names = [*(c.split()[0] for c in COLUMNS.split(", ")), *EXTRA]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                s = rule_statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(s[n]) for n in names)], ["doc_id", "quality", *names])

    # Executors measure the texts; the driver gets one row of numbers a label.
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("long").alias("quality"))
    measured = small_batches(labelled).mapInArrow(released(run), f"doc_id long, quality long, {', '.join(n + ' long' for n in names)}")
    rows = measured.groupBy("doc_id").agg(F.min(F.struct("quality", *names)).alias("s")).select("doc_id", "s.*").orderBy("doc_id").toArrow()
    if rows.num_rows == 0:
        return None
    s = {n: rows.column(n).to_numpy() for n in names}
    x, good = features(s), rows.column("quality").to_numpy() > 0
    x, good = x[~base_failed(s)], good[~base_failed(s)]
    if good.sum() < 32 or good.all():
        return None
    away = np.abs(x - np.median(x[good], axis=0))
    columns = [k for k in range(x.shape[1]) if separation(away[:, k], good) >= useful]
    if not columns:
        return None
    forest = IsolationForest(x[:, columns], trees, leaf_sample)
    scores = np.sort(forest.score(x[good][:, columns]))
    return forest, columns, float(scores[min(len(scores) - 1, int(len(scores) * (1 - good_loss)))])


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def verdicts(arr: pa.Array, model) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(statistics, base_failed, kept) of each text."""
    s = rule_statistics(arr)
    failed = base_failed(s)
    kept = ~failed
    if model is not None and len(arr):
        forest, columns, threshold = model
        kept &= forest.score(features(s)[:, columns]) <= threshold
    return s, failed, kept


def judge(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """doc_id, the rule statistics, base_failed and kept of every row."""
    model = fit(docs, labels, **fitting)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                s, failed, kept = verdicts(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(s[n]) for n in names), pa.array(failed), pa.array(kept)], ["doc_id", *names, "base_failed", "kept"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(released(run), f"doc_id long, {COLUMNS}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    model = fit(docs, labels, **fitting)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield part.filter(pa.array(verdicts(part.column(part.schema.get_field_index("text")), model)[2]))

    return small_batches(docs).mapInArrow(released(run), docs.schema)
