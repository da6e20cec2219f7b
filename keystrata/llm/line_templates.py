"""Line dedup by a log-template tree of fixed depth.

A line (between newlines) falls through the tree by its token count and its
``depth`` leading tokens, where a token with a digit counts as a variable field;
a line under ``least_tokens`` tokens keeps such a token if it has no other.  In
a leaf the variable fields are generalised: behind the path, up to
``1 - similarity`` of a line's positions become wildcards, those whose token
comes up least often at its place in the leaf.  Lines of one template agree
elsewhere, so a template may have any number of variants, and no two lines are
ever compared.  A template that recurs in ``min_docs`` documents or more, near
copies counted once, is dropped everywhere.  A document counts as a copy if half
of its MinHash slots, made of its other lines (of the line itself in a text of
one line), come up in documents of the template with smaller signatures.

All counts are sums of DataFrames with partial aggregation; leaves, templates
and tokens that very many lines share cost one row a task, and joins on them can
be split.  Leaves with too few lines end before any token is shuffled.  What is
dropped depends on a line's text only, so texts are not shuffled: the dropped
lines' hashes are broadcast up to ``broadcast_limit`` of them (8 bytes each),
beyond it they are joined with the lines and come back by hash of the text.

Null text has no lines and stays null; blank lines are never dropped; rows that
repeat a text count as one document, whatever their doc_id; rows with a null
doc_id are documents as others; an empty table gives an empty result; further
columns are kept by ``drop_recurring``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.textkernel import GOLD, few, fields_of, mix64, ranges, released, slices, small_batches, text_buffers, word_hashes, word_spans
from keystrata.plans.checkpoints import own_folder

DEPTH, SIMILARITY, MIN_DOCS, LEAST_TOKENS = 3, 0.7, 10, 3
WILD = np.uint64(0x57494C44)
UNIT_BYTES = 2 << 20
#: Slots of a signature; a copy shares so many.
SLOTS, ALIKE, SHINGLE = 8, 4, 2
NONE = np.uint64(2**64 - 1)
#: Hashes that are broadcast at most, 8 bytes each.
BROADCAST_LIMIT = 1 << 20


def signatures(h: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Slots (a row each) of the other lines of each line's document.

    They are made of shingles of tokens, each with the first token of its line.
    Lines are given in order by their tokens ``h`` and document; none is blank.
    """
    if len(begin) == 0:
        return np.zeros((0, SLOTS), np.uint32)
    place = np.arange(len(h)) - np.repeat(begin, count)
    left = np.repeat(count, count) - place
    shingle = h.copy()
    for k in range(1, SHINGLE):
        shingle[:-k] = np.where(left[:-k] > k, mix64(shingle[:-k] * GOLD + h[k:]), shingle[:-k])
    # Shorter ones stand only for lines that have no others.
    shingle = mix64(shingle + np.repeat(h[begin], count) * GOLD)
    use = (left >= SHINGLE) | (place == 0)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    out = np.zeros((len(begin), SLOTS), np.uint32)
    for k in range(SLOTS):
        value = np.where(use, shingle * mix64(np.array([2 * k + 1], np.uint64)) | np.uint64(1), NONE)
        low = np.minimum.reduceat(value, begin)
        least = np.minimum.reduceat(low, first)[rank]
        others = np.minimum.reduceat(np.where(low == least, NONE, low), first)[rank]
        out[:, k] = mix64(np.where((low == least) & (others != NONE), others, least)).astype(np.uint32)
    return out


def lines_of(texts: pa.Array, least_tokens: int, depth: int) -> dict[str, np.ndarray]:
    """Leaf, hash, place and first token of the lines with tokens; ``tokens`` are all tokens."""
    buf, off = text_buffers(texts)
    starts, ends, first = word_spans(buf, off)
    h = word_hashes(buf, starts, ends)
    digits = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57), dtype=np.int32)])
    variable = digits[ends] > digits[starts]
    literal, h = h, np.where(variable, WILD, h)
    cut = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1]))
    cut = cut[cut < len(buf)]
    at = np.searchsorted(starts, np.append(cut, len(buf)))
    begin, count = at[:-1], np.diff(at)
    doc = np.searchsorted(off, cut, side="right") - 1
    line = np.arange(len(cut)) - np.searchsorted(cut, off)[doc]
    # A short line of nothing but variables recurs only as it stands.
    seen = np.concatenate([[0], np.cumsum(variable)])
    bare = np.flatnonzero((count > 0) & (count < least_tokens) & (seen[begin + count] - seen[begin] == count))
    use = np.flatnonzero(count > 0)
    own = h.copy()
    at = ranges(begin[bare], count[bare])
    own[at] = literal[at]
    begin, count, doc, line = begin[use], count[use], doc[use], line[use]
    leaf = mix64(count.astype(np.uint64) * GOLD)
    for k in range(depth):
        leaf = np.where(count > k, mix64(leaf * GOLD + own[np.minimum(begin + k, max(len(h) - 1, 0))]), leaf) if len(h) else leaf
    place = np.arange(len(own)) - np.repeat(begin, count)
    whole = np.add.reduceat(mix64(own + place.astype(np.uint64) * GOLD), begin) if len(use) else np.zeros(0, np.uint64)
    return {"leaf": leaf, "whole": mix64(whole ^ leaf), "begin": begin, "count": count, "doc": doc, "line": line, "tokens": own, "masked": h}


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), np.bool_)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def parts_of(batches, index: int):
    """(rows, lines) by slices of a batch's texts."""
    for batch in batches:
        yield from slices(batch, batch.schema.names[index], UNIT_BYTES)


def bounded(keys: DataFrame, column: str, limit: int) -> np.ndarray | None:
    """A column's values, sorted, if there are no more than ``limit``; else None."""
    rows = keys.select(column).limit(limit + 1).toArrow().column(0)
    return np.sort(rows.to_numpy().astype(np.int64).view(np.uint64)) if len(rows) <= limit else None


def frequent_leaves(texts: DataFrame, min_docs: int, least_tokens: int, depth: int) -> DataFrame:
    """Leaves with lines enough for a template to recur."""

    def run(batches):
        for part in parts_of(batches, 0):
            leaf, n = np.unique(lines_of(part.column(0), least_tokens, depth)["leaf"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.view(np.int64)), pa.array(n)], ["leaf", "n"])

    counted = small_batches(texts).mapInArrow(released(run), "leaf long, n long")
    return counted.groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf")


def lines_in(texts: DataFrame, leaves: DataFrame, least_tokens: int, depth: int, limit: int) -> DataFrame:
    """leaf, whole, tokens and the slots of their documents, of all lines in ``leaves``."""
    few = bounded(leaves, "leaf", limit)
    shared = texts.sparkSession.sparkContext.broadcast(few)

    def run(batches):
        keys = shared.value
        for part in parts_of(batches, 0):
            found = lines_of(part.column(0), least_tokens, depth)
            keep = np.ones(len(found["leaf"]), np.bool_) if keys is None else member(keys, found["leaf"])
            # Signatures only of documents with a line that stays.
            some = np.zeros(part.num_rows, np.bool_)
            some[found["doc"][keep]] = True
            used = np.flatnonzero(some[found["doc"]])
            begin, count = found["begin"][used], found["count"][used]
            slots = signatures(found["masked"][ranges(begin, count)], np.cumsum(count) - count, count, found["doc"][used])[keep[used]]
            at = np.flatnonzero(keep)
            count = found["count"][at]
            tokens = found["tokens"][ranges(found["begin"][at], count)].view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(tokens)), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * SLOTS), pa.array(slots.ravel().view(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(found["leaf"][at].view(np.int64)), pa.array(found["whole"][at].view(np.int64)), *lists], ["leaf", "whole", "tokens", "slots"])

    rows = small_batches(texts).mapInArrow(released(run), "leaf long, whole long, tokens array<long>, slots array<int>")
    return rows if few is not None else rows.join(leaves, "leaf", "left_semi")


def templates(lines: DataFrame, similarity: float, depth: int) -> DataFrame:
    """leaf, whole and template of every distinct line.

    The tokens that a leaf has most often at their place stay; of ties the
    later places stay, so lines that share their literals share the choice.
    """
    distinct = lines.groupBy("leaf", "whole").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    words = distinct.select("leaf", "whole", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token")).checkpoint()
    often = words.groupBy("leaf", "place", "token").agg(F.sum("n").alias("often"))
    known = words.join(often, ["leaf", "place", "token"])
    path = F.col("place") < depth
    placed = F.collect_list(F.struct(path.alias("path"), "often", "place", "token"))
    wild = F.least(F.floor(F.col("size") * F.lit(1 - similarity) + F.lit(1e-9)), F.greatest(F.col("size") - depth, F.lit(0))).cast("int")
    out = known.groupBy("leaf", "whole", "size").agg(F.sort_array(placed).alias("placed"))
    kept = F.slice("placed", wild + 1, F.col("size") - wild)
    literal = F.sort_array(F.transform(kept, lambda x: F.struct(x["place"].alias("place"), x["token"].alias("token"))))
    return out.select("leaf", "whole", F.xxhash64("leaf", literal).alias("template"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hashes (whole) of the lines whose template recurs."""
    own_folder(docs.sparkSession)
    texts = docs.select("text")
    leaves = frequent_leaves(texts, min_docs, least_tokens, depth).checkpoint()
    lines = lines_in(texts, leaves, least_tokens, depth, broadcast_limit).checkpoint()
    of_line = templates(lines, similarity, depth).checkpoint()
    used = lines.select("leaf", "whole", "slots").withColumn("signature", F.xxhash64("slots")).join(of_line, ["leaf", "whole"])
    distinct = used.groupBy("template", "signature").agg(F.first("slots").alias("slots")).checkpoint()
    often = distinct.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    # A slot is led by the smallest signature that has it.
    slots = distinct.join(few(often.checkpoint(), broadcast_limit), "template", "left_semi").select("template", "signature", F.posexplode("slots").alias("slot", "value"))
    first = slots.groupBy("template", "slot", "value").agg(F.min("signature").alias("first"))
    led = slots.join(first, ["template", "slot", "value"]).groupBy("template", "signature").agg(F.sum((F.col("first") < F.col("signature")).cast("int")).alias("led"))
    recur = led.where(F.col("led") < ALIKE).groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return of_line.join(few(recur.select("template").checkpoint(), broadcast_limit), "template", "left_semi").select("whole").distinct().checkpoint()


def kept_lines(text: str, gone: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def drop_recurring(docs: DataFrame, counts: bool = False, **how) -> DataFrame:
    """``docs`` without its recurring lines; with ``counts``, also n_lines and n_dropped.

    Columns of those names in ``docs`` are replaced.
    """
    how = {"depth": DEPTH, "least_tokens": LEAST_TOKENS, "broadcast_limit": BROADCAST_LIMIT} | how
    dropped = recurring_lines(docs, **how)
    few, tree = bounded(dropped, "whole", how["broadcast_limit"]), (how["least_tokens"], how["depth"])
    kept = docs.drop("n_lines", "n_dropped") if counts else docs
    schema = fields_of(kept.schema) + ", n_lines long, n_dropped long" * counts

    def out(part, gone: dict[int, set[int]]):
        """Rows without the lines that ``gone`` names by row."""
        texts = part.column(part.schema.get_field_index("text"))
        columns = list(part.columns)
        if gone:
            text = texts.to_pylist()
            for row, lines in gone.items():
                text[row] = kept_lines(text[row], lines)
            columns[part.schema.get_field_index("text")] = pa.array(text, texts.type)
        if not counts:
            return pa.RecordBatch.from_arrays(columns, part.schema.names)
        buf, off = text_buffers(texts)
        ends = np.searchsorted(np.flatnonzero(buf == 10), off)
        n_lines = np.where(np.asarray(texts.is_valid()), np.diff(ends) + 1, 0)
        n_dropped = np.bincount(np.fromiter(gone, np.int64, len(gone)), [len(x) for x in gone.values()], part.num_rows).astype(np.int64) if gone else np.zeros(part.num_rows, np.int64)
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], [*part.schema.names, "n_lines", "n_dropped"])

    if few is not None:
        shared = docs.sparkSession.sparkContext.broadcast(few)

        def run(batches):
            for part in parts_of(batches, names.index("text")):
                found = lines_of(part.column(names.index("text")), *tree)
                hit = np.flatnonzero(member(shared.value, found["whole"]))
                gone: dict[int, set[int]] = {}
                for row, line in zip(found["doc"][hit].tolist(), found["line"][hit].tolist()):
                    gone.setdefault(row, set()).add(line)
                yield out(part, gone)

        names = kept.columns
        return small_batches(kept).mapInArrow(released(run), schema)

    def places(batches):
        """Two hashes of the text, and the hash and number of each line."""
        for part in parts_of(batches, 2):
            found = lines_of(part.column(2), *tree)
            keys = [pa.array(part.column(k).to_numpy()[found["doc"]]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found["whole"].view(np.int64)), pa.array(found["line"].astype(np.int32))], ["k1", "k2", "whole", "line"])

    keys = {"__k1": F.xxhash64("text"), "__k2": F.xxhash64(F.lit(1), "text")}
    texts = docs.select(keys["__k1"].alias("k1"), keys["__k2"].alias("k2"), "text").where("text is not null")
    lines = small_batches(texts).mapInArrow(released(places), "k1 long, k2 long, whole long, line int").distinct()
    gone = lines.join(dropped, "whole", "left_semi").groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_set("line").alias("__gone"))
    joined = kept.withColumns(keys).join(gone, ["__k1", "__k2"], "left").select(*kept.columns, "__gone")

    def cut(batches):
        for batch in batches:
            gone = {i: set(x) for i, x in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if x}
            yield out(pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]), gone)

    return small_batches(joined).mapInArrow(released(cut), schema)


def digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    out = drop_recurring(docs.select("doc_id", "text"), counts=True, **how)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
