"""MinHash near-dedup with SuperMinHash signatures.

1. Signatures: an element gives the slots a random permutation of ranks, one
   rank after the other; slot value = rank + fraction, least over all elements.
   Ranks are taken level by level for all elements of a document, so a document
   stops as soon as no slot exceeds the next rank (long texts: after rank 0).
2. Documents of equal shingle set form a class; its smallest doc_id stands for
   it from here on, so exact copies cost one row each.
3. Banding: classes that share a band key get a star of links to the bucket's
   smallest member (never all pairs).  Stars are closed into candidate clusters
   by distributed union-find (large star, small star).
4. Verification: the full shingle sets of a cluster's members come together,
   and links are confirmed exactly.  Pairs already connected need no test.
   A cluster whose sets exceed ``block_items`` is cut into blocks.  Each block
   is verified alone; then the least members of the components so found, and
   last, only in clusters that are still in parts, every pair of blocks, where
   members of one part aren't compared again: bounded memory, no pair lost.
5. Confirmed links are closed by union-find; components take their smallest
   doc_id.

A document without words has an empty set, is linked with nothing and is its
own component; null text counts as empty; rows that repeat a doc_id with the
same text fall together; a null doc_id keeps its row, alone; an empty table
gives an empty result; further columns are ignored by ``components`` and kept
by ``keep_representatives``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.textkernel import ASCII_LOWER, GOLD, mix64, ranges, released, slices, small_batches, text_buffers, window_hashes, word_hashes, word_spans
from keystrata.plans.checkpoints import own_folder, written

#: 32 bands of 5 rows: a pair of similarity 0.85 is missed with chance 1e-8, one
#: of 0.8 with chance 3e-6.
BANDS, ROWS = 32, 5
SLICE_BYTES = 3 << 20


def shingle_sets(arr: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, n+1 offsets).

    A text of fewer words than ``size`` has its whole sequence as one shingle.
    """
    buf, off = text_buffers(arr)
    buf = ASCII_LOWER[buf]
    starts, ends, first = word_spans(buf, off)
    h = word_hashes(buf, starts, ends)
    n_words = np.diff(first)
    counts = np.maximum(n_words - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    keys = window_hashes(h, size)[ranges(first[:-1], counts)]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        lone = np.array([sequence_hash(h[first[i] : first[i + 1]]) for i in short.tolist()], np.uint64)
        doc, keys = np.concatenate([doc, short]), np.concatenate([keys, lone])
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    doc, keys = doc[order], keys[order]
    fresh = np.ones(len(keys), np.bool_)
    fresh[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    doc, keys = doc[fresh], keys[fresh]
    return keys, np.searchsorted(doc, np.arange(len(counts) + 1))


def sequence_hash(h: np.ndarray) -> np.uint64:
    acc = np.array([len(h)], np.uint64)
    for x in h:
        acc = mix64(acc * GOLD + x)
    return acc[0]


def super_minhash(keys: np.ndarray, off: np.ndarray, slots: int) -> np.ndarray:
    """(documents, slots) signatures; a value is rank * 2^32 + fraction.

    Empty sets keep the largest value everywhere.
    """
    n = len(off) - 1
    out = np.full(n * slots, np.iinfo(np.int64).max, np.int64)
    counts = np.diff(off)
    doc = np.repeat(np.arange(n), counts)
    elem, perm = keys, None
    for rank in range(slots):
        if len(elem) == 0:
            break
        draw = mix64(elem + np.uint64((rank + 1) * int(GOLD) & 0xFFFFFFFFFFFFFFFF))
        value = np.int64(rank) << 32 | (draw & np.uint64(0xFFFFFFFF)).astype(np.int64)
        pick = rank + ((draw >> np.uint64(32)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        if rank == 0:
            slot = pick
        else:
            if perm is None:  # the state after rank 0, only for elements that go on
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elem), 1))
                perm[np.arange(len(elem)), first_pick] = 0
                perm[:, 0] = first_pick
            rows = np.arange(len(elem))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, rank]
        lower(out, doc * slots + slot, value)
        # A document goes on while a slot is empty or above what comes next.
        worst = out.reshape(n, slots).max(axis=1)
        more = (worst >= np.int64(rank + 1) << 32)[doc]
        if not more.all():
            elem, doc = elem[more], doc[more]
            perm = perm[more] if perm is not None else None
            pick = pick[more]
        if rank == 0:
            first_pick = pick
    return out.reshape(n, slots)


def lower(out: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """out[at] = min(out[at], value), also where ``at`` repeats."""
    np.minimum.at(out, at, value)


def signature_chunks(keys: np.ndarray, off: np.ndarray, slots: int, most: int = 100_000):
    """Signatures of consecutive documents, about ``most`` elements at a time."""
    row, n = 0, len(off) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1))
        yield super_minhash(keys[off[row] : off[end]], off[row : end + 1] - off[row], slots)
        row = end


def describe(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and band keys."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                keys, off = shingle_sets(part.column(1), size)
                sig = np.concatenate([*signature_chunks(keys, off, bands * rows)]).view(np.uint64)
                n = np.diff(off)
                acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (len(sig), 1))
                for k in range(rows):
                    acc = mix64(acc * GOLD + sig[:, k::rows][:, :bands])
                sums = [np.add.reduceat(np.append(mix64(keys ^ s), np.uint64(0)), off[:-1]) for s in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))] if len(part) else []
                sums = [np.where(n > 0, s, np.uint64(0)).astype(np.uint64).view(np.int64) for s in sums]
                flat = pa.array(acc.view(np.int64).ravel())
                empty = n == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(sums[0], mask=empty), pa.array(sums[1], mask=empty), lists], ["doc_id", "n_shingles", "set1", "set2", "bands"])

    return small_batches(docs).mapInArrow(released(run), "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>")


def close(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): connected components, each named by its least node.

    Alternating large-star and small-star steps on (a, b) edges until every node
    has one root.  Each round is cut from its lineage by checkpoints; every third
    is written to files instead, as checkpoints keep estimated sizes, which joins
    multiply.  The large star's minima are written down before they are joined, so
    that Spark can split the edges of a hub.  Roots and nodes without an edge do not appear as
    nodes.
    """
    own_folder(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    for k in range(rounds):
        if settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # Large star: neighbours above a node move to its least neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        # Small star: a node and its lower neighbours move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(edges) if k % 3 == 2 else edges.checkpoint()
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def settled(edges: DataFrame) -> bool:
    """Whether every node has one root, which has none itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def confirm(keys: np.ndarray, off: np.ndarray, ids: np.ndarray, percent: int, part: np.ndarray | None = None, blocks: tuple[np.ndarray, ...] = ()) -> list[tuple[int, int]]:
    """Links (a forest of them) between sets that reach the similarity.

    Each set in turn is held against all later ones that it isn't connected
    with yet, in one vectorised pass over their elements; once all are
    connected, nothing is left to do.  So a group of near copies costs a pass
    or two, and sets that stay apart are compared exactly.  Sets of one ``part``
    are known to be connected; those of one block, by any of ``blocks``, are compared elsewhere.
    """
    n, sizes = len(off) - 1, np.diff(off)
    universe, elem = np.unique(keys, return_inverse=True)
    label, links = np.arange(n) if part is None else np.unique(part, return_inverse=True)[1].astype(np.int64), []
    held = np.zeros(len(universe), np.bool_)
    for p in range(n - 1):
        later = np.arange(p + 1, n)[label[p + 1 :] != label[p]]
        if len(later) == 0:
            if (label == label[0]).all():
                break
            continue
        near = (100 * np.minimum(sizes[later], sizes[p])) >= percent * np.maximum(sizes[later], sizes[p])
        for block in blocks:
            near &= block[later] != block[p]
        later = later[near]
        if len(later) == 0:
            continue
        held[elem[off[p] : off[p + 1]]] = True
        few = 2 * len(later) < n - p
        hits = held[elem[ranges(off[later], sizes[later])]] if few else held[elem[off[later[0]] :]]
        begin = np.concatenate([[0], np.cumsum(sizes[later])[:-1]]) if few else off[later[0] : n] - off[later[0]]
        common = np.add.reduceat(hits, begin, dtype=np.int64)
        common = common if few else common[later - later[0]]
        held[elem[off[p] : off[p + 1]]] = False
        linked = later[100 * common >= percent * (sizes[later] + sizes[p] - common)]
        if len(linked):
            joined, first = np.unique(label[linked], return_index=True)
            links += [(int(ids[p]), int(ids[q])) for q in linked[first].tolist()]
            label[np.isin(label, joined)] = label[p]
    return links


def verified(tasks: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the members (rep, text, part, block, wide) of each (root, task).

    Members of one ``block`` have been compared; so are, in other tasks, those of
    one ``wide`` block where a task has two.
    """

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep").combine_chunks()
        ids = table.column("rep").to_numpy()
        fresh = np.concatenate([[True], ids[1:] != ids[:-1]])
        table, ids = table.filter(pa.array(fresh)).combine_chunks(), ids[fresh]
        keys, off = shingle_sets(table.column("text").combine_chunks(), size)
        kinds = [table.column(k).to_numpy() for k in ("block", "wide")]
        links = confirm(keys, off, ids, percent, table.column("part").to_numpy(), tuple(k for k in kinds if (k != k[0]).any()))
        a, b = zip(*links) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tasks.groupBy("root", "task").applyInArrow(verify, "a long, b long").checkpoint()


def confirmed(docs: DataFrame, members: DataFrame, size: int, percent: int, block_items: int) -> DataFrame:
    """(node, root) of the components that exact links make within the clusters."""
    zero = F.lit(0)

    def with_texts(placed):
        return docs.join(placed, docs.doc_id == placed.rep).select("rep", "text", "root", "task", "part", "block", "wide")

    placed = blocks(members, block_items, "block").checkpoint()
    links = verified(with_texts(placed.select("rep", "root", F.col("block").alias("task"), F.col("rep").alias("part"), zero.alias("block"), zero.alias("wide"))), size, percent)
    roots = close(links)
    large = placed.where("blocks > 1").drop("blocks")
    if large.isEmpty():
        return roots

    def parted(roots):
        own = roots.select(F.col("node").alias("rep"), F.col("root").alias("own"))
        return large.join(own, "rep", "left").select("rep", "root", "n_shingles", "block", F.coalesce("own", "rep").alias("part"))

    # The least members of the components of a large cluster.
    least = blocks(parted(roots).where("rep = part"), block_items, "wide")
    links = links.unionByName(verified(with_texts(least.select("rep", "root", F.col("wide").alias("task"), "part", zero.alias("block"), zero.alias("wide"))), size, percent))
    roots = close(links)
    parts = parted(roots).checkpoint()
    # Clusters in parts: what is left are pairs of parts in different blocks.
    apart = parts.groupBy("root").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("root").checkpoint()
    if apart.isEmpty():
        return roots
    rest = blocks(parts.join(apart, "root", "left_semi"), block_items, "wide")
    tasks = with_texts(rest.select("rep", "root", "part", "block", "wide", F.explode(pairs_of(F.col("wide"), F.col("blocks"))).alias("task")))
    return close(links.unionByName(verified(tasks, size, percent)))


def components(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block_items: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Two documents are linked when their shingle sets reach a Jaccard similarity
    of ``percent`` hundredths, confirmed on the full sets.
    """
    if not 0 < bands * rows <= 256:
        raise ValueError("a signature has 1 to 256 slots")
    own_folder(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = describe(docs, size, bands, rows).checkpoint()
    filled = described.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "bands"), "doc_id").alias("own"))
    heads = classes.select("set1", "set2", "rep", "own.n_shingles", "own.bands").checkpoint()

    # Stars of each bucket: its members and its least member.
    band_rows = heads.select("rep", F.explode("bands").alias("key"))
    buckets = band_rows.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top").drop("top")
    stars = band_rows.join(buckets, "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    clusters = close(stars)
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())

    members = clusters.join(heads, clusters.node == heads.rep).select("rep", "root", "n_shingles")
    roots = confirmed(docs, members, size, percent, block_items)
    of_class = heads.join(roots, heads.rep == roots.node, "left").select("set1", "set2", F.coalesce("root", "rep").alias("component_id"))
    mine = F.when(F.col("doc_id").isNotNull(), F.col("set1")).alias("set1")
    return (
        described.select("doc_id", "n_shingles", mine, "set2").join(of_class, ["set1", "set2"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component."""
    dropped = components(docs, **how).where("not kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs.doc_id == dropped.dropped_id, "left_anti")


def blocks(members: DataFrame, block_items: int, name: str) -> DataFrame:
    """Adds a block's number, as ``name``, and blocks (how many) to the members of a cluster.

    Small clusters have one block; members of larger ones are dealt by a hash
    of their id, so no cluster has to be sorted in one task.
    """
    totals = members.groupBy("root").agg(F.sum("n_shingles").alias("items"))
    count = F.ceil(F.col("items") / F.lit(block_items)).cast("int")
    out = members.join(totals.select("root", count.alias("blocks")), "root")
    return out.withColumn(name, F.pmod(F.xxhash64(F.lit(name), "rep"), F.col("blocks")).cast("long"))


def pairs_of(block, blocks):
    """Numbers of the tasks that hold a block: one with itself and one with each other.

    The task of blocks i and j, i <= j, has number i * blocks + j.
    """
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1), lambda x: F.least(x, block) * blocks + F.greatest(x, block))
