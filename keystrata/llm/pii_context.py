"""PII: base patterns, then bootstrapped contextual extraction (DataFrame only).

Base spans (email, ip, card, phone) are leftmost, non-overlapping matches that
pass their checks.  They and words shaped like a key (``KEY``) are the seeds of
a pattern-instance graph: an instance is a word with a digit or an at sign; its
patterns, in lower case, are the two words before it, and the word before it
with the word after it.  Spark scores the graph in rounds until no instance is
added.  A pattern's support is the weight of its known instances; its confidence
is their share of its distinct instances times the logarithm of the support,
over the logarithm of ``least_seeds``, 1 at most: the more known ones, the more
unseen ones it may have.  Patterns that reach ``accept`` with ``least_seeds``
known instances or more make their further instances known, with the confidence
as weight; known ones stay known and support other patterns as seeds do.  All
instances outside base spans that an accepted pattern surrounds are spans of
kind ``context``.

Texts are scanned once and never shuffled; what they hold is written down as
small rows.  The graph holds distinct (pattern, instance) edges as 64-bit
hashes; accepted patterns are broadcast up to ``BROADCAST_LIMIT`` of them,
beyond it they are joined.  Match groups use possessive quantifiers and contexts
are cut from reversed gaps, so neither long runs nor very many matches take
quadratic time or overflow the stack.  Null text counts as empty; repeated rows
get equal spans; an empty table gives an empty result; further columns are
ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.textkernel import few
from keystrata.plans.checkpoints import forget, own_folder, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with group repetition made possessive and
#: starts inside a run ruled out where the run's start would have matched.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these can't hold a match.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: A word with a digit or an at sign, cut at its letters, digits and signs.
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: A word of 20 letters, digits, - and _ or more, with letters and digits, is a seed.
KEY = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_-]{20,}+$"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Matches summed at a time.
CHUNK = 128
#: Hashes of patterns that are broadcast at most.
BROADCAST_LIMIT = 500_000

ACCEPT, LEAST_SEEDS = 0.9, 5
SPANS = "array<struct<start:int,end:int,value:string,before:string,head:string>>"


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def matches(text: Column, pattern: str, contexts: bool = False) -> Column:
    """Start, end and value of the matches, in code points.

    With ``contexts``, also the last two words of what stands between a match
    and the one before, and the first word behind it (empty if there is none).
    The pieces between matches give their places.  Lengths are summed within
    chunks of matches, then over chunks, so that a text with very many matches
    doesn't copy a growing array for each of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPANS)

    def span(start, end, value, before, head):
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"), head.alias("head"))

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        own = span(start, end, p["value"], last_two(p["gap"]), first_word(p["next"])) if contexts else span(start, end, p["value"], F.lit(""), F.lit(""))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(own)).alias("spans"))

    def chunked(pairs):
        count = F.ceil(F.size(pairs) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))
        return F.transform(chunks, lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), none.alias("spans")), step))

    def placed(parts):
        starts = F.aggregate(parts, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))
        both = F.arrays_zip(parts.alias("part"), F.slice(starts, 1, F.size(parts)).alias("from"))
        return F.flatten(F.transform(both, lambda x: F.transform(x["part"]["spans"], lambda s: span(s["start"] + x["from"], s["end"] + x["from"], s["value"], s["before"], s["head"]))))

    def zipped(pieces):
        """Each match with the pieces before and behind it."""
        pairs = F.arrays_zip(pieces.alias("gap"), found.alias("value"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("next"))
        return F.filter(pairs, lambda p: p["value"].isNotNull())

    return let(let(F.split(text, pattern, -1), zipped), lambda p: F.when(F.size(p) > 0, let(chunked(p), placed)).otherwise(none))


def last_two(text: Column) -> Column:
    """The last two words of a text, with what stands between them."""
    return F.reverse(F.regexp_extract(F.reverse(text), f"^{SPACE}*+{WORD}*+(?:{SPACE}++{WORD}++)?", 0))


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, f"^{SPACE}*+({WORD}*+)", 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]++", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(d.rlike("^[0-9]$"), d.cast("int") * (1 + i % 2)).otherwise(0))
    return F.aggregate(places, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a match."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?$"))
    if kind == "card":
        number = digits(value)
        return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def checker(kind: str):
    return lambda s: passes(kind, s["value"])


def base_spans(text: Column, kind: str) -> Column:
    """Start and end of the checked base spans of a kind."""
    none = F.array().cast(SPANS)
    raw = F.when(text.rlike(HINTS[kind]), matches(text, PATTERNS[kind])).otherwise(none)
    return F.transform(F.filter(raw, checker(kind)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def surrounded(found: str) -> Column:
    """Instances without the signs around them, each with hashes of its patterns."""

    def own(s, i):
        one, two, after = F.get(found, i - 1), F.get(found, i - 2), F.get(found, i + 1)
        # A match behind another one without a word between them has it as context.
        lead = F.concat_ws(" ", two["value"], one["before"], one["value"], s["before"])
        words = F.split(F.trim(F.regexp_replace(F.lower(last_two(lead)), f"{SPACE}++", " ")), " ")
        right = F.lower(F.when(s["head"] != "", s["head"]).otherwise(F.coalesce(after["value"], F.lit(""))))
        left = F.element_at(words, -1)
        skip = F.length(F.regexp_extract(s["value"], r"^[^\p{L}0-9+]*+", 0))
        inner = F.regexp_extract(s["value"], r"(?s)[\p{L}0-9+](?:.*[\p{L}0-9])?", 0)
        start = s["start"] + skip
        return F.struct(
            start.alias("start"), (start + F.length(inner)).alias("end"), F.xxhash64(inner).alias("instance"), inner.rlike(KEY).alias("key"), (inner != "").alias("real"),
            F.when(left != "", F.xxhash64(F.lit("before"), F.array_join(words, " "))).alias("p1"),
            F.when((left != "") & (right != ""), F.xxhash64(F.lit("around"), left, right)).alias("p2"),
        )

    return F.filter(F.transform(found, own), lambda s: s["real"])


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, an array of spans by kind, and the instances: all that is read of the texts."""
    text = F.col("text")
    found = F.when(text.rlike("[0-9@]"), matches(text, INSTANCE, True)).otherwise(F.array().cast(SPANS))
    own = docs.select("doc_id", *(base_spans(text, k).alias(k) for k in KINDS), found.alias("found"))
    return own.select(F.monotonically_increasing_id().alias("row"), "doc_id", *KINDS, surrounded("found").alias("found"))


def instances(rows: DataFrame) -> DataFrame:
    """One row for each instance: place, hashes, ``base`` (it overlaps a base span) and ``seed``.

    In order of the instances' ends and the base spans' starts, a base span
    overlaps an instance if one of those before it ends behind its start.
    """
    known = rows.select("row", F.explode(F.concat(*KINDS)).alias("s")).select("row", F.col("s.start").alias("at"), F.lit(1).alias("kind"), F.col("s.end").alias("reach"))
    own = rows.select("row", F.explode("found").alias("s"))
    own = own.select("row", F.col("s.end").alias("at"), F.lit(0).alias("kind"), "s")
    both = own.unionByName(known, allowMissingColumns=True)
    so_far = Window.partitionBy("row").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("reach", F.max("reach").over(so_far)).where("kind = 0")
    base = F.coalesce(F.col("reach") > F.col("s.start"), F.lit(False))
    return marked.select("row", "s.start", "s.end", "s.instance", "s.p1", "s.p2", base.alias("base"), (base | F.col("s.key")).alias("seed"))


def confident_patterns(graph: DataFrame, accept: float, least_seeds: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Patterns that end at ``accept``, from (pattern, instance, seed) edges."""
    known, before = written(graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("weight"))), -1
    while True:
        edges = graph.select("pattern", "instance").join(known, "instance")
        support = F.sum("weight")
        scored = edges.groupBy("pattern").agg(
            F.least(F.lit(1.0), support / F.count("*") * F.log2(F.greatest(support, F.lit(1.0))) / F.log2(F.lit(float(max(least_seeds, 2))))).alias("confidence"),
            F.sum((F.col("weight") > 0).cast("long")).alias("known"),
        )
        accepted = written(scored.where((F.col("confidence") >= accept) & (F.col("known") >= least_seeds)).select("pattern", "confidence"))
        best = graph.join(few(accepted, limit), "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
        last, known = known, written(known.join(best, "instance", "left").select("instance", F.greatest("weight", F.coalesce("best", F.lit(0.0))).alias("weight")))
        forget(last)
        now = known.where("weight > 0").count()
        if now == before:
            forget(known)
            return accepted.select("pattern")
        forget(accepted)
        before = now


def find(docs: DataFrame, accept: float = ACCEPT, least_seeds: int = LEAST_SEEDS, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row."""
    own_folder(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = scanned(docs).checkpoint()
    places = instances(rows).checkpoint()
    edges = places.select(F.explode(F.array("p1", "p2")).alias("pattern"), "instance", "seed").where("pattern is not null")
    graph = written(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    patterns = few(confident_patterns(graph, accept, least_seeds, limit), limit)
    # Places of instances under confident patterns, by row.
    more = places.where("not base")
    hits = [more.join(patterns, more[p] == patterns["pattern"], "left_semi").select("row", "start", "end") for p in ("p1", "p2")]
    placed = hits[0].unionByName(hits[1]).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))
    out = rows.drop("found").join(placed, "row", "left")

    def shown(kind, column):
        return F.transform(column, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    base = F.concat(*(shown(k, F.col(k)) for k in KINDS))
    every = F.concat(base, F.coalesce(shown("context", F.col("more")), F.array().cast("array<string>")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
