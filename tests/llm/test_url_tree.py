"""The path-template tree against brute force, at any depth."""

import random
import re
from collections import defaultdict
from math import sqrt

from keystrata.llm import url_templates as u

RULES = (("block", "h.org", "/bad"), ("allow", "h.org", "/good"), ("block", "h.org", "/mix/a/x/1"), ("allow", "h.org", "/mix/a/y/1"), ("block", "k.org", "/"))


def brute(urls):
    """Verdict of each (host, path, label)."""
    rows = [(h, tuple(re.sub("[0-9]+", "*", s) for s in p.split("/")[1:]), y) for h, p, y in urls]
    label = lambda rs: (sum(y is not None for *_, y in rs), sum(y == "block" for *_, y in rs))
    smooth = lambda n, bad, prior: (bad + 4.0 * prior) / (n + 4.0)
    n, bad = label(rows)
    overall, out = bad / max(n, 1), {}

    def grow(rs, level, rate, purity):
        below = defaultdict(list)
        for r in rs:
            if len(r[1]) <= level:
                out[r[:2]] = purity
            else:
                below[r[1][level]].append(r)
        merged = defaultdict(list)
        for own in below.values():
            n, bad = label(own)
            far = 2.0 * sqrt(max(rate * (1 - rate), 0.01) / max(n, 1))
            merged["*" if n == 0 else "+" if bad / n - rate > far else "-" if rate - bad / n > far else "*"] += own
        for own in merged.values():
            n, bad = label(own)
            new = smooth(n, bad, rate)
            grow(own, level + 1, new, new if n >= 5 else purity)

    for host in {h for h, *_ in rows}:
        own = [r for r in rows if r[0] == host]
        n, bad = label(own)
        rate = smooth(n, bad, overall)
        grow(own, 0, rate, rate if n >= 5 else None)
    return [y or ("block" if (out[h, s] or 0) >= 0.8 else "allow") for (h, s, y) in rows]


def test_brute_force(spark):
    rng = random.Random(6)
    paths = []
    for _ in range(1500):
        deep = "/".join(rng.choice(["x", "y", "a", "b", f"n{rng.randrange(99)}", str(rng.randrange(30)), ""]) for _ in range(rng.randrange(7)))
        paths.append((rng.choice(["h.org", "k.org", "z.org"]), rng.choice(["/bad/", "/good/", "/mix/a/x/", "/mix/a/y/", "/new/", "/", ""]) + deep))
    paths = [(h, p if p.startswith("/") or not p else "/" + p) for h, p in paths]

    def label(h, p):
        fit = [r for r in RULES if r[1] == h and p.startswith(r[2])]
        return max(fit, key=lambda r: len(r[2]))[0] if fit else None

    want = brute([(h, p, label(h, p)) for h, p in paths])
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(paths)], "page_id long, url string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.verdict) for r in u.judge(df, RULES).collect()}
    assert [got[i] for i in range(len(paths))] == [(h, p, w) for (h, p), w in zip(paths, want)]


def test_unseen_segments_fall_into_merged_branches(spark):
    rules = (("block", "s.org", "/p/q/ads/"), ("allow", "s.org", "/p/q/doc/"))
    rows = [f"http://s.org/p/q/{'ads' if i % 2 else 'doc'}/t{'abcdef'[i % 6]}/{i}" for i in range(60)] + ["http://s.org/p/q/ads", "http://s.org/p/q/other/1"]
    rows += [f"http://w.org/z/{x}" for x in "abcdefgh"] + ["http://w.org/z/slug"]
    got = [r.verdict for r in u.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), (*rules, *(("block", "w.org", f"/z/{x}") for x in "abcdefgh"))).orderBy("page_id").collect()]
    assert got[:60] == ["allow", "block"] * 30 and got[60] == "block" and got[61] == "allow"
    assert got[-1] == "block", "a segment never labelled takes the purity of its parent's wildcard"
