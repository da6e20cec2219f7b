"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

from keystrata.llm import mixing, url_templates

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = f"translate(coalesce(text, ''), '{url_templates.UPPER}', '{url_templates.LOWER}')"

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.id)
SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, id = min(c) AS kept
FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
gone AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE doc_id > least),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM gone),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def rule_cases(column: str) -> str:
    rules = sorted(url_templates.RULES, key=lambda r: -len(r[1] + r[2]))
    shown = {"rule": lambda r: r[1] + r[2], "verdict": lambda r: r[0]}[column]
    return "CASE " + " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{shown(r)}'" for r in rules) + " END"


def smoothed(bad: str, n: str, prior: str) -> str:
    return f"(({bad} + {url_templates.SMOOTHING}::DOUBLE * {prior}) / ({n} + {url_templates.SMOOTHING}::DOUBLE))"


def urls_sql(depth: int = 12) -> str:
    """The tree level by level, down to paths of ``depth`` segments."""
    least, far = url_templates.LEAST_LABELLED, f"{url_templates.SIGNIFICANT}::DOUBLE * sqrt(greatest(rate * (1 - rate), 0.01::DOUBLE) / greatest(bn, 1))"
    parts = [
        "u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u)",
        f"p AS (SELECT page_id, translate(raw, '{url_templates.UPPER}', '{url_templates.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)",
        f"j AS (SELECT *, {rule_cases('rule')} AS rule, {rule_cases('verdict')} AS by_rule, string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/')[2:] AS segs FROM p)",
        "l AS (SELECT host, segs, count(by_rule) AS n, count(*) FILTER (by_rule = 'block') AS bad FROM j GROUP BY 1, 2)",
        "g AS (SELECT sum(bad)::DOUBLE / greatest(sum(n), 1) AS overall FROM l)",
        f"hs AS (SELECT host, sum(n) AS tn, {smoothed('sum(bad)', 'sum(n)', '(SELECT coalesce(overall, 0) FROM g)')} AS rate FROM l GROUP BY 1)",
        f"t0 AS (SELECT l.*, host AS node, rate, CASE WHEN tn >= {least} THEN rate END AS purity FROM l JOIN hs USING (host))",
    ]
    for k in range(1, depth + 1):
        parts += [
            f"b{k} AS (SELECT *, CASE WHEN bn = 0 THEN '*' WHEN bbad / greatest(bn, 1) - rate > {far} THEN '+' WHEN rate - bbad / greatest(bn, 1) > {far} THEN '-' ELSE '*' END AS side FROM (SELECT node, segs[{k}] AS seg, sum(n) AS bn, sum(bad) AS bbad, any_value(rate) AS rate, any_value(purity) AS purity FROM t{k - 1} WHERE len(segs) >= {k} GROUP BY 1, 2))",
            f"m{k} AS (SELECT node, side, sum(bn) AS tn, {smoothed('sum(bbad)', 'sum(bn)', 'any_value(rate)')} AS rate, any_value(purity) AS above FROM b{k} GROUP BY 1, 2)",
            f"t{k} AS (SELECT t.host, t.segs, t.n, t.bad, CASE WHEN len(segs) >= {k} THEN t.node || '/' || b.side ELSE t.node END AS node, CASE WHEN len(segs) >= {k} THEN m.rate ELSE t.rate END AS rate, CASE WHEN len(segs) < {k} THEN t.purity WHEN m.tn >= {least} THEN m.rate ELSE m.above END AS purity FROM t{k - 1} t LEFT JOIN b{k} b ON b.node = t.node AND b.seg = t.segs[{k}] AND len(segs) >= {k} LEFT JOIN m{k} m ON m.node = b.node AND m.side = b.side)",
        ]
    select = f"SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN purity >= {url_templates.REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN t{depth} t ON t.host = j.host AND t.segs = j.segs"
    return "WITH " + ",\n".join(parts) + "\n" + select


def mixing_sql() -> str:
    """The budget tree level by level, then the prefix of each leaf in seeded order."""
    parts = [
        f"d AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '{mixing.CURATED}') THEN 'curated' ELSE 'web' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len({WORDS.format("coalesce(text, '')")}) AS n_tokens FROM documents)",
        "leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY 1, 2, 3)",
    ]
    for k, name in enumerate(mixing.LEVELS):
        own_levels, parents = ", ".join(mixing.LEVELS[: k + 1]), ", ".join(mixing.LEVELS[:k])
        by = f"PARTITION BY {parents}" if parents else ""
        up = f"{by} ORDER BY fill, {name}"
        weight = "CASE " + " ".join(f"WHEN {name} = '{n}' THEN {w}" for n, w in mixing.WEIGHTS[name].items()) + " ELSE 1 END"
        above = f"JOIN (SELECT {parents}, budget AS above FROM b{k - 1}) USING ({parents})" if k else ""
        root = "" if k else f", CAST(floor((sum(sum(tokens)) OVER () * {mixing.MAX_EPOCHS} // {mixing.MAX_EPOCHS})::DOUBLE * {mixing.SHARE}::DOUBLE) AS BIGINT) AS above"
        parts += [
            f"n{k} AS (SELECT *, capacity::DOUBLE / weight AS fill FROM (SELECT {own_levels}, CAST(sum(tokens) * {mixing.MAX_EPOCHS} AS BIGINT) AS capacity, {weight} AS weight{root} FROM leaf GROUP BY {own_levels}) {above})",
            f"r{k} AS (SELECT *, row_number() OVER ({up}) AS ord, above - coalesce(sum(capacity) OVER ({up} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER ({up} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM n{k})",
            f"o{k} AS (SELECT *, min(ord) FILTER (WHERE rest * weight < capacity * weights) OVER ({by}) AS opened, min_by(rest, ord) FILTER (WHERE rest * weight < capacity * weights) OVER ({by}) AS r0, min_by(weights, ord) FILTER (WHERE rest * weight < capacity * weights) OVER ({by}) AS w0 FROM r{k})",
            f"s{k} AS (SELECT *, CASE WHEN ord >= opened THEN r0 * weight // w0 ELSE capacity END AS part, CASE WHEN ord >= opened THEN r0 * weight % w0 END AS more FROM o{k})",
            f"q{k} AS (SELECT *, r0 - sum(part) FILTER (WHERE ord >= opened) OVER ({by}) AS left_over, row_number() OVER ({by} ORDER BY more DESC NULLS LAST, {name}) AS rank FROM s{k})",
            f"b{k} AS (SELECT *, CAST(part + CASE WHEN ord >= opened AND rank <= left_over THEN 1 ELSE 0 END AS BIGINT) AS budget FROM q{k})",
        ]
    levels = ", ".join(mixing.LEVELS)
    parts += [
        f"p AS (SELECT {levels}, epochs, budget - epochs * tokens AS rest FROM (SELECT {levels}, tokens, budget, CASE WHEN tokens > 0 THEN budget // greatest(tokens, 1) ELSE 0 END AS epochs FROM leaf JOIN b{len(mixing.LEVELS) - 1} USING ({levels})))",
        f"k AS (SELECT *, md5('{mixing.SEED}:' || (epochs + 1) || ':' || doc_id) AS key FROM d JOIN p USING ({levels}))",
        f"t AS (SELECT *, greatest(least(n_tokens, rest - coalesce(sum(n_tokens) OVER (PARTITION BY {levels} ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0)::BIGINT AS prefix_tokens FROM k)",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {levels}, n_tokens, CAST(epochs AS BIGINT) AS epochs, prefix_tokens, CAST(epochs * n_tokens + prefix_tokens AS BIGINT) AS taken_tokens FROM t"


ORACLES = {"op2_minhash_dedup": MINHASH, "op3_substring_dedup": SUBSTRING, "op6_mixing": mixing_sql(), "op8_url_templates": urls_sql()}
