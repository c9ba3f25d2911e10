"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import mixing, rules

WORD = r"[^\x20\x09-\x0D]+"

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""


def mixing_sql() -> str:
    weights = ", ".join(f"{w}e0" for w in mixing.WEIGHTS)
    most, n = mixing.MAX_COPIES, len(mixing.WEIGHTS)
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{weights}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} + 1 AS INTEGER)] AS w, source_size * {most}e0 AS ceiling FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(ceiling) OVER b, 0e0) AS left_, sum(w) OVER () - coalesce(sum(w) OVER b, 0e0) AS w_left
    FROM w WINDOW b AS (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, left_ * w > ceiling * w_left AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN ceiling ELSE coalesce((SELECT arg_min(left_ / w_left, ceiling / w) FROM f WHERE NOT is_full), 0e0) * w END AS target FROM f),
h AS (SELECT source, size, CAST(round(sqrt(CAST(size AS DOUBLE)) * {mixing.ROOT_UNITS}) AS BIGINT) AS w, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
i AS (SELECT h.*, (t.target - {most} * CAST(coalesce(sum(size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w * size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
j AS (SELECT source, arg_max(rate, size) AS rate FROM i WHERE rate * w <= {most} GROUP BY source),
e AS (SELECT d.*, t.source_size, t.target, least({most}e0, coalesce(rate, 1e300) * CAST(round(sqrt(CAST(size AS DOUBLE)) * {mixing.ROOT_UNITS}) AS BIGINT)) AS expected
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN j ON d.source IS NOT DISTINCT FROM j.source),
p AS (SELECT *, CAST(floor(expected) AS BIGINT) AS sure, expected - floor(expected) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds,
    greatest(CAST(round(target - sum(CASE WHEN size > 0 THEN sure * size ELSE 0 END) OVER (PARTITION BY source)) AS BIGINT), 0) AS need FROM p),
r AS (SELECT *, CASE WHEN odds IS NOT NULL THEN CAST(sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds, size, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS upto FROM q),
x AS (SELECT *, CASE WHEN need > 0 AND upto <= need THEN 1 ELSE 0 END AS extra FROM r),
y AS (SELECT *, need - coalesce(max(CASE WHEN extra = 1 THEN upto END) OVER (PARTITION BY source), 0) AS open_ FROM x),
v AS (SELECT *, coalesce(extra = 0 AND open_ > 0 AND odds IS NOT NULL AND abs(size - open_) < open_, false) AS fits FROM y),
z AS (SELECT *, CASE WHEN fits THEN row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - open_), odds, size, doc_id) END AS fit FROM v)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN least(sure + greatest(extra, CASE WHEN fit = 1 THEN 1 ELSE 0 END), {most}) ELSE 0 END * size AS BIGINT) AS taken FROM z
"""


def rules_sql() -> str:
    """The base statistics, then the rounds of EM one after the other over the counted vote patterns."""
    k = rules.WINDOW
    votes = {
        "symbol_words": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
        "symbol_chars": ("33 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
        "symbols_over_stops": ("n_symbols > n_stops AND 20 * n_symbols > n_words", "false"),
        "capitals": ("10 * n_capitals > 4 * word_chars", "10 * n_capitals <= word_chars"),
        "shouts": ("5 * n_shouts > n_words", "false"),
        "shouts_over_stops": ("n_shouts > n_stops AND 20 * n_shouts > n_words", "false"),
        "word_length": ("word_chars > 30 * n_words OR word_chars < 2 * n_words", "false"),
        "stops": ("n_words >= 50 AND n_stops = 0 OR n_stops > 2 * n_words", "false"),
        "dup_lines": ("2 * n_dup_lines > n_lines", "false"),
        "repeats": ("100 * n_repeat_words > 15 * n_words", "false"),
    }
    v = list(votes)
    vote_columns = ", ".join(f"CASE WHEN n_words = 0 THEN -1 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {name}" for name, (bad, good) in votes.items())
    lo, hi = rules.ACCURACY
    plo, phi = rules.PRIOR
    logit = " + ".join(f"{x} * ln(a_{x} / (1 - a_{x}))" for x in v)
    posterior = f"1 / (1 + exp(-(ln(p / (1 - p)) + {logit})))"
    rounds = [f"m0 AS (SELECT 0.8e0 AS p, {', '.join(f'0.8e0 AS a_{x}' for x in v)})"]
    for i in range(1, rules.ROUNDS + 1):
        accuracy = ", ".join(f"least({hi}e0, greatest({lo}e0, coalesce(sum(n * CASE {x} WHEN 1 THEN g WHEN -1 THEN 1 - g ELSE 0 END) / nullif(sum(n * abs({x})), 0), 0.8e0))) AS a_{x}" for x in v)
        rounds.append(f"m{i} AS MATERIALIZED (SELECT least({phi}e0, greatest({plo}e0, sum(n * g) / greatest(sum(n), 1))) AS p, {accuracy} FROM (SELECT *, {posterior} AS g FROM patterns, m{i - 1}))")
    same = " AND ".join(f"d.{x} = q.{x}" for x in v)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - {k - 2})) AS i, ws FROM t WHERE len(ws) > {k}),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + {k - 1}], ' ') AS h FROM windows),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM keyed) WHERE c > 1),
repeats AS (SELECT doc_id, CAST(sum(least({k}, coalesce(after - i, {k}))) AS BIGINT) AS n_repeat_words FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM again) GROUP BY doc_id),
b AS (SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts, CAST(length(text) - length(regexp_replace(text, '[.,;:?]', '', 'g')) AS BIGINT) AS n_stops,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN repeats r ON t.doc_id = r.doc_id),
c AS (SELECT * EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM b),
d AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {vote_columns} FROM c),
patterns AS MATERIALIZED (SELECT {', '.join(v)}, count(*) AS n FROM d GROUP BY ALL), {', '.join(rounds)},
q AS (SELECT {', '.join(v)}, {posterior} AS g FROM patterns, m{rules.ROUNDS})
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND g >= 0.5 AS kept FROM d JOIN q ON {same}
"""


SUFFIXES = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
u AS (SELECT doc_id, n, unnest(range(0, n - 99, 400)) AS c, h FROM t WHERE n >= 100),
v AS MATERIALIZED (SELECT doc_id, n, c, substr(h, 2 * c + 1, 998) AS piece FROM u),
w AS (SELECT doc_id, c, unnest(range(0, least(400, n - 99 - c))) AS i, piece FROM v),
k AS MATERIALIZED (SELECT doc_id, c + i AS p, md5_number(substr(piece, 2 * i + 1, 200)) AS s FROM w),
f AS (SELECT s, min(doc_id * 4294967296 + p) AS first FROM k GROUP BY s HAVING count(*) > 1),
g AS (SELECT k.doc_id, k.p, lag(k.p) OVER o AS before, lead(k.p) OVER o AS after FROM k JOIN f ON k.s = f.s WHERE k.doc_id * 4294967296 + k.p > f.first WINDOW o AS (PARTITION BY k.doc_id ORDER BY k.p)),
r AS (SELECT doc_id, CAST(sum(least(100, coalesce(after - p, 100))) AS BIGINT) AS n_removed, CAST(count(*) FILTER (before IS NULL OR p - before > 100) AS BIGINT) AS n_spans FROM g GROUP BY doc_id),
e AS (SELECT doc_id, p AS a FROM g WHERE before IS NULL OR p - before > 100),
z AS (SELECT doc_id, p + 100 AS b FROM g WHERE after IS NULL OR after - p > 100),
c AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS i FROM (SELECT doc_id, b FROM z UNION ALL SELECT doc_id, 0 FROM t)),
d AS (SELECT doc_id, a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS i FROM (SELECT doc_id, a FROM e UNION ALL SELECT doc_id, n FROM t)),
x AS (SELECT c.doc_id, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY b) AS kept FROM c JOIN d ON c.doc_id = d.doc_id AND c.i = d.i JOIN t ON t.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN x ON t.doc_id = x.doc_id LEFT JOIN r ON r.doc_id = t.doc_id
"""


NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256e0 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_pareto_mixing": mixing_sql(), "op4_bwt_merge": SUFFIXES, "op9_arc_to_warc": ARCHIVES, "op10_weak_supervision": rules_sql(), "op12_shared_list_negatives": NEGATIVES}
