"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: Fixed values of the contract: kind, pattern, group and least length of its text.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)
#: Bits of the key that are used, and bytes of a shard.
BITS, QUERY_BYTES = 60, 262144


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of one rule: a text split by the pattern gives the gaps, and the running length of gaps and matches gives the places."""
    p = _quoted(pattern)
    return f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS rank, stop - len(m) AS start, stop FROM (
      SELECT doc_id, m, sum(len(gap) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
        SELECT doc_id, unnest(string_split_regex(t, {p})) AS gap, unnest(regexp_extract_all(t, {p})) AS m, unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) AS i FROM d))
    WHERE m IS NOT NULL AND len(regexp_extract(m, {p}, {group})) >= {least}"""


ORACLES["op1_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_spans(i, *r) for i, r in enumerate(RULES))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

ORACLES["op2_decontaminate"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

ORACLES["op4_sharding"] = f"""
WITH k AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
  ('0x' || md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, ''))[1:15])::BIGINT AS key FROM documents),
p AS MATERIALIZED (SELECT d::INT AS depth, key >> ({BITS} - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows, min(key) = max(key) AS same
  FROM k, range(0, {BITS + 1}) r(d) GROUP BY ALL),
f AS (SELECT doc_id, key, n_bytes, min(depth) AS depth FROM k JOIN p ON p.prefix = key >> ({BITS} - depth) WHERE shard_bytes <= {QUERY_BYTES} OR same GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(prefix), f.depth, '0') END AS shard, f.depth, shard_bytes, shard_rows, shard_bytes > {QUERY_BYTES} AS overflow
FROM f JOIN p ON p.depth = f.depth AND p.prefix = key >> ({BITS} - f.depth)"""

ORACLES["op10_topk"] = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op6_jaccard"] = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_ASCII}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM e JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.x = w.doc_id GROUP BY w.doc_id"""

#: Bytes as hex, two characters each, since DuckDB has no substring of a blob.
ORACLES["op5_suffix"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS MATERIALIZED (SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING min(doc_id) <> max(doc_id)),
s AS MATERIALIZED (SELECT doc_id, p, p + 50 AS e FROM w JOIN f USING (k) WHERE first < doc_id),
g AS (SELECT *, p > lag(e) OVER (PARTITION BY doc_id ORDER BY p) AS fresh FROM s),
r AS (SELECT doc_id, min(p) AS a, max(e) AS b FROM (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM r),
o AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)"""

ORACLES["op12_collocations"] = rf"""
WITH p AS MATERIALIZED (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_ASCII}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS MATERIALIZED (SELECT lang, k::INT AS k, w[i:i + k - 1] AS v, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 4) r(k)) GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM t WHERE f >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM t WHERE k = 1 GROUP BY lang),
u AS (SELECT x.lang, x.v, x.f AS a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * x.f * x.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c WHERE k > 1) x JOIN c l ON l.lang = x.lang AND l.v = x.v[1:cut] JOIN c r ON r.lang = x.lang AND r.v = x.v[cut + 1:]),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, v ORDER BY score, cut) = 1),
i AS (SELECT lang, v, max(f) AS f FROM (SELECT lang, f, unnest([v[1:2], v[2:3]]) AS v FROM c WHERE k = 3) GROUP BY ALL),
d AS (SELECT b.lang, array_to_string(b.v, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.v = b.v WHERE i.f IS NULL OR 100 * i.f < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d JOIN n USING (lang)
QUALIFY rank <= 2000"""

ORACLES["op13_lexical"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS MATERIALIZED (SELECT doc_id, 10 + (90 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM b JOIN f USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10"""
